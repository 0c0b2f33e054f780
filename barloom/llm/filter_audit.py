"""Filter interaction audit: what each of five filters removes, in every order, kept up to date over a stream of files.

All files are read as available-now micro-batches.  The first four filters look at one text; the fifth (a copy of a text
with a smaller id) needs the whole table, and smaller ids may arrive in any later file.  A keyed state holds the least id
of each text and the part and labels of the rows that carry it.  A row with a greater id counts as a copy at once.  A row
with a smaller one takes the place: the masks counted for the earlier holders are retracted and counted again as copies.
A batch so gives signed counts per (part, mask, labels), which are summed to the part's counters.

A state key stands for ``TEXTS_PER_KEY`` documents on average, dealt out by a hash of the text, and its state tells the
texts apart by their SHA-256; the number of keys grows with the table, so a state's size does not.  Before the shuffle, equal texts are merged within each Arrow batch, so a
text in a third of all rows sends a few rows a task.  The state lives in RocksDB and in the shared folder, so a lost
executor or a retried batch reads the state of the batch before; a batch's counts replace those of its failed attempt.

Cases: null text is empty; null part is the empty string; rows with a null id are never copies and make none; repeated
rows of the least id are all no copies; a document with repeated labels has a label if one of them says so; a label
without a document counts nowhere; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import itertools
import json
import math
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barloom.session import new_path, stored

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
TEXTS_PER_KEY = 256
#: micro-batches that the files at hand are dealt to
BATCHES = 4
ROCKS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # many small stores: no disk set aside for logs that stay short
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}
COUNTS = "part string, mask int, good int, toxic int, n long"
MERGED = f"bucket long, key string, id long, {COUNTS}"


def own_masks(docs: DataFrame, text: Column, name: str = "mask") -> DataFrame:
    """``docs`` with the bits of the filters A to D that the text fails."""
    words = F.filter(F.split("_text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    fails = [
        F.col("_n") < 200,
        100 * F.col("_distinct") < 50 * F.col("_n"),
        100 * F.regexp_count("_text", F.lit("[A-Z]")) > 2 * F.length("_text"),
        F.col("_text").rlike("[#$%&*|]"),
    ]
    mask = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))
    # one step each, so that the words are cut once
    cut = docs.withColumn("_text", text).withColumn("_words", words)
    return cut.withColumn("_n", F.size("_words")).withColumn("_distinct", F.size(F.array_distinct("_words"))).withColumn(name, mask).drop("_words", "_n", "_distinct")


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each text of a batch, merged: those of its least id, and all others, by part and labels."""
    for batch in batches:
        rows = batch.to_pandas()
        if not len(rows):
            continue
        ids = rows["id"] = rows["id"].astype("Int64")
        rows["first"] = (ids == ids.groupby(rows["key"]).transform("min")).fillna(False).astype(bool)
        rows["known"] = ids.notna()
        by = ["bucket", "key", "part", "mask", "good", "toxic", "known", "first"]
        out = rows.groupby(by, sort=False).agg(id=("id", "min"), n=("n", "sum")).reset_index()
        yield pa.RecordBatch.from_pandas(out[[f.split(" ")[0] for f in MERGED.split(", ")]], schema=_SCHEMA, preserve_index=False)


_SCHEMA = pa.schema([(f.split(" ")[0], {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}[f.split(" ")[1]]) for f in MERGED.split(", ")])


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Signed counts of one key's rows; the state maps a text to its least id, its mask and that id's rows."""
    held: dict[str, list] = json.loads(state.get[0]) if state.exists else {}
    counts: Counter = Counter()
    for pdf in batches:
        ids = [None if pd.isna(i) else int(i) for i in pdf["id"]]
        for text, i, part, mask, good, toxic, n in zip(pdf["key"], ids, pdf["part"], pdf["mask"].tolist(), pdf["good"].tolist(), pdf["toxic"].tolist(), pdf["n"].tolist()):
            row = [part, good, toxic, n]
            now = held.get(text)
            if i is not None and now and i > now[0]:
                mask |= COPY
            elif i is not None and now and i == now[0]:
                now[2].append(row)
            elif i is not None:
                for old_part, old_good, old_toxic, old_n in now[2] if now else []:
                    counts[old_part, now[1], old_good, old_toxic] -= old_n
                    counts[old_part, now[1] | COPY, old_good, old_toxic] += old_n
                held[text] = [i, mask, [row]]
            counts[part, mask, good, toxic] += n
    state.update((json.dumps(held, ensure_ascii=False),))
    rows = [(*k, n) for k, n in counts.items() if n]
    yield pd.DataFrame(rows, columns=["part", "mask", "good", "toxic", "n"])


def _labels(labels: DataFrame) -> DataFrame:
    one = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0)))
    return stored(labels.where("doc_id is not null").groupBy("doc_id").agg(one("quality").alias("good"), one("toxic").alias("toxic")), "audit-labels")


def _rows(docs: DataFrame, labels: DataFrame, keys: int) -> DataFrame:
    """One row a document: state key, text hash, id, part, mask and labels; null ids are spread over the join."""
    rows = own_masks(docs.select("doc_id", "text", "source"), F.coalesce("text", F.lit("")))
    rows = rows.select(F.col("doc_id").cast("long").alias("id"), F.sha2(F.col("_text").cast("binary"), 256).alias("key"), F.coalesce("source", F.lit("")).alias("part"), "mask")
    rows = rows.withColumn("_spread", F.when(F.col("id").isNull(), F.pmod(F.hash("key"), F.lit(1024))).otherwise(-1))
    flags = labels.select(F.col("doc_id").cast("long").alias("id"), F.lit(-1).alias("_spread"), "good", "toxic")
    rows = rows.join(flags, ["id", "_spread"], "left")
    flag = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select(F.pmod(F.xxhash64("key"), F.lit(keys)).alias("bucket"), "key", "id", "part", "mask", flag("good"), flag("toxic"), F.lit(1).cast("long").alias("n"))


def counters(spark: SparkSession, path: str, labels: DataFrame, batches: int = BATCHES) -> DataFrame:
    """Rows (part, mask, good, toxic, n): how many documents of a part fail exactly the filters of a mask.

    ``path`` is a Parquet table (a file or a folder) with doc_id, text and source; its files are dealt to about
    ``batches`` micro-batches in the order of their times.
    """
    whole = spark.read.parquet(path)
    keys = max(1, whole.count() // TEXTS_PER_KEY)
    listed = whole.inputFiles()
    source = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", max(1, math.ceil(len(listed) / batches)))
    folder, _, name = path.rstrip("/").rpartition("/")
    # a stream reads folders: a table of one file is read from the folder around it
    docs = source.option("pathGlobFilter", name).parquet(folder) if listed and listed[0].endswith(f"/{name}") else source.parquet(path)
    merged = _rows(docs, _labels(labels), keys).mapInArrow(_merged, MERGED)
    signed = merged.groupBy("bucket").applyInPandasWithState(_advance, COUNTS, "held string", "update", GroupStateTimeout.NoTimeout)
    out = new_path(spark, "audit-counts")

    def add(batch: DataFrame, number: int) -> None:
        batch.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n")).where("n != 0").write.mode("overwrite").parquet(f"{out}/batch={number}")

    before = {k: spark.conf.get(k, None) for k in ROCKS}
    for k, v in ROCKS.items():
        spark.conf.set(k, v)
    try:
        run = signed.writeStream.foreachBatch(add).outputMode("update").option("checkpointLocation", new_path(spark, "audit-state")).trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    if run.lastProgress is None:
        return spark.createDataFrame([], COUNTS)
    summed = spark.read.schema(COUNTS).option("recursiveFileLookup", True).parquet(out)
    return summed.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n")).where("n != 0")


def audit(counts: DataFrame) -> DataFrame:
    """All orders of the filters and their five steps for each part, from the counters of :func:`counters`."""
    masks = range(1 << len(FILTERS))
    cell = lambda m, of: F.coalesce(F.sum(F.when((F.col("mask") == m) & of, F.col("n"))), F.lit(0))
    every = F.lit(True)
    tables = {"_all": every, "_good": F.col("good") == 1, "_toxic": F.col("toxic") == 1}
    by_part = counts.groupBy("part").agg(*[F.array(*[cell(m, of) for m in masks]).alias(name) for name, of in tables.items()])
    steps = [(order, i + 1, 1 << FILTERS.index(order[i]), sum(1 << FILTERS.index(x) for x in order[:i])) for order in map("".join, itertools.permutations(FILTERS)) for i in range(len(FILTERS))]
    literal = F.from_json(F.lit(json.dumps([dict(zip(("filter_order", "step", "own", "before"), s)) for s in steps])), "array<struct<filter_order string, step int, own int, before int>>")
    rows = by_part.select("part", *tables, F.inline(literal))

    def added(table: str, rule) -> Column:
        """The sum of a part's cells whose mask meets the rule (weighted by its value)."""
        return F.aggregate(F.sequence(F.lit(0), F.lit(len(masks) - 1)), F.lit(0).cast("long"), lambda a, m: a + F.get(table, m) * rule(m))

    own, before = F.col("own"), F.col("before")
    passes = lambda m, bits: F.when(m.bitwiseAND(bits) == 0, 1).otherwise(0)
    fails = lambda m: 1 - passes(m, own)
    here = lambda m: fails(m) * passes(m, before)
    #: in how many of the 120 orders a filter comes first among those that a document fails
    firsts = F.array(*[F.lit(0), *[F.lit(math.factorial(len(FILTERS)) // k) for k in range(1, len(FILTERS) + 1)]])
    return rows.select(
        "part",
        "filter_order",
        "step",
        added("_all", lambda m: passes(m, before.bitwiseOR(own))).alias("kept"),
        added("_all", here).alias("removed"),
        added("_all", lambda m: fails(m) * (1 - passes(m, before))).alias("redundant"),
        added("_all", lambda m: F.when(m == own, 1).otherwise(0)).alias("unique_fails"),
        added("_good", here).alias("good_lost"),
        added("_toxic", here).alias("toxic_lost"),
        added("_all", lambda m: fails(m) * F.get(firsts, F.bit_count(m))).alias("shapley"),
    )
