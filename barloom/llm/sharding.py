"""Sharding by sampled splitters: key samples weighted by size, quantile boundaries, a range partition.

Records are ordered by (hash of the text, hash of the id), so equal texts lie side by side and a group
is spread over as few shards as its bytes need.  Keys are drawn with a chance in proportion to their size; the
quantiles of the drawn keys are the splitters of the ranges.  The bytes of every range are then counted exactly,
and a range over twice the mean is subdivided by more keys drawn from it, down to single records, so a
group of copies of any share is sorted by many tasks.  Inside a range a running sum gives each record's place
in all bytes; its middle decides the shard.  Shards are therefore equal up to one record, and the sample
has no influence on the result, only on the ranges.

Law ``bytes``.  Cases: null text has 0 bytes; rows that repeat are separate records (told apart by their place in
the stored narrow table); an empty table gives an empty result; only id and text are read, so extra
columns do no harm.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.types import INT
from barloom.session import stored

WIDTH = 64


def records(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", overhead: int = 16) -> DataFrame:
    """A stored narrow table: ``doc_id``, ``size``, ``text_crc32`` and the 64-character key ``_key``."""
    content = F.coalesce(F.col(text), F.lit("")).cast("binary")
    narrow = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(content) + overhead).cast("long").alias("size"),
        F.crc32(content).alias("text_crc32"),
        F.concat(F.md5(content), F.substring(F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")).cast("binary")), 1, 16)).alias("_key"),
    )
    table = stored(narrow, "shard-records")
    row = F.concat(F.col("_metadata.file_name"), F.lit(":"), F.col("_metadata.row_index"))
    return table.withColumn("_key", F.concat("_key", F.substring(F.md5(row.cast("binary")), 1, 16)))


def _range_of(splitters: list[str]):
    bounds = np.array([x.encode() for x in splitters], f"S{WIDTH}")

    @F.arrow_udf(INT)
    def range_of(keys: pa.Array) -> pa.Array:
        keys = keys.cast(pa.binary()).to_numpy(zero_copy_only=False).astype(f"S{WIDTH}")
        return pa.array(np.searchsorted(bounds, keys, "right").astype(np.int32))

    return range_of


def _drawn(rows: DataFrame, chance, seed: str) -> DataFrame:
    draw = F.conv(F.substring(F.md5(F.concat(F.col("_key"), F.lit(seed)).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    return rows.where(draw < chance)


def ranges(rows: DataFrame, shards: int, oversample: int = 32, rows_per_range: int = 500_000) -> tuple[list[str], list[tuple[int, int, int]]]:
    """Splitters, and (range, rows, bytes) of each range.

    Drawn keys and range totals come to the driver: ``oversample`` keys per range, with 16 ranges per shard or
    one per ``rows_per_range`` records, which is what Spark's own range partitioning gathers.
    """
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    if not n:
        return [], []
    wanted = max(16 * shards, n // rows_per_range)
    limit = 2 * total / wanted
    keys = sorted(r[0] for r in _drawn(rows, F.col("size") * (wanted * oversample / total), "first").select("_key").collect())
    splitters = sorted(set(keys[oversample::oversample]))
    again = oversample
    while True:
        totals = [
            tuple(r) for r in rows.groupBy(_range_of(splitters)("_key").alias("range")).agg(F.count(F.lit(1)), F.sum("size")).orderBy("range").collect()
        ] if splitters else [(0, n, total)]
        full = {r: size for r, count, size in totals if count > 1 and size > limit}
        alone = _lone(rows, splitters, full, limit)
        full = {r: s for r, s in full.items() if r not in alone}
        if not full:
            return splitters, totals
        again *= 2
        held = rows.withColumn("_range", _range_of(splitters)("_key") if splitters else F.lit(0)).where(F.col("_range").isin(list(full)))
        more: dict[int, list[str]] = {}
        for r, key in _drawn(held, F.col("size") * (wanted * again / total), str(again)).select("_range", "_key").collect():
            more.setdefault(r, []).append(key)
        new = set()
        for r, drawn in more.items():
            parts = int(np.ceil(2 * full[r] / limit))
            drawn.sort()
            new.update(drawn[:: max(1, len(drawn) // parts)])
        splitters = sorted({*splitters, *new})


def _lone(rows: DataFrame, splitters: list[str], full: dict[int, int], limit: float) -> set[int]:
    """Of the full ranges those that are full by one record alone; they cannot be made smaller than it."""
    if not full:
        return set()
    held = rows.withColumn("_range", _range_of(splitters)("_key") if splitters else F.lit(0)).where(F.col("_range").isin(list(full)))
    largest = dict(held.groupBy("_range").agg(F.max("size")).collect())
    return {r for r, size in full.items() if size - largest[r] <= limit}


def shard(docs: DataFrame, shards: int = 40, doc_id: str = "doc_id", text: str = "text", overhead: int = 16) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``shard`` and ``slot`` of every row."""
    rows = records(docs, doc_id, text, overhead)
    splitters, totals = ranges(rows, shards)
    starts, bytes_before, rows_before = [], 0, 0
    for r, count, size in totals:
        starts.append((r, bytes_before, rows_before))
        bytes_before, rows_before = bytes_before + size, rows_before + count
    table = rows.sparkSession.createDataFrame(starts, "_range int, _bytes long, _rows long")
    order = Window.partitionBy("_range").orderBy("_key", "doc_id")
    placed = (
        rows.withColumn("_range", _range_of(splitters)("_key") if splitters else F.lit(0))
        .withColumn("_to", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_place", F.row_number().over(order) - 1)
        .join(table, "_range")
        .withColumn("_middle", 2 * (F.col("_bytes") + F.col("_to")) - F.col("size"))
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.least(F.lit(shards - 1), F.expr(f"(_middle * {shards}) div {max(1, 2 * bytes_before)}")).cast("int").alias("shard"),
            (F.col("_rows") + F.col("_place")).alias("_at"),
        )
    )
    placed = stored(placed, "shard-places")
    first = placed.groupBy("shard").agg(F.min("_at").alias("_first"))
    return placed.join(first, "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("_at") - F.col("_first")).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 40, doc_id: str = "doc_id", text: str = "text") -> None:
    """Write the rows of ``docs`` in one folder per shard, in slot order, as Parquet.  A row is found by its id
    and the checksum of its text, so rows that repeat are written as often as they occur."""
    places = shard(docs, shards, doc_id, text)
    key = [F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))]
    nth = Window.partitionBy("_id", "_crc").orderBy(F.lit(1))
    left = docs.withColumn("_id", key[0]).withColumn("_crc", key[1]).withColumn("_nth", F.row_number().over(nth))
    right = places.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("_id"), F.col("text_crc32").alias("_crc"), F.col("shard").alias("_shard"), F.col("slot").alias("_slot")
    ).withColumn("_nth", F.row_number().over(nth))
    (left.join(right, ["_id", "_crc", "_nth"]).drop("_id", "_crc", "_nth").repartition("_shard").sortWithinPartitions("_shard", "_slot").write.partitionBy("_shard").parquet(path))
