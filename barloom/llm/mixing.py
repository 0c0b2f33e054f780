"""Mixing sources to target weights by systematic sampling.

Every document of a source is expected in the mix ``target / source size`` times.  The documents of a
source are put in a fixed order, the expected copies are summed up along it, one offset per source is added,
and a document is emitted once for each whole number that its part of the sum crosses.  Sums are whole
numbers (units of 1e-8 copies), so a document never gets more than the rate rounded up.

The order goes by size first: neighbours then differ little in size, and the words taken miss the target by
about one document.  It is cut into chunks of (source, size class, two hex digits of a hash of the id), so a
source of any share is numbered in pieces: per chunk only a count is summed over the source.

Cases: null text has size 0; documents of size 0 have copies like others but add no words; a null source is a
source of its own, last in order; rows that repeat are separate documents; an empty table gives an empty
mix with targets of nothing; extra columns of ``docs`` are kept.  All plans here are DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: weights of the sources in code point order
CYCLE = (5, 2, 1)
UNIT = 100_000_000


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_key(source: Column) -> Column:
    """A source as a key that is never null and sorts like (nulls last, code point)."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix") -> DataFrame:
    """``docs`` with ``_size``, ``_source``, ``_class``, ``_draw`` and ``_salt``."""
    digits = F.length(F.col("_size").cast("string"))
    lead = F.substring(F.col("_size").cast("string"), 1, 2).cast("int")
    draw = F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.lit(f":{seed}")).cast("binary"))
    return (
        docs.withColumn("_size", words(F.col(text)))
        .withColumn("_source", source_key(F.col(source)))
        .withColumn("_class", digits * 100 + lead)
        .withColumn("_draw", draw)
        .withColumn("_salt", F.substring("_draw", 1, 2))
    )


def targets(sizes: DataFrame, cycle: tuple[int, ...] = CYCLE, most: int = 3, seed: str = "mix", weights: DataFrame | None = None) -> DataFrame:
    """One row per source: ``_source``, ``source_size``, ``target``, ``rate`` (units), ``offset`` (units).

    ``weights`` (``_source``, ``weight``) replaces the cycle.  Targets share the total by weight; a source stops
    at ``most`` times its size and the rest goes to the others.  Sorted by size per weight, the sources that stop
    come first, so the level follows from two running sums.  The windows run over one row per source.
    """
    total = sizes.groupBy("_source").agg(F.sum("_size").alias("source_size"))
    if weights is None:
        place = F.row_number().over(Window.orderBy("_source")) - 1
        weighed = total.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (place % len(cycle) + 1).cast("int")))
    else:
        weighed = total.join(weights, "_source")
    cap = (F.col("source_size") * most).cast("double")
    every = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy(cap / F.col("weight"), "_source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every).cast("double") - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / F.sum("weight").over(after)
    levels = weighed.withColumn("_order", F.row_number().over(order)).withColumn("_level", level)
    fits = F.when(F.col("_level") * F.col("weight") <= cap, F.struct("_order", "_level"))
    chosen = levels.withColumn("_fill", F.min(fits).over(every)["_level"])
    target = F.least(cap, F.col("weight") * F.coalesce(F.col("_fill"), F.lit(0.0)))
    offset = F.conv(F.substring(F.md5(F.concat(F.col("_source"), F.lit(f":{seed}")).cast("binary")), 1, 7), 16, 10).cast("long")
    return chosen.withColumn("_hex", offset).select(
        "_source",
        "source_size",
        target.alias("target"),
        F.coalesce(F.floor(target * UNIT / F.when(F.col("source_size") > 0, F.col("source_size"))), F.lit(0)).alias("rate"),
        F.expr(f"(_hex * {UNIT}) div {1 << 28}").alias("offset"),
    )


def allotted(rows: DataFrame, sizes: DataFrame, plan: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``rows`` (of :func:`measured`) with ``source_size``, ``target`` and ``copies``.  ``sizes`` has the same
    rows and may be a narrow stored copy of them; only counts per chunk are taken from it."""
    chunk = ["_source", "_class", "_salt"]
    counts = sizes.groupBy(*chunk).agg(F.count(F.lit(1)).alias("_n"))
    classes = counts.groupBy("_source", "_class").agg(F.sum("_n").alias("_n"))
    before_class = F.coalesce(F.sum("_n").over(Window.partitionBy("_source").orderBy("_class").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before_salt = F.coalesce(F.sum("_n").over(Window.partitionBy("_source", "_class").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = (
        counts.withColumn("_in_class", before_salt)
        .join(classes.withColumn("_to_class", before_class).drop("_n"), ["_source", "_class"])
        .select(*chunk, (F.col("_in_class") + F.col("_to_class")).alias("_before"))
        .join(plan, "_source")
    )
    place = F.row_number().over(Window.partitionBy(*chunk).orderBy("_size", "_draw", doc_id))

    def passed(place: str) -> Column:
        return F.expr(f"(offset + ({place}) * rate) div {UNIT}")

    return (
        rows.withColumn("_place", place)
        .join(starts, chunk)
        .withColumn("_at", F.col("_before") + F.col("_place"))
        .withColumn("copies", (passed("_at") - passed("_at - 1")).cast("int"))
        .drop("_class", "_draw", "_salt", "_place", "_before", "_at", "rate", "offset")
    )


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", cycle: tuple[int, ...] = CYCLE, most: int = 3, seed: str = "mix") -> DataFrame:
    """The mix: every row of ``docs`` as often as it is taken, with its own columns."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(doc_id).alias("_doc"), F.col(text).alias("_text"), F.col(source).alias("_from"))
    rows = measured(whole, "_doc", "_text", "_from", seed).drop("_text", "_from")
    sizes = rows.select("_source", "_class", "_salt", "_size")
    taken = allotted(rows, sizes, targets(sizes, cycle, most, seed), "_doc").where("copies > 0")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_row.*")
