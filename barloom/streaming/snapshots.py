"""Alert cycles over what is new: a stored snapshot of bars that every micro-batch advances by its ticks.

A bar is kept as mergeable parts (first and last tick by sequence, highest, lowest, volume), so a late tick lands in the bar
it belongs to.  The snapshot holds the bars of the alert history only, a number bounded by the calendar whatever the ticks.
A batch reads its own ticks and the snapshot of the batch before, never the ticks of earlier batches; rules are looked at
again only for symbols that the batch has ticks of.  Two folders take turns: batch n reads the one that batch n - 1 wrote
and overwrites the other, so a retried batch starts from the same snapshot and leaves the same one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.alerts import HISTORY_DAYS, MIN_BARS, evaluate_rules, latest_indicators, rule_symbols


def bar_parts(ticks: DataFrame, width: str = "hour") -> DataFrame:
    """Ticks (symbol, ts, price, qty, seq) as mergeable parts of bars of one ``width`` (hour, day); merges map-side."""
    tick = F.struct(F.col("seq").cast("long").alias("seq"), F.col("price").cast("double").alias("price"))
    start = F.date_trunc(width, F.col("ts").cast("timestamp")).cast("timestamp_ntz")
    return ticks.filter("price IS NOT NULL").groupBy("symbol", start.alias("ts")).agg(
        F.min(tick).alias("first"), F.max("price").alias("high"), F.min("price").alias("low"), F.max(tick).alias("last"), F.sum("qty").alias("volume")
    )


def merged(parts: DataFrame) -> DataFrame:
    return parts.groupBy("symbol", "ts").agg(
        F.min("first").alias("first"), F.max("high").alias("high"), F.min("low").alias("low"), F.max("last").alias("last"), F.sum("volume").alias("volume")
    )


def as_bars(parts: DataFrame) -> DataFrame:
    return parts.select("symbol", "ts", F.col("first.price").alias("open"), "high", "low", F.col("last.price").alias("close"), "volume")


def recent(parts: DataFrame, days: int = HISTORY_DAYS) -> DataFrame:
    """The bars of the last ``days`` before each symbol's own newest bar."""
    newest = F.max("ts").over(Window.partitionBy("symbol"))
    return parts.withColumn("_newest", newest).filter(F.col("ts").cast("date") >= F.date_sub(F.col("_newest").cast("date"), days)).drop("_newest")


def newest_alerts(parts: DataFrame, rules: DataFrame) -> DataFrame:
    """The rules that the newest bars fire, of symbols with enough history."""
    bars = as_bars(recent(parts).join(rule_symbols(rules), "symbol", "left_semi"))
    enough = bars.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("symbol"))).filter(F.col("_n") >= MIN_BARS).drop("_n")
    return evaluate_rules(latest_indicators(enough), rules)


class AlertSnapshots:
    """The snapshots of one stream below ``path``."""

    def __init__(self, path: str, rules: DataFrame, width: str = "hour") -> None:
        self.path, self.rules, self.width = path, rules, width

    def _at(self, batch_id: int) -> str:
        return f"{self.path}/bars-{batch_id % 2}"

    def cycle(self, ticks: DataFrame, batch_id: int) -> DataFrame:
        """Advance the snapshot by the ticks of one batch and give the alerts of the symbols it touches."""
        spark = ticks.sparkSession
        new = f"{self.path}/new"
        bar_parts(ticks, self.width).write.mode("overwrite").parquet(new)
        parts = spark.read.parquet(new)
        touched = parts.select("symbol").distinct()
        if batch_id > 0:
            parts = spark.read.schema(parts.schema).parquet(self._at(batch_id - 1)).unionByName(parts)
        recent(merged(parts)).write.mode("overwrite").parquet(self._at(batch_id))
        held = spark.read.schema(parts.schema).parquet(self._at(batch_id))
        return newest_alerts(held.join(touched, "symbol", "left_semi"), self.rules)
