"""Direction labels, adaptive thresholds, scaling, class weights and focal parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.expr import argmax_first, band, clip, ratio
from barloom.operators.series import BY_SYMBOL

CLASS_NAMES = {0: "LOW", 1: "NEUTRAL", 2: "HIGH"}


def with_next_return(bars: DataFrame) -> DataFrame:
    nxt = F.lead("close").over(BY_SYMBOL.ordered())
    return bars.withColumn("target_return", ratio(nxt - F.col("close"), "close"))


def classify(ret: Column, upper: Column, lower: Column) -> Column:
    return F.when(ret.isNull(), None).when(ret > upper, 2).when(ret < lower, 0).otherwise(1)


def direction_labels(bars: DataFrame, upper: Column, lower: Column) -> DataFrame:
    """Class of the move to the next bar; null on the last bar."""
    return with_next_return(bars).withColumn("target_class", classify(F.col("target_return"), upper, lower))


def _percentile_thresholds(
    returns: DataFrame, size: Column, ratio_of_size: Column, ratios: list[float], lo: float, hi: float
) -> DataFrame:
    """Per symbol the percentiles 100-50r and 50r of the returns for each candidate r, the
    one the series size asks for, clamped in size to [lo, hi]."""
    probs = sorted({round(1 - r * 0.5, 6) for r in ratios} | {round(r * 0.5, 6) for r in ratios})
    agg = returns.groupBy("symbol").agg(
        F.count("target_return").alias("n_returns"),
        size.alias("size"),
        F.percentile("target_return", probs).alias("pct"),
    )
    agg = agg.withColumn("ratio", ratio_of_size)

    def at(upper: bool) -> Column:
        out = None
        for r in ratios:
            p = round(1 - r * 0.5, 6) if upper else round(r * 0.5, 6)
            value = F.col("pct")[probs.index(p)]
            cond = F.col("ratio") == r
            out = F.when(cond, value) if out is None else out.when(cond, value)
        return out

    return agg.withColumns({"upper": clip(F.abs(at(True)), lo, hi), "lower": -clip(F.abs(at(False)), lo, hi)})


def adaptive_thresholds(labelled: DataFrame) -> DataFrame:
    """Thresholds per symbol from its own returns; below 50 returns +-0.012."""
    # fixed values: share of extreme classes by size, clamp, fallback
    ratio_col = band("size", [(1000, 0.12), (5000, 0.10)], 0.08)
    agg = _percentile_thresholds(labelled, F.count(F.lit(1)), ratio_col, [0.12, 0.10, 0.08], 0.002, 0.030)
    few = F.col("n_returns") < 50
    return agg.select(
        "symbol",
        "n_returns",
        F.when(few, 0.012).otherwise(F.col("upper")).alias("upper"),
        F.when(few, -0.012).otherwise(F.col("lower")).alias("lower"),
    )


def alternate_thresholds(labelled: DataFrame) -> DataFrame:
    """Second threshold rule: four size categories, other clamp and fallbacks."""
    # fixed values: category limits, ratios, clamp, fallbacks
    size = F.col("size")
    category = F.when(size <= 250, "micro").when(size <= 1000, "small").when(size <= 5000, "medium").otherwise("large")
    ratio_col = F.when(size <= 250, 0.5).when(size <= 1000, 0.4).when(size <= 5000, 0.35).otherwise(0.3)
    fallback = F.when(size <= 250, 0.015).when(size <= 1000, 0.010).when(size <= 5000, 0.008).otherwise(0.006)
    agg = _percentile_thresholds(labelled, F.count(F.lit(1)), ratio_col, [0.5, 0.4, 0.35, 0.3], 0.003, 0.025)
    enough = F.col("size") > 50
    return agg.select(
        "symbol",
        category.alias("category"),
        F.when(enough, "adaptive_percentile").otherwise("fallback").alias("method"),
        F.when(enough, F.col("upper")).otherwise(fallback).alias("upper"),
        F.when(enough, F.col("lower")).otherwise(-fallback).alias("lower"),
    )


def adaptive_labels(bars: DataFrame) -> DataFrame:
    """Labels with every symbol's own thresholds."""
    df = with_next_return(bars)
    cuts = adaptive_thresholds(df).select("symbol", "upper", "lower")
    return (
        df.join(cuts, "symbol")
        .withColumn("target_class", classify(F.col("target_return"), F.col("upper"), F.col("lower")))
        .drop("upper", "lower")
    )


# -- scaling and encoding ------------------------------------------------------------


def ranges(df: DataFrame, columns: list[str], fit_on: Column | None = None) -> DataFrame:
    """``min_x`` and ``max_x`` per symbol over the rows where ``fit_on`` holds (default all)."""
    cond = F.lit(True) if fit_on is None else fit_on
    return df.groupBy("symbol").agg(
        *[F.min(F.when(cond, F.col(c))).alias(f"min_{c}") for c in columns],
        *[F.max(F.when(cond, F.col(c))).alias(f"max_{c}") for c in columns],
    )


def min_max(df: DataFrame, columns: list[str], fit_on: Column | None = None, spans: DataFrame | None = None) -> DataFrame:
    """Scale to [0,1] per symbol with ``spans``, ranges found before, or with the range of the rows where ``fit_on``
    holds (default all); a constant column becomes 0.  The ranges stay as ``min_x``/``max_x``."""
    df = df.join(ranges(df, columns, fit_on) if spans is None else spans, "symbol")

    def scaled(c: str) -> Column:
        lo, hi = F.col(f"min_{c}"), F.col(f"max_{c}")
        return F.when(hi == lo, 0.0 * F.col(c)).otherwise(ratio(F.col(c) - lo, hi - lo))

    return df.withColumns({f"scaled_{c}": scaled(c) for c in columns})


def unscale(c: str) -> Column:
    return F.col(f"scaled_{c}") * (F.col(f"max_{c}") - F.col(f"min_{c}")) + F.col(f"min_{c}")


def one_hot(cls: Column, k: int = 3) -> Column:
    return F.array(*[(cls == i).cast("double") for i in range(k)])


def from_one_hot(arr: Column) -> Column:
    """Index of the largest entry, the first one on ties."""
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("int")


# -- class weights and focal parameters ----------------------------------------------


def class_weights(df: DataFrame, strategy: str = "balanced_smooth", smoothing: float = 0.5, key: str = "symbol") -> DataFrame:
    """Weight per class, normalised so the weights add up to the number of classes."""
    counts = df.filter("target_class IS NOT NULL").groupBy(key, "target_class").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(key)
    total, k = F.sum("n").over(w), F.count(F.lit(1)).over(w)
    raw = total / (k * F.col("n"))
    if strategy == "balanced":
        weight = raw
    elif strategy == "inverse":
        weight = total / F.col("n")
    else:
        weight = raw * (1.0 - smoothing) + smoothing
    counts = counts.withColumns({"weight": weight, "k": k})
    return counts.select(
        key, "target_class", "n", (F.col("weight") / F.sum("weight").over(w) * F.col("k")).alias("weight")
    )


def focal_parameters(df: DataFrame, key: str = "symbol") -> DataFrame:
    counts = df.filter("target_class IS NOT NULL").groupBy(key, "target_class").agg(F.count(F.lit(1)).alias("n"))
    agg = counts.groupBy(key).agg((F.max("n").cast("double") / F.min("n")).alias("imbalance"))
    # fixed values: focusing parameter by imbalance
    gamma = band("imbalance", [(2.0, 1.5), (5.0, 2.0), (10.0, 2.5)], 3.0)
    return agg.select(key, "imbalance", F.lit(0.25).alias("alpha"), gamma.alias("gamma"))


def adaptive_focal_parameters(scored: DataFrame, percentile: float = 0.75, key: str = "symbol") -> DataFrame:
    """Focusing parameter by the share of rows below the confidence percentile."""
    conf = F.greatest("p0", "p1", "p2")
    df = scored.select(key, conf.alias("conf"))
    cut = df.groupBy(key).agg(F.percentile("conf", percentile).alias("cut"))
    agg = df.join(cut, key).groupBy(key).agg(F.avg((F.col("conf") < F.col("cut")).cast("double")).alias("hard_share"))
    gamma = band("hard_share", [(0.4, 3.0), (0.2, 2.0)], 1.5, below=False)
    return agg.select(key, "hard_share", F.lit(0.25).alias("alpha"), gamma.alias("gamma"))


def predicted_class() -> Column:
    return argmax_first(["p0", "p1", "p2"])
