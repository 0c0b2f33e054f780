"""Price scenarios per symbol: parameters, gates, paths, statistics, class
probabilities and the blend with a model's probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.expr import argmax_first, band, clip, ratio, safe_ln
from barloom.operators.series import BY_SYMBOL

# fixed values: limits of a request, accepted periods
MAX_DAYS, MAX_SIMS = 1000, 10_000
PERIODS = ["7d", "1mo", "3mo", "6mo", "1y", "2y", "5y", "10y", "max"]
MODEL_WEIGHT, SCENARIO_WEIGHT, ACCEPT = 0.7, 0.3, 0.6


def parameters(bars: DataFrame) -> DataFrame:
    """Mean and sample deviation of the log returns, last close, rows; symbols with fewer
    than two prices have none."""
    prices = bars.filter("close IS NOT NULL")
    ret = safe_ln(ratio("close", F.lag("close").over(BY_SYMBOL.ordered())))
    agg = prices.select("symbol", "ts", "close", ret.alias("r")).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("r").alias("mu"),
        F.stddev_samp("r").alias("sigma"),
        F.max_by("close", "ts").alias("s0"),
    )
    return agg.filter("n >= 2")


def request_error(period: Column, days: Column, sims: Column) -> Column:
    """Why a request is refused, null if it is fine."""
    return (
        F.when(~period.isin(PERIODS), "invalid period")
        .when(days <= 0, "days must be positive")
        .when(days > MAX_DAYS, "days above 1000")
        .when(sims <= 0, "simulations must be positive")
        .when(sims > MAX_SIMS, "simulations above 10000")
    )


def history_error(bars: DataFrame) -> DataFrame:
    """Per symbol why its history is refused, null if it is fine."""
    agg = bars.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("close").alias("n_prices"), F.min("close").alias("lowest")
    )
    reason = (
        F.when(F.col("n_rows") < 30, "fewer than 30 rows")
        .when(F.col("n_prices") < 0.8 * F.col("n_rows"), "too many missing prices")
        .when(F.col("lowest") <= 0, "price not positive")
    )
    return agg.select("symbol", "n_rows", "n_prices", reason.alias("reason"))


def _starts(bars: DataFrame, days: int, *extra: Column) -> DataFrame:
    """Every priced bar of a symbol as the start of a stretch: its number ``sim``, the symbol's rows ``n`` and last
    close ``s0``."""
    if not 0 < days <= MAX_DAYS:
        raise ValueError("days must be 1..1000")
    whole = BY_SYMBOL.whole()
    return bars.filter("close IS NOT NULL").select(
        "symbol",
        (F.row_number().over(BY_SYMBOL.ordered()) - 1).cast("int").alias("sim"),
        F.count(F.lit(1)).over(whole).alias("n"),
        F.max_by("close", "ts").over(whole).alias("s0"),
        *extra,
    )


def paths(bars: DataFrame, days: int) -> DataFrame:
    """Scenario table (symbol, sim, day, price): every stretch of ``days`` bars of the symbol's own history, moved to
    its last close, which is day 0.  Symbols without so many bars have none."""
    ahead = F.collect_list("close").over(BY_SYMBOL.ordered().rowsBetween(0, days))
    rows = _starts(bars, days, ahead.alias("x")).filter(F.size("x") == days + 1)
    rows = rows.select("symbol", "sim", "s0", F.col("x")[0].alias("start"), F.posexplode("x").alias("day", "close"))
    return rows.select("symbol", "sim", "day", ratio(F.col("s0") * F.col("close"), "start").alias("price"))


def final_prices(bars: DataFrame, days: int) -> DataFrame:
    """Last day's price of every path only, without its other days."""
    later = F.lead("close", days).over(BY_SYMBOL.ordered())
    rows = _starts(bars, days, F.col("close").alias("start"), later.alias("later")).filter("later IS NOT NULL")
    return rows.select("symbol", "sim", "n", "s0", ratio(F.col("s0") * F.col("later"), "start").alias("final"))


STATS = ["start", "mean", "median", "min", "max", "std", "p5", "p95", "expected_return_pct", "cv"]


def statistics(finals: DataFrame) -> DataFrame:
    """Statistics of the final prices (at most one per bar of the symbol)."""
    agg = finals.groupBy("symbol").agg(
        F.first("s0").alias("start"),
        F.avg("final").alias("mean"),
        F.percentile("final", [0.5, 0.05, 0.95]).alias("pct"),
        F.min("final").alias("min"),
        F.max("final").alias("max"),
        F.stddev_pop("final").alias("std"),
        F.avg((F.col("final") > F.col("s0")).cast("double")).alias("share_up"),
    )
    return agg.select(
        "symbol",
        "start",
        "mean",
        F.col("pct")[0].alias("median"),
        "min",
        "max",
        "std",
        F.col("pct")[1].alias("p5"),
        F.col("pct")[2].alias("p95"),
        (100.0 * (ratio("mean", "start") - 1.0)).alias("expected_return_pct"),
        ratio("std", "mean").alias("cv"),
        "share_up",
    )


def risk_report(stats: DataFrame) -> DataFrame:
    return stats.select(
        "symbol",
        F.round("expected_return_pct", 2).alias("expected_return_pct"),
        band("cv", [(0.1, "low"), (0.3, "moderate")], "high").alias("risk"),
        F.round(100.0 * F.col("share_up"), 1).alias("profit_probability_pct"),
        F.round("p5", 2).alias("band_low"),
        F.round("p95", 2).alias("band_high"),
    )


def class_probabilities(finals: DataFrame) -> DataFrame:
    """Shares of the paths' returns below, between and above the adaptive thresholds of
    those returns; the share of extreme classes goes by the length of the history."""
    df = finals.select("symbol", "n", ratio(F.col("final") - F.col("s0"), "s0").alias("ret"))
    probs = [0.06, 0.05, 0.04, 0.94, 0.95, 0.96]
    agg = df.groupBy("symbol").agg(
        F.count("ret").alias("n_ret"), F.first("n").alias("n"), F.percentile("ret", probs).alias("q")
    )
    i = F.when(F.col("n") < 1000, 0).when(F.col("n") < 5000, 1).otherwise(2)
    few = F.col("n_ret") < 50
    cuts = agg.select(
        "symbol",
        F.when(few, 0.012).otherwise(clip(F.abs(F.get("q", i + 3)), 0.002, 0.030)).alias("upper"),
        F.when(few, -0.012).otherwise(-clip(F.abs(F.get("q", i)), 0.002, 0.030)).alias("lower"),
    )
    out = df.join(cuts, "symbol").groupBy("symbol", "upper", "lower").agg(
        F.avg((F.col("ret") < F.col("lower")).cast("double")).alias("s0"),
        F.avg((F.col("ret") > F.col("upper")).cast("double")).alias("s2"),
    )
    return out.withColumn("s1", 1.0 - F.col("s0") - F.col("s2"))


def blend(model: DataFrame, scenario: DataFrame) -> DataFrame:
    """0.7 model + 0.3 scenario, its class, and whether it is sure enough."""
    df = model.join(scenario.select("symbol", "s0", "s1", "s2"), "symbol", "left")
    df = df.withColumns({f"b{i}": MODEL_WEIGHT * F.col(f"p{i}") + SCENARIO_WEIGHT * F.col(f"s{i}") for i in range(3)})
    top = F.greatest("b0", "b1", "b2")
    return df.withColumns(
        {"blend_class": argmax_first(["b0", "b1", "b2"]), "blend_confidence": top, "accepted": top >= ACCEPT}
    )


def final_pick(blended: DataFrame) -> DataFrame:
    """The blend where it is accepted, else the model; ``model_only`` without a scenario."""
    ok = F.coalesce(F.col("accepted"), F.lit(False))
    model_class = argmax_first(["p0", "p1", "p2"])
    return blended.select(
        "symbol",
        F.when(ok, F.col("blend_class")).otherwise(model_class).alias("final_class"),
        *[F.when(ok, F.col(f"b{i}")).otherwise(F.col(f"p{i}")).alias(f"f{i}") for i in range(3)],
        F.when(F.col("b0").isNull(), "model_only").when(ok, "ensemble").otherwise("model").alias("method"),
    )
