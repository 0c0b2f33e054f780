"""Data profile per symbol: missing values, noise, outliers, moments, seasonality,
trend, gaps, stationarity, regime changes, quality and complexity.

Everything is aggregates and windows over bars; a symbol's bars are bounded by the
calendar, which also bounds the exact percentiles taken per symbol.  For columns of
raw tables, where one key may hold a third of all rows, ``exact_quantiles`` finds the
same percentiles from counts per distinct value.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.expr import band, ratio, row_count, row_mean
from barloom.operators.series import by_symbol
from barloom.sources.bars import OHLCV

NUMERIC = list(OHLCV)
EPS = 1e-8


# -- missing values ---------------------------------------------------------------


def missing(df: DataFrame, columns: list[str], key: str = "symbol") -> DataFrame:
    """Share of nulls overall and per column, number of columns with nulls, mean share."""
    agg = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.avg(F.col(c).isNull().cast("double")).alias(f"missing_{c}") for c in columns],
    )
    shares = [F.col(f"missing_{c}") for c in columns]
    return agg.withColumns(
        {
            "missing_ratio": row_mean(shares),
            "columns_with_missing": row_count([s > 0 for s in shares]),
            "avg_missing_ratio": row_mean(shares),
        }
    )


# -- noise ------------------------------------------------------------------------


def noise(bars: DataFrame, columns: list[str] = NUMERIC) -> DataFrame:
    """Mean over the columns of std(diff)/std (population, columns with 10 values or more)."""
    s = by_symbol(bars)
    w = s.frames.ordered()
    df = s.df.withColumns({f"d_{c}": F.col(c) - F.lag(c).over(w) for c in columns})
    agg = df.groupBy("symbol").agg(
        *[
            F.when(F.count(c) >= 10, F.stddev_pop(f"d_{c}") / (F.stddev_pop(c) + EPS)).alias(f"noise_{c}")
            for c in columns
        ]
    )
    agg = agg.withColumn("noise", row_mean([f"noise_{c}" for c in columns]))
    level = F.when(F.col("noise").isNull(), "unknown").otherwise(band("noise", [(0.1, "low"), (0.3, "medium")], "high"))
    return agg.withColumn("noise_level", level)


def return_noise(bars: DataFrame, columns: list[str] = NUMERIC) -> DataFrame:
    """Alternate noise: mean sample deviation of the returns of the columns that hold
    more than 10 values."""
    w = by_symbol(bars).frames.ordered()
    df = bars.withColumns({f"r_{c}": ratio(F.col(c) - F.lag(c).over(w), F.lag(c).over(w)) for c in columns})
    agg = df.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.when(F.count(c) > 10, F.stddev_samp(f"r_{c}")).alias(f"vol_{c}") for c in columns],
    )
    agg = agg.withColumn("avg_volatility", row_mean([f"vol_{c}" for c in columns]))
    level = F.when(F.col("avg_volatility").isNull(), "medium").otherwise(
        band("avg_volatility", [(0.1, "high"), (0.05, "medium")], "low", below=False)
    )
    return agg.withColumn("noise_level", level)


# -- classes ----------------------------------------------------------------------


def class_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if "class" in c.lower() or "target" in c.lower()]


def class_distributions(df: DataFrame, columns: list[str] | None = None, key: str = "symbol") -> DataFrame:
    """Count and percentage per class of every class column, with the column's imbalance, from one pass over the rows."""
    columns = class_columns(df) if columns is None else columns
    cells = [F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("class_value")) for c in columns]
    long = df.select(key, F.explode(F.array(*cells)).alias("_s")).select(key, "_s.*").filter("class_value IS NOT NULL")
    counts = long.groupBy(key, "column_name", "class_value").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(key, "column_name").agg(
        F.sum("n").alias("total"),
        F.count(F.lit(1)).alias("n_classes"),
        (F.max("n").cast("double") / F.min("n")).alias("imbalance"),
    )
    balance = band(
        "imbalance", [(1.5, "balanced"), (3.0, "slightly_imbalanced"), (10.0, "imbalanced")], "severely_imbalanced"
    )
    out = counts.join(totals, [key, "column_name"]).withColumns({"pct": 100.0 * F.col("n") / F.col("total"), "balance": balance})
    return out.drop("total")


def binary_balance(df: DataFrame, column: str, key: str = "symbol") -> DataFrame:
    """Imbalance ratio and the flag "below 3"; a single class counts as 1."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(key, column).agg(F.count(F.lit(1)).alias("n"))
    agg = counts.groupBy(key).agg(
        F.when(F.count(F.lit(1)) > 1, F.max("n").cast("double") / F.min("n")).otherwise(1.0).alias("imbalance")
    )
    return agg.withColumn("is_balanced", F.col("imbalance") < 3.0)


def complexity_factors(profile: DataFrame) -> DataFrame:
    """Count of size < 500, missing > 0.1, noise high, imbalance > 5; 3 or more is high,
    at most 1 low."""
    factors = row_count(
        [F.col("n_rows") < 500, F.col("missing_ratio") > 0.1, F.col("noise_level") == "high", F.col("imbalance") > 5]
    )
    level = F.when(factors >= 3, "high").when(factors <= 1, "low").otherwise("medium")
    return profile.withColumns({"factors": factors, "complexity": level})


# -- outliers and quality ----------------------------------------------------------


def outliers(bars: DataFrame, columns: list[str] = NUMERIC) -> DataFrame:
    """Share of values beyond the Tukey fences per column and their mean."""
    quart = bars.groupBy("symbol").agg(
        *[F.percentile(c, [0.25, 0.75]).alias(f"q_{c}") for c in columns],
        *[F.count(c).alias(f"n_{c}") for c in columns],
    )
    fences = quart.select(
        "symbol",
        *[F.when(F.col(f"n_{c}") > 10, F.col(f"q_{c}")).alias(f"q_{c}") for c in columns],
    )
    df = bars.join(fences, "symbol")

    def beyond(c: str) -> Column:
        q1, q3 = F.col(f"q_{c}")[0], F.col(f"q_{c}")[1]
        iqr = q3 - q1
        out = (F.col(c) < q1 - 1.5 * iqr) | (F.col(c) > q3 + 1.5 * iqr)
        return F.avg(out.cast("double")).alias(f"outlier_{c}")

    agg = df.groupBy("symbol").agg(*[beyond(c) for c in columns])
    agg = agg.withColumn("outlier_ratio", row_mean([f"outlier_{c}" for c in columns]))
    status = F.when(
        F.col("outlier_ratio").isNotNull(), band("outlier_ratio", [(0.05, "low"), (0.15, "moderate")], "high")
    )
    return agg.withColumn("outlier_status", status)


def quality(bars: DataFrame, columns: list[str] = NUMERIC) -> DataFrame:
    """Quality score: mean of the missing, outlier and size scores."""
    base = missing(bars, columns).select("symbol", "n_rows", "missing_ratio")
    out = outliers(bars, columns).select("symbol", "outlier_ratio", "outlier_status")
    df = base.join(out, "symbol", "left")
    m, o, n = F.col("missing_ratio"), F.col("outlier_status"), F.col("n_rows")
    score = (
        band(m, [(0.05, 1.0), (0.15, 0.8), (0.30, 0.6)], 0.3)
        + F.when(o == "low", 1.0).when(o == "moderate", 0.7).otherwise(0.4)
        + F.when(n >= 10000, 1.0).when(n >= 1000, 0.8).when(n >= 100, 0.5).otherwise(0.2)
    ) / 3.0
    return df.withColumns(
        {
            "missing_status": band(m, [(0.05, "excellent"), (0.15, "good"), (0.30, "acceptable")], "poor"),
            "size_adequacy": band(n, [(100, "insufficient"), (1000, "small"), (10000, "adequate")], "large"),
            "quality_score": score,
            "quality": band(score, [(0.8, "high"), (0.6, "medium")], "low", below=False),
        }
    )


def exact_quantiles(df: DataFrame, column: str, probs: list[float], keys: list[str], coarse: int = 32) -> DataFrame:
    """Linear-interpolated quantiles of a column whose keys may be arbitrarily large.

    1. rows become counts per (key, value), merged map-side;
    2. a bounded sketch per key gives ``coarse`` squared bins (a value finds its bin in two
       steps), and counts per bin tell in which bin a wanted rank lies;
    3. only inside those bins are values cumulated, so no task holds a whole key.
    Exact: the sketch only decides how the values are split into bins.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(*keys, F.col(column).cast("double").alias("v")).agg(
        F.count(F.lit(1)).alias("n")
    )
    bins = coarse * coarse
    cuts = counts.groupBy(*keys).agg(
        F.percentile_approx("v", [i / bins for i in range(1, bins)], 10 * bins).alias("cuts")
    )
    every = F.array(*[F.col("cuts")[coarse * k - 1] for k in range(1, coarse)])
    cuts = cuts.withColumn("steps", every)
    # the bin of a value: how many cut points lie below it
    binned = counts.join(cuts, keys).withColumn("b", F.size(F.filter("steps", lambda cut: cut < F.col("v"))) * coarse)
    near = F.slice("cuts", F.col("b") + 1, F.lit(coarse - 1))
    binned = binned.select(*keys, "v", "n", (F.col("b") + F.size(F.filter(near, lambda cut: cut < F.col("v")))).alias("bin"))
    per_bin = binned.groupBy(*keys, "bin").agg(F.sum("n").alias("n_bin"))
    group = Window.partitionBy(*keys)
    upto = F.sum("n_bin").over(group.orderBy("bin"))
    grid = F.array(*[F.lit(float(p)) for p in probs])
    wanted = per_bin.select(
        *keys,
        "bin",
        "n_bin",
        (upto - F.col("n_bin")).alias("before"),
        F.sum("n_bin").over(group).alias("total"),
    ).withColumn("p", F.explode(grid))
    wanted = wanted.withColumn("pos", (F.col("total") - 1) * F.col("p"))

    def inside(rank: Column, lo: str, hi: Column) -> Column:
        return (rank >= F.col(lo)) & (rank < hi)

    low, high = F.floor("pos"), F.ceil("pos")
    bin_end = F.col("before") + F.col("n_bin")
    wanted = wanted.filter(inside(low, "before", bin_end) | inside(high, "before", bin_end))
    ranked = binned.join(wanted.select(*keys, "bin", "before").distinct(), [*keys, "bin"])
    run = Window.partitionBy(*keys, "bin").orderBy("v")
    last = F.sum("n").over(run) + F.col("before")
    ranked = ranked.select(*keys, "bin", "v", last.alias("last"), (last - F.col("n")).alias("first"))
    hit = wanted.select(*keys, "bin", "p", "pos").join(ranked, [*keys, "bin"])

    def at(rank: Column) -> Column:
        return F.max(F.when(inside(rank, "first", F.col("last")), F.col("v")))

    found = hit.groupBy(*keys, "p", "pos").agg(at(low).alias("a"), at(high).alias("b"))
    frac = F.col("pos") - F.floor("pos")
    return found.select(*keys, "p", (F.col("a") + (F.col("b") - F.col("a")) * frac).alias("value"))


# -- column types -----------------------------------------------------------------


def column_types(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Kind of every column: numeric, binary, datetime, high_cardinality, categorical.

    Distinct counts run over one (column, value) table, so a column with many values is
    counted by many tasks; ``approximate=True`` uses one sketch pass instead.
    """
    kinds = {}
    for field in df.schema.fields:
        t = field.dataType.typeName()
        if t in ("byte", "short", "integer", "long", "float", "double", "decimal"):
            kinds[field.name] = "numeric"
        elif t in ("date", "timestamp", "timestamp_ntz"):
            kinds[field.name] = "datetime"
        else:
            kinds[field.name] = "text"
    if approximate:
        row = df.agg(
            *[F.struct(F.approx_count_distinct(c).alias("d"), F.count(c).alias("n")).alias(c) for c in kinds]
        )
        cells = [
            F.struct(
                F.lit(c).alias("column_name"),
                F.col(c).getField("d").alias("n_distinct"),
                F.col(c).getField("n").alias("n_values"),
            )
            for c in kinds
        ]
        long = row.select(F.explode(F.array(*cells)).alias("s")).select("s.*")
    else:
        cells = F.array(
            *[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in kinds]
        )
        values = df.select(F.explode(cells).alias("s")).select("s.*").groupBy("column_name", "v").agg(
            F.count(F.lit(1)).alias("n")
        )
        long = values.groupBy("column_name").agg(
            F.count("v").alias("n_distinct"), F.sum(F.when(F.col("v").isNotNull(), F.col("n")).otherwise(0)).alias("n_values")
        )
    base = F.create_map(*[x for c, k in kinds.items() for x in (F.lit(c), F.lit(k))])[F.col("column_name")]
    kind = (
        F.when((base == "numeric") & (F.col("n_distinct") == 2), "binary")
        .when(base != "text", base)
        .when(F.col("n_distinct") > F.col("n_values") * 0.5, "high_cardinality")
        .otherwise("categorical")
    )
    return long.select("column_name", "n_distinct", "n_values", kind.alias("kind"))


def pairs(columns: list[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]


def complexity(bars: DataFrame, columns: list[str] = NUMERIC, categorical: list[str] = ()) -> DataFrame:
    """Feature/row ratio, share of strongly correlated pairs, categorical cardinality."""
    n_features = len([c for c in bars.columns if c not in ("symbol", "ts")])
    agg = bars.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.corr(a, b).alias(f"corr_{a}_{b}") for a, b in pairs(columns)],
        *[F.countDistinct(c).alias(f"card_{c}") for c in categorical],
    )
    per_row = F.lit(float(n_features)) / F.col("n_rows")
    high = row_count([F.abs(F.col(f"corr_{a}_{b}")) > 0.8 for a, b in pairs(columns)])
    share = high / float(len(pairs(columns)))
    out = {
        "feature_count": F.lit(n_features).cast("long"),
        "feature_row_ratio": per_row,
        "high_corr_ratio": share,
        "redundancy": F.when(share > 0.3, "high").otherwise("low"),
        "complexity": band(per_row, [(0.1, "high"), (0.05, "medium")], "low", below=False),
    }
    if categorical:
        cards = [F.col(f"card_{c}").cast("double") for c in categorical]
        out["avg_cardinality"] = row_mean(cards)
        out["max_cardinality"] = F.greatest(*cards) if len(cards) > 1 else cards[0]
    return agg.withColumns(out)


# -- moments ----------------------------------------------------------------------


def _long(df: DataFrame, columns: list[str], *keep: str) -> DataFrame:
    """One row per (row, column): (symbol, keep.., column_name, v) without nulls."""
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v")) for c in columns])
    return df.select("symbol", *keep, F.explode(cells).alias("s")).select("symbol", *keep, "s.*").filter("v IS NOT NULL")


def moments(bars: DataFrame, columns: list[str] = NUMERIC) -> DataFrame:
    """Moments of the columns with at least 3 values; skew and excess kurtosis
    are the bias-adjusted ones (Spark's own are population moments)."""
    agg = _long(bars, columns).groupBy("symbol", "column_name").agg(
        F.count("v").cast("double").alias("n"),
        F.avg("v").alias("mean"),
        F.stddev_samp("v").alias("std"),
        F.skewness("v").alias("g1"),
        F.kurtosis("v").alias("g2"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
    )
    n = F.col("n")
    skew = F.when(n > 2, F.col("g1") * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))
    kurt = F.when(n > 3, (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)) * ((n + 1) * F.col("g2") + 6.0))
    cv = F.when(F.col("mean") == 0, F.lit(float("inf"))).otherwise(ratio("std", F.abs("mean")))
    return agg.filter(n >= 3).select(
        "symbol",
        "column_name",
        "mean",
        "std",
        skew.alias("skewness"),
        kurt.alias("kurtosis"),
        "min",
        "max",
        (F.col("max") - F.col("min")).alias("range"),
        cv.alias("cv"),
        band(F.abs(skew), [(2.0, "high"), (0.5, "moderate")], "low", below=False).alias("skew_level"),
        band(kurt, [(3.0, "high"), (0.0, "moderate")], "low", below=False).alias("kurtosis_level"),
    )


# -- seasonality, trend, gaps ------------------------------------------------------


def season_effect(bars: DataFrame, season: Column, min_rows: int, limit: float, columns: list[str] = NUMERIC) -> DataFrame:
    """Deviation of the season means over the deviation of all rows.

    Sums, squares and counts per season are enough for both deviations, so the rows are
    read once and only (symbol, column, season) partials are shuffled.
    """
    df = _long(bars.withColumn("season", season), columns, "season")
    per = df.groupBy("symbol", "column_name", "season").agg(
        F.count("v").alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("var")
    )
    w = Window.partitionBy("symbol", "column_name")
    total = F.sum("n").over(w)
    grand = F.sum(F.col("n") * F.col("m")).over(w) / total
    per = per.withColumns({"total": total, "grand": grand})
    agg = per.groupBy("symbol", "column_name").agg(
        F.stddev_samp("m").alias("season_std"),
        F.count(F.lit(1)).alias("seasons"),
        F.max("total").alias("n_rows"),
        F.sum(F.col("n") * (F.col("var") + (F.col("m") - F.col("grand")) * (F.col("m") - F.col("grand")))).alias("ss"),
    )
    agg = agg.filter((F.col("seasons") > 1) & (F.col("n_rows") > min_rows))
    strength = F.col("season_std") / (F.sqrt(F.col("ss") / (F.col("n_rows") - 1)) + EPS)
    out = agg.select("symbol", "column_name", strength.alias("strength"), (strength > limit).alias("significant"))
    by = Window.partitionBy("symbol")
    hits = F.sum(F.col("significant").cast("int")).over(by)
    return out.withColumn("overall", F.when(hits > F.count(F.lit(1)).over(by) * 0.5, "strong").otherwise("weak"))


def weekday_effect(bars: DataFrame, columns: list[str] = NUMERIC) -> DataFrame:
    return season_effect(bars, F.weekday("ts"), 7, 0.1, columns)


def month_effect(bars: DataFrame, columns: list[str] = NUMERIC) -> DataFrame:
    return season_effect(bars, F.month("ts"), 30, 0.05, columns)


def student_p(t: Column, dof: Column) -> Column:
    """Two-sided p of Student's t for whole degrees of freedom, by the finite
    trigonometric series (Abramowitz and Stegun 26.7.3 and 26.7.4)."""
    theta = F.atan(F.abs(t) / F.sqrt(dof))
    cos2 = F.cos(theta) * F.cos(theta)
    odd = dof % 2 == 1
    last = F.floor((dof - 2) / 2).cast("int")
    shift = F.when(odd, 1.0).otherwise(0.0)

    def step(acc, k):
        term = acc.term * cos2 * (2.0 * k - 1.0 + shift) / (2.0 * k + shift)
        return F.struct((acc.total + term).alias("total"), term.alias("term"))

    steps = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    start = F.struct(F.lit(1.0).alias("total"), F.lit(1.0).alias("term"))
    total = F.aggregate(steps, start, step, lambda acc: acc.total)
    inside = (
        F.when(dof == 1, 2.0 / math.pi * theta)
        .when(odd, 2.0 / math.pi * (theta + F.sin(theta) * F.cos(theta) * total))
        .otherwise(F.sin(theta) * total)
    )
    return F.greatest(F.lit(0.0), 1.0 - inside)


def trend(bars: DataFrame, columns: list[str] = NUMERIC) -> DataFrame:
    """Linear trend of the columns on the position among their non-null values
    (symbols over 100 rows, columns with 10 values or more)."""
    n_rows = F.count(F.lit(1)).over(Window.partitionBy("symbol")).alias("n_rows")
    df = _long(bars.select("*", n_rows).filter("n_rows > 100"), columns, "ts")
    x = F.row_number().over(Window.partitionBy("symbol", "column_name").orderBy("ts")) - 1
    df = df.withColumn("x", x.cast("double"))
    agg = df.groupBy("symbol", "column_name").agg(
        F.count("v").alias("n"), F.regr_slope("v", "x").alias("slope"), F.corr("v", "x").alias("r")
    )
    r, dof = F.coalesce(F.col("r"), F.lit(0.0)), F.col("n") - 2
    t = r * F.sqrt(dof / F.nullif(1.0 - r * r, F.lit(0.0)))
    agg = agg.filter("n >= 10").withColumn("p_value", F.coalesce(student_p(t, dof), F.lit(0.0)))
    real = (F.abs(F.col("r")) > 0.3) & (F.col("p_value") < 0.05)
    return agg.select(
        "symbol",
        "column_name",
        "slope",
        "r",
        "p_value",
        F.when(real, F.when(F.col("slope") > 0, "upward").otherwise("downward")).otherwise("none").alias("direction"),
        F.when(real, F.when(F.abs(F.col("r")) > 0.7, "strong").otherwise("moderate")).otherwise("weak").alias("significance"),
    )


def gaps(bars: DataFrame) -> DataFrame:
    """Time steps longer than three times the median step (days; seconds for timestamps)."""
    w = by_symbol(bars).frames.ordered()
    if bars.schema["ts"].dataType.typeName() == "date":
        step = F.datediff("ts", F.lag("ts").over(w)).cast("double")
    else:
        step = F.timestamp_diff("SECOND", F.lag("ts").over(w), F.col("ts")).cast("double")
    df = bars.select("symbol", step.alias("step")).filter("step IS NOT NULL")
    median = df.groupBy("symbol").agg(F.percentile("step", 0.5).alias("median_step"))
    big = F.when(F.col("step") > 3.0 * F.col("median_step"), F.col("step"))
    return (
        df.join(median, "symbol")
        .groupBy("symbol", "median_step")
        .agg(F.count(big).alias("n_gaps"), F.max(big).alias("largest_gap"))
        .withColumn("gaps_detected", F.col("n_gaps") > 0)
    )


# -- stationarity and regimes ------------------------------------------------------
# The window length differs per symbol, so frames run over pos = row / window: one unit
# of pos is one window.  HAIR separates neighbouring rows safely (windows below 5e6).

HAIR = 1e-7


def pos_frame(value: str, fn: str, lo: float, hi: float, keys: str = "symbol") -> Column:
    def bound(x: float) -> str:
        return f"{abs(x)}D {'PRECEDING' if x < 0 else 'FOLLOWING'}"

    return F.expr(f"{fn}({value}) OVER (PARTITION BY {keys} ORDER BY pos RANGE BETWEEN {bound(lo)} AND {bound(hi)})")


def stationarity(bars: DataFrame, columns: list[str] = NUMERIC) -> DataFrame:
    """Stability of rolling means and variances with the window max(10, n // 4).

    Rolling sums are differences of running sums (of centred values), read one window
    back, so the cost does not grow with the window.
    """
    by = ["symbol", "column_name"]
    df = _long(bars, columns, "ts")
    grp = Window.partitionBy(*by)
    rn = F.row_number().over(grp.orderBy("ts"))
    df = df.withColumns(
        {"rn": rn, "n": F.count("v").over(grp), "v": F.col("v") - F.avg("v").over(grp), "_all": F.var_pop("v").over(grp)}
    )
    df = df.withColumn("w", F.greatest(F.lit(10), F.floor(F.col("n") / 4)).cast("long"))
    df = df.withColumn("pos", F.col("rn") / F.col("w"))
    run = grp.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({"s1": F.sum("v").over(run), "s2": F.sum(F.col("v") * F.col("v")).over(run)})
    back = {f"b{i}": pos_frame(f"s{i}", "max", -1.0 - HAIR, -1.0 + HAIR, ", ".join(by)) for i in (1, 2)}
    df = df.withColumns(back).filter((F.col("rn") >= F.col("w")) | (F.col("n") < 20))
    w = F.col("w")
    s1 = F.col("s1") - F.coalesce(F.col("b1"), F.lit(0.0))
    s2 = F.col("s2") - F.coalesce(F.col("b2"), F.lit(0.0))
    var = (s2 - s1 * s1 / w) / (w - 1)
    # a window of equal values has variance 0, not the rounding noise of the running sums
    df = df.withColumns({"m": s1 / w, "var": F.when(var > 1e-10 * F.col("_all"), var).otherwise(0.0)})
    agg = df.groupBy(*by, "n", "w").agg(
        F.regr_slope("m", F.col("rn").cast("double")).alias("slope"),
        F.stddev_pop("m").alias("sd"),
        (F.max("var") / (F.min("var") + EPS)).alias("var_ratio"),
    )
    short = F.col("n") < F.col("w") * 2
    mean_ok = short | (F.abs(F.col("slope")) < 0.1 * F.col("sd"))
    var_ok = short | (F.col("var_ratio") < 4.0)
    verdict = (
        F.when(F.col("n") < 20, "insufficient_data")
        .when(mean_ok & var_ok, "stationary")
        .when(mean_ok | var_ok, "weak_stationary")
        .otherwise("non_stationary")
    )
    out = agg.select(*by, "n", "w", "slope", "sd", "var_ratio", verdict.alias("verdict"))
    sym = Window.partitionBy("symbol")
    tested = F.sum((F.col("n") >= 20).cast("int")).over(sym)
    share = F.sum((F.col("verdict") == "stationary").cast("int")).over(sym) / F.nullif(tested, F.lit(0))
    overall = F.when(tested == 0, "unknown").otherwise(
        band(share, [(0.7, "mostly_stationary"), (0.3, "mixed")], "mostly_non_stationary", below=False)
    )
    return out.withColumn("overall", overall)


def regime_changes(bars: DataFrame) -> DataFrame:
    """Counts of volatility and mean shifts of the returns between the ``w`` rolling
    values before a row and the ``w`` from it on, w = min(20, n // 3)."""
    s = by_symbol(bars.select("symbol", "ts", "close"))
    prev = F.lag("close").over(s.frames.ordered())
    df = s.df.withColumns({"ret": ratio(F.col("close") - prev, prev), "prices": F.count("close").over(s.frames.whole())})
    df = df.filter("ret IS NOT NULL")
    whole = Window.partitionBy("symbol")
    df = df.withColumns(
        {"i": F.row_number().over(whole.orderBy("ts")) - 1, "n": F.count("ret").over(whole)}
    ).filter("n >= 30 AND prices >= 50")
    df = df.withColumn("w", F.least(F.lit(20), F.floor(F.col("n") / 3)).cast("long"))
    df = df.withColumn("pos", F.col("i") / F.col("w"))
    full = F.col("i") >= F.col("w") - 1
    own = (-1.0 + HAIR, HAIR)
    df = df.withColumns(
        {
            "vol": F.when(full, pos_frame("ret", "stddev_samp", *own)),
            "avg": F.when(full, pos_frame("ret", "avg", *own)),
        }
    )
    before, after = (-1.0 - HAIR, -HAIR), (-HAIR, 1.0 - HAIR)
    df = df.withColumns(
        {f"{c}_{k}": pos_frame(c, "avg", *fr) for c in ("vol", "avg") for k, fr in (("b", before), ("a", after))}
    ).filter((F.col("i") >= F.col("w")) & (F.col("i") < F.col("n") - F.col("w")))
    vol_shift = (F.col("vol_b") > 0) & (F.abs(F.col("vol_a") - F.col("vol_b")) > 0.5 * F.col("vol_b"))
    avg_shift = (F.abs(F.col("avg_b")) > 1e-6) & (
        F.abs(F.col("avg_a") - F.col("avg_b")) > 0.3 * F.abs(F.col("avg_b"))
    )
    agg = df.groupBy("symbol", "n").agg(
        F.count(F.when(vol_shift, 1)).alias("vol_changes"), F.count(F.when(avg_shift, 1)).alias("mean_changes")
    )
    total = F.col("vol_changes") + F.col("mean_changes")
    return agg.select(
        "symbol",
        "vol_changes",
        "mean_changes",
        total.alias("total_changes"),
        (100.0 * total / F.col("n")).alias("change_frequency"),
        (total > 0).alias("detected"),
    )


# -- feature relations ---------------------------------------------------------------


def feature_stats(df: DataFrame, features: list[str], key: str = "symbol") -> DataFrame:
    """Per feature: mean, std, min, max on the complete rows, missing share on all rows."""
    complete = F.lit(True)
    for f in features:
        complete = complete & F.col(f).isNotNull()
    cells = F.array(
        *[
            F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v"), complete.alias("complete"))
            for f in features
        ]
    )
    long = df.select(key, F.explode(cells).alias("s")).select(key, "s.*")
    v = F.when(F.col("complete"), F.col("v"))
    return long.groupBy(key, "feature").agg(
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.avg(F.col("v").isNull().cast("double")).alias("missing_ratio"),
    )


def correlations(df: DataFrame, features: list[str], key: str = "symbol") -> DataFrame:
    """Upper triangle of the correlation matrix as (key, feature_a, feature_b, corr), from
    one aggregate over the complete rows."""
    agg = df.na.drop(subset=features).groupBy(key).agg(
        *[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs(features)]
    )
    cells = F.array(
        *[
            F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col(f"`{a}|{b}`").alias("corr"))
            for a, b in pairs(features)
        ]
    )
    return agg.select(key, F.explode(cells).alias("s")).select(key, "s.*")


def target_correlations(df: DataFrame, features: list[str], target: str, key: str = "symbol") -> DataFrame:
    """Correlation of every feature with the target on their common rows; none counts as 0."""
    agg = df.groupBy(key).agg(*[F.coalesce(F.corr(f, target), F.lit(0.0)).alias(f) for f in features])
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("corr")) for f in features])
    return agg.select(key, F.explode(cells).alias("s")).select(key, "s.*")


# -- full profile --------------------------------------------------------------------


def full_profile(bars: DataFrame) -> DataFrame:
    """One record per symbol with the result of every family above: ``class_balance`` holds every class column of
    ``bars`` (null without one), ``column_types`` the kinds of the table's columns.  The families read ``bars``
    one after the other, so it should be a stored table.
    """
    q = quality(bars)
    if classes := class_columns(bars):
        q = q.join(_per_symbol(class_distributions(bars, classes), "class_balance"), "symbol", "left")
    else:
        q = q.withColumn("class_balance", F.lit(None).cast("string"))
    kinds = column_types(bars)
    # one row: a scalar, no join
    q = q.withColumn("column_types", kinds.agg(F.sort_array(F.collect_list(F.struct(*kinds.columns)))).scalar())
    parts = [
        noise(bars).select("symbol", "noise_level"),
        _per_symbol(stationarity(bars).select("symbol", "column_name", "verdict", "overall"), "stationarity"),
        _per_symbol(moments(bars), "moments"),
        _per_symbol(weekday_effect(bars), "weekday_effect"),
        _per_symbol(month_effect(bars), "month_effect"),
        _per_symbol(trend(bars), "trends"),
        _struct(gaps(bars), "gaps"),
        _struct(complexity(bars), "complexity"),
        _struct(regime_changes(bars), "regimes"),
    ]
    for part in parts:
        q = q.join(part, "symbol", "left")
    return q


def _struct(df: DataFrame, name: str) -> DataFrame:
    return df.select("symbol", F.struct(*[c for c in df.columns if c != "symbol"]).alias(name))


def _per_symbol(df: DataFrame, name: str) -> DataFrame:
    """Collect the few per-column records of a symbol (one per profiled column)."""
    return df.groupBy("symbol").agg(
        F.sort_array(F.collect_list(F.struct(*[c for c in df.columns if c != "symbol"]))).alias(name)
    )
