"""Augmented replicas of labelled series.

Random numbers are keyed draws (``hash_normal``), so a replica is the same on every
run, partitioning and retry.  A replica keeps the labels of its source rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.expr import c, clip, hash_normal, hash_uniform
from barloom.operators.series import by_symbol

LABELS = ("target_class", "target_return")
UNWARPED = LABELS + ("day_of_week", "month", "volume")

# fixed values: noise share, warp deviation, inner knots, technique probabilities
NOISE = 0.008
SIGMA = 0.15
KNOTS = 3
PROBABILITY = {"jitter": 1.0, "time_warp": 0.7, "magnitude_warp": 0.5}


def multiplier(n: Column) -> Column:
    return F.when(n < 1000, 3).when(n < 5000, 2).otherwise(1)


def alternate_multiplier(n: Column, min_class_share: Column) -> Column:
    """1000/n within [1.5, 4], times 1.3 when a class holds under 15%; none from 2000 rows."""
    base = F.greatest(F.lit(1.5), F.least(F.lit(4.0), 1000.0 / n))
    lifted = F.when(min_class_share < 0.15, base * 1.3).otherwise(base)
    return F.when(n < 2000, F.round(lifted, 1))


def policy(df: DataFrame, least: int = 1) -> DataFrame:
    """Per symbol: rows, multiplier, number of replicas, alternate multiplier.  A symbol gets one replica less than its
    multiplier and ``least`` at any size; under ten rows it gets none."""
    per_class = df.groupBy("symbol", "target_class").agg(F.count(F.lit(1)).alias("n"))
    classed = F.col("target_class").isNotNull()
    agg = per_class.groupBy("symbol").agg(
        F.sum("n").alias("n_rows"),
        (F.min(F.when(classed, F.col("n"))) / F.sum(F.when(classed, F.col("n")))).alias("min_class_share"),
    )
    m = multiplier(F.col("n_rows"))
    return agg.select(
        "symbol",
        "n_rows",
        m.alias("multiplier"),
        F.when(F.col("n_rows") >= 10, F.greatest(m - 1, F.lit(least))).otherwise(0).alias("replicas"),
        alternate_multiplier(F.col("n_rows"), F.col("min_class_share")).alias("alternate_multiplier"),
    )


def _plan(df: DataFrame, replicas: Column | int, columns: list[str] = (), only: str | None = None) -> DataFrame:
    """One row per (symbol, replica 1..k) with the symbol's row count and deviations: the
    random curves are drawn here, once per replica, not once per row.  ``only`` keeps the
    replicas that draw this technique, before any row is copied."""
    k = F.lit(replicas) if isinstance(replicas, int) else F.max(replicas)
    agg = df.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), k.alias("_k"), *[F.stddev_pop(x).alias(f"sd_{x}") for x in columns]
    )
    made = agg.filter("_k > 0").withColumn("replica", F.explode(F.sequence(F.lit(1), F.col("_k").cast("int")))).drop("_k")
    return made if only is None else made.filter(technique() == only)


def jitter(df: DataFrame, columns: list[str], replicas: Column | int = 1, noise: float = NOISE, only: str | None = None) -> DataFrame:
    """Normal noise with ``noise`` times the column's population deviation; a volume that
    would turn negative anywhere in a replica is taken absolute."""
    columns = [x for x in columns if x not in LABELS]
    rows = df.join(_plan(df, replicas, columns, only), "symbol")

    def shaken(x: str) -> Column:
        z = hash_normal("symbol", "replica", "ts", F.lit(f"jitter-{x}"))
        y = c(x) + F.coalesce(F.col(f"sd_{x}"), F.lit(0.0)) * noise * z
        return F.abs(y) if x == "volume" else y

    return rows.withColumns({x: shaken(x) for x in columns}).drop("n", *[f"sd_{x}" for x in columns])


def with_spline(plan: DataFrame, values: list[Column]) -> DataFrame:
    """Add the values ``_y`` and second derivatives ``_m`` of the not-a-knot cubic spline
    through five values at 0, 1, 2, 3, 4.

    Not-a-knot merges the first two and the last two pieces: m0 = 2 m1 - m2 and
    m4 = 2 m3 - m2.  The rows of m[i-1] + 4 m[i] + m[i+1] = 6 d[i], d the second
    differences, then give m1 = d1, m3 = d3 and m2 = (6 d2 - d1 - d3) / 4.
    """
    plan = plan.withColumn("_y", F.array(*values))
    y = [F.col("_y")[i] for i in range(5)]
    d1, d2, d3 = (y[i - 1] - 2.0 * y[i] + y[i + 1] for i in (1, 2, 3))
    plan = plan.withColumns({"_m1": d1, "_m2": (6.0 * d2 - d1 - d3) / 4.0, "_m3": d3})
    m1, m2, m3 = F.col("_m1"), F.col("_m2"), F.col("_m3")
    return plan.withColumn("_m", F.array(2.0 * m1 - m2, m1, m2, m3, 2.0 * m3 - m2)).drop("_m1", "_m2", "_m3")


def spline_at(t: Column) -> Column:
    """Value of the row's spline at t in [0, 4]."""
    i = F.least(F.lit(3), F.greatest(F.lit(0), F.floor(t).cast("int")))
    a, b = (i + 1) - t, t - i
    m0, m1 = F.get("_m", i), F.get("_m", i + 1)
    return (m0 * a * a * a + m1 * b * b * b) / 6.0 + (F.get("_y", i) - m0 / 6.0) * a + (F.get("_y", i + 1) - m1 / 6.0) * b


def _knots(kind: str, sigma: float) -> list[Column]:
    return [
        clip(1.0 + sigma * hash_normal("symbol", "replica", F.lit(f"{kind}-{i}")), 0.5, 2.0) for i in range(KNOTS + 2)
    ]


def magnitude_warp(df: DataFrame, columns: list[str], replicas: Column | int = 1, sigma: float = SIGMA, only: str | None = None) -> DataFrame:
    """Multiply by a smooth random curve within [0.5, 2]; labels, calendar and volume stay.
    Symbols under ten rows are returned unchanged (the policy makes no replica of them)."""
    plan = with_spline(_plan(df, replicas, only=only), _knots("magnitude", sigma))
    rows = by_symbol(df).df.join(plan, "symbol")
    rows = rows.withColumn("_t", F.col("rn") * (KNOTS + 1.0) / F.greatest(F.col("n") - 1, F.lit(1)))
    rows = rows.withColumn("_mult", F.when(F.col("n") >= 10, clip(spline_at(F.col("_t")), 0.5, 2.0)).otherwise(1.0))
    warped = {x: c(x) * F.col("_mult") for x in columns if x not in UNWARPED}
    return rows.withColumns(warped).drop("_t", "_mult", "_y", "_m", "rn", "n")


def time_warp(df: DataFrame, columns: list[str], replicas: Column | int = 1, sigma: float = SIGMA, only: str | None = None) -> DataFrame:
    """Read every column at a smoothly shifted position, between rows by straight lines.

    The shifted position is a column of the row; the two source rows it lies between come
    by one equi-join on (symbol, row), for which each row carries its successor.
    """
    values = [x for x in columns if x not in LABELS]
    s = by_symbol(df)
    curve = [float(i) * k for i, k in enumerate(_knots("time", sigma))]
    rows = s.df.join(with_spline(_plan(df, replicas, only=only), curve), "symbol")
    rows = rows.withColumn("_span", F.greatest(F.lit(1), F.col("n") - 1) / (KNOTS + 1.0))
    rows = rows.withColumn("_t", F.col("rn") / F.col("_span"))
    at = F.greatest(F.lit(0.0), F.least(F.col("n") - 1.0, spline_at(F.col("_t")) * F.col("_span")))
    rows = rows.withColumn("_at", F.when(F.col("n") >= 10, at).otherwise(F.col("rn").cast("double")))
    rows = rows.withColumn("_lo", F.floor("_at").cast("int"))
    nxt = {f"_hi_{x}": F.coalesce(F.lead(x).over(s.frames.ordered()), F.col(x)) for x in values}
    source = s.with_columns(nxt).df.select(
        "symbol", F.col("rn").alias("_lo"), *[F.col(x).alias(f"_lo_{x}") for x in values], *nxt
    )
    rows = rows.join(source, ["symbol", "_lo"])
    frac = F.col("_at") - F.col("_lo")
    mixed = {x: F.col(f"_lo_{x}") + (F.col(f"_hi_{x}") - F.col(f"_lo_{x}")) * frac for x in values}
    scratch = ["_at", "_lo", "_t", "_span", "_y", "_m", "rn", "n", *[f"_{k}_{x}" for k in ("lo", "hi") for x in values]]
    return rows.withColumns(mixed).drop(*scratch)


def technique() -> Column:
    """One technique per (symbol, replica): each is available with its probability, and one
    of the available is drawn evenly (jitter always is)."""
    u = lambda what: hash_uniform("symbol", "replica", F.lit(what))
    others = F.filter(
        F.array(
            *[F.when(u(f"use-{name}") < p, F.lit(name)) for name, p in PROBABILITY.items()],
        ),
        lambda x: x.isNotNull(),
    )
    pick = F.least(F.size(others) - 1, F.floor(u("pick") * F.size(others)).cast("int"))
    return F.get(others, pick)


def augment(df: DataFrame, columns: list[str], least: int = 1) -> DataFrame:
    """Originals (replica 0) and the replicas the policy asks for, each by its technique."""
    plan = policy(df, least).select("symbol", "replicas")
    df = df.join(plan, "symbol")
    made = None
    for name, fn in (("jitter", jitter), ("time_warp", time_warp), ("magnitude_warp", magnitude_warp)):
        rows = fn(df, columns, F.col("replicas"), only=name).withColumn("technique", F.lit(name))
        made = rows if made is None else made.unionByName(rows)
    originals = df.withColumns({"replica": F.lit(0), "technique": F.lit("none")})
    return originals.unionByName(made).drop("replicas")


def replica_checks(augmented: DataFrame, columns: list[str]) -> DataFrame:
    """Per (symbol, replica): length equals the original's, every column at most 10% null
    and without infinities."""
    inf = float("inf")
    agg = augmented.groupBy("symbol", "replica").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(F.col(x).isNull().cast("double")).alias(f"null_{x}") for x in columns],
        *[F.max(F.coalesce(F.abs(F.col(x)) == inf, F.lit(False))).alias(f"inf_{x}") for x in columns],
    )
    size = agg.filter("replica = 0").select("symbol", F.col("n").alias("n0"))
    ok = F.col("n") == F.col("n0")
    for x in columns:
        ok = ok & (F.col(f"null_{x}") <= 0.1) & ~F.col(f"inf_{x}")
    return agg.join(size, "symbol").select("symbol", "replica", "n", ok.alias("valid"))


def set_checks(augmented: DataFrame, columns: list[str], tolerance: float = 0.3) -> DataFrame:
    """Per symbol and column: mean and deviation of the whole set within 30% of the
    original deviation, no null or infinite value."""
    cells = F.array(*[F.struct(F.lit(x).alias("column_name"), F.col(x).cast("double").alias("v")) for x in columns])
    long = augmented.select("symbol", "replica", F.explode(cells).alias("s")).select("symbol", "replica", "s.*")
    v0 = F.when(F.col("replica") == 0, F.col("v"))
    agg = long.groupBy("symbol", "column_name").agg(
        F.avg(v0).alias("m0"),
        F.stddev_pop(v0).alias("s0"),
        F.avg("v").alias("m"),
        F.stddev_pop("v").alias("s"),
        F.max((F.col("v").isNull() | (F.abs(F.col("v")) == float("inf"))).cast("int")).alias("bad"),
        (F.max("replica") > 0).alias("grown"),
    )
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= tolerance * F.col("s0")
    valid = F.col("grown") & near("m", "m0") & near("s", "s0") & (F.col("bad") == 0)
    return agg.select("symbol", "column_name", "m0", "s0", "m", "s", valid.alias("valid"))
