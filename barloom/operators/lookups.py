"""Latest values, quotes, watchlists, search, joins with small dimensions, top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.expr import ratio
from barloom.operators.series import by_symbol, fill_gaps, last_rows


def day_change(now: Column, prev: Column) -> dict[str, Column]:
    """Absolute and percent change; the quote form gives 0 percent at a zero previous
    close, the formatted form gives none."""
    diff = now - prev
    return {
        "change": diff,
        "change_pct": F.when(prev == 0, 0.0).otherwise(100.0 * ratio(diff, prev)),
        "change_pct_or_null": 100.0 * ratio(diff, prev),
    }


def last_two(bars: DataFrame) -> DataFrame:
    """The two newest bars per symbol as ``last`` and ``prev`` structs.

    The ``place <= 2`` filter becomes a group limit ahead of the shuffle, so each task
    sends two rows per symbol, not the history.
    """
    row = F.struct("ts", "open", "high", "low", "close", "volume")
    at = lambda k: F.max(F.when(F.col("place") == k, row))
    return last_rows(bars, 2).groupBy("symbol").agg(at(1).alias("last"), at(2).alias("prev"))


def quote_from_history(bars: DataFrame) -> DataFrame:
    """Quote built from the last two bars; symbols with fewer, or with a null close in
    either, have none."""
    df = last_two(bars).filter("last.close IS NOT NULL AND prev.close IS NOT NULL")
    ch = day_change(F.col("last.close"), F.col("prev.close"))
    return df.select(
        "symbol",
        F.col("last.ts").alias("ts"),
        F.col("last.close").alias("price"),
        ch["change"].alias("change"),
        ch["change_pct"].alias("change_pct"),
        F.col("last.open").alias("open"),
        F.col("last.high").alias("high"),
        F.col("last.low").alias("low"),
        F.col("prev.close").alias("prev_close"),
        F.col("last.volume").cast("long").alias("volume"),
    )


def latest_positive(rates: DataFrame, key: str = "series_id", order: str = "date", value: str = "value") -> DataFrame:
    """Newest value above zero per series."""
    return rates.filter(F.col(value) > 0).groupBy(key).agg(
        F.max(order).alias(order), F.max_by(value, order).alias(value)
    )


def latest_value(points: DataFrame, meta: DataFrame) -> DataFrame:
    """Newest row per series with name and unit of the series dimension."""
    last = points.groupBy("series_id").agg(F.max("date").alias("date"), F.max_by("value", "date").alias("value"))
    return last.join(meta, "series_id", "left")


def search_symbols(directory: DataFrame, term: str, n: int = 10) -> DataFrame:
    """Case-insensitive substring search on symbol and name; the first n by symbol.
    ``orderBy().limit()`` runs as a per-partition top-n."""
    t = term.lower()
    hit = F.lower("symbol").contains(t) | F.lower("name").contains(t)
    return directory.filter(hit).orderBy("symbol").limit(n)


def watchlist(rows: DataFrame, defaults: DataFrame) -> DataFrame:
    """Watch symbols by kind; a kind without any row takes its defaults."""
    missing = defaults.join(rows.select("kind").distinct(), "kind", "left_anti")
    return rows.select("symbol", "kind").unionByName(missing.select("symbol", "kind"))


def join_regressors(future: DataFrame, regressors: DataFrame, names: list[str]) -> DataFrame:
    """Left join of regressors on (symbol, ts), then forward and backward fill; symbols
    that still have a null afterwards are marked not ``usable``."""
    df = future.join(regressors.select("symbol", "ts", *names), ["symbol", "ts"], "left")
    s = fill_gaps(by_symbol(df), names)
    gap = F.lit(False)
    for n in names:
        gap = gap | F.col(n).isNull()
    return s.df.drop("rn").withColumn("usable", ~F.max(gap).over(s.frames.whole()))


def with_benchmark_return(bars: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Return of a market index on the same date, 0 where it has none.  The index is one
    row per date; whether it is broadcast is left to the optimiser, which knows its size."""
    w = Window.partitionBy("symbol").orderBy("ts")
    prev = F.lag("close").over(w)
    ret = benchmark.select("ts", ratio(F.col("close") - prev, prev).alias("benchmark_return"))
    out = bars.join(ret, "ts", "left")
    return out.withColumn("benchmark_return", F.coalesce("benchmark_return", F.lit(0.0)))


def parameter_grid(df: DataFrame) -> DataFrame:
    """Every row with each of the 63 (fast, slow) pairs, fast 5..30 and slow 10..70 by 5,
    fast below slow.  The pairs are one constant array, exploded where the row is."""
    pairs = F.array(
        *[
            F.struct(F.lit(a).alias("n1"), F.lit(b).alias("n2"))
            for a in range(5, 31, 5)
            for b in range(10, 71, 5)
            if a < b
        ]
    )
    return df.withColumn("g", F.explode(pairs)).select(*df.columns, "g.n1", "g.n2")


def top_features(scores: DataFrame, max_k: int, min_k: int = 4, share: float = 0.8, key: str = "symbol") -> DataFrame:
    """The best features by score, ``min(max_k, int(share * p))`` of them but at least
    ``min_k``; input position breaks ties."""
    w = Window.partitionBy(key)
    k = F.greatest(F.lit(min_k), F.least(F.lit(max_k), F.floor(F.count(F.lit(1)).over(w) * share)))
    place = F.row_number().over(w.orderBy(F.desc("score"), "position"))
    return scores.withColumns({"place": place, "k": k}).filter("place <= k").drop("k")


def best_of_grid(grid: DataFrame, metric: str, order: str, keys: list[str], columns: list[str]) -> DataFrame:
    """Row with the highest metric per key; the first in grid order wins ties."""
    best = F.max_by(F.struct(metric, order, *columns), F.struct(F.col(metric), -F.col(order)))
    return grid.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def median_path(paths: DataFrame) -> DataFrame:
    """The path per symbol whose final price has rank n // 2.

    Only the final prices (one per path) are ranked; the paths come by semi join.
    """
    final = paths.groupBy("symbol", "sim").agg(F.max_by("price", "day").alias("final"))
    w = Window.partitionBy("symbol")
    place = F.row_number().over(w.orderBy("final", "sim")) - 1
    mid = final.withColumns({"place": place, "mid": F.floor(F.count(F.lit(1)).over(w) / 2)}).filter("place = mid")
    return paths.join(mid.select("symbol", "sim"), ["symbol", "sim"], "left_semi")


def thin_paths(paths: DataFrame, at_most: int = 50) -> DataFrame:
    """Every (n // 50)-th of a symbol's n paths, 50 at most."""
    step = F.greatest(F.lit(1), F.floor((F.max("sim") + 1) / at_most)).alias("_step")
    steps = paths.groupBy("symbol").agg(step)
    kept = (F.col("sim") % F.col("_step") == 0) & (F.col("sim") < F.col("_step") * at_most)
    return paths.join(steps, "symbol").filter(kept).drop("_step")


def axis_ticks(df: DataFrame, n: int = 10, order: str = "ts", key: str = "symbol") -> DataFrame:
    """About n evenly spaced rows per symbol for an axis."""
    s = by_symbol(df, (key,), (order,))
    step = F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(s.frames.whole()) / n))
    return s.df.withColumn("_step", step).filter("rn % _step = 0").drop("rn", "_step")
