"""Moving-average cross: signals, backtest and grid search as window expressions.

A signal at a close fills at the next open; the position is the whole equity, long or
short; commission is taken per side of every change; units are fractional.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.expr import ratio
from barloom.operators.indicators import sma
from barloom.operators.lookups import best_of_grid, parameter_grid
from barloom.operators.series import Frames, by_symbol

CAPITAL = 100_000.0
COMMISSION = 0.002

STATS = [
    "final_equity",
    "return_pct",
    "buy_hold_pct",
    "max_drawdown_pct",
    "n_trades",
    "win_rate_pct",
    "profit_factor",
    "avg_trade_pct",
    "sharpe",
    "sortino",
]


def cross_signal(f: Frames, fast: Column, slow: Column) -> Column:
    """+1 when fast passes above slow, -1 when below (strict on both bars), else 0."""
    side = F.signum(fast - slow)
    prev = F.lag(side).over(f.ordered())
    return F.when((prev == -1) & (side == 1), 1).when((prev == 1) & (side == -1), -1).otherwise(0)


def sma_cross(bars: DataFrame, n1: int = 10, n2: int = 30) -> DataFrame:
    s = by_symbol(bars)
    s = s.with_columns({"fast": sma(s.frames, n1), "slow": sma(s.frames, n2)})
    return s.with_columns({"signal": cross_signal(s.frames, F.col("fast"), F.col("slow"))}).df


def equity_curve(signals: DataFrame, keys: tuple[str, ...] = ("symbol",), commission: float = COMMISSION) -> DataFrame:
    """Position, growth factor and equity per bar from ``signal``.

    The equity is the running product of the bars' growth factors (as a running sum of
    logarithms); once a factor is not positive the account is ruined and stays at 0.
    """
    f = Frames(keys, ("rn",))
    w, first = f.ordered(), Window.unboundedPreceding
    turn = F.when(F.col("signal") != 0, F.col("signal"))
    # the signal of a close is held from the next open on
    df = signals.withColumns(
        {
            "position": F.coalesce(F.last(turn, ignorenulls=True).over(f.between(first, -1)), F.lit(0)),
            "_before": F.coalesce(F.last(turn, ignorenulls=True).over(f.between(first, -2)), F.lit(0)),
            "_pc": F.coalesce(F.lag("close").over(w), F.col("open")),
        }
    )
    change = F.abs(F.col("position") - F.col("_before"))
    df = df.withColumns(
        {
            "_overnight": 1.0 + F.col("_before") * ratio(F.col("open") - F.col("_pc"), "_pc"),
            "_own": (1.0 - commission * change) * (1.0 + F.col("position") * ratio(F.col("close") - F.col("open"), "open")),
            "_turned": (change > 0).cast("int"),
        }
    )
    growth = F.col("_overnight") * F.col("_own")
    ruined = F.max((growth <= 0).cast("int")).over(f.running()) == 1
    logs = F.sum(F.when(growth > 0, F.ln(growth)).otherwise(0.0)).over(f.running())
    df = df.withColumns(
        {
            "equity": F.when(ruined, 0.0).otherwise(CAPITAL * F.exp(logs)),
            "_run": F.sum("_turned").over(f.running()),
            "_next_overnight": F.when(F.lead("_turned").over(w) == 1, F.lead("_overnight").over(w)).otherwise(1.0),
        }
    )
    return df.drop("_pc")


def backtest_stats(curve: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """One row of statistics per key; the curve's partitioning by key is reused.

    A trade is a maximal run of one non-zero position.  It opens with the fee and the rest
    of its first bar and closes with the overnight move after its last one (at the last
    close if it is still open); the overnight move before it belongs to the trade before.
    """
    f = Frames(keys, ("rn",))
    peak = F.greatest(F.lit(CAPITAL), F.max("equity").over(f.running()))
    prev = F.coalesce(F.lag("equity").over(f.ordered()), F.lit(CAPITAL))
    part = F.when(F.col("_turned") == 1, F.col("_own")).otherwise(F.col("_overnight") * F.col("_own"))
    df = curve.withColumns(
        {"_dd": F.col("equity") / peak - 1.0, "_r": ratio(F.col("equity") - prev, prev), "_g": part * F.col("_next_overnight")}
    )
    r = F.col("_r")
    runs = df.groupBy(*keys, "_run").agg(
        F.min("position").alias("position"),
        F.sum(F.when(F.col("_g") > 0, F.ln("_g"))).alias("_ln"),
        F.max((F.col("_g") <= 0).cast("int")).alias("_ruin"),
        F.max("rn").alias("_rn"),
        F.max_by("equity", "rn").alias("equity"),
        F.min_by("close", "rn").alias("_c0"),
        F.max_by("close", "rn").alias("_c1"),
        F.min("_dd").alias("_dd"),
        F.count(r).alias("_n"),
        F.sum(r).alias("_sr"),
        F.sum(r * r).alias("_sr2"),
        F.sum(F.when(r < 0, r * r)).alias("_sd2"),
    )
    traded = F.when(F.col("_ruin") == 1, -1.0).otherwise(F.exp("_ln") - 1.0)
    runs = runs.withColumn("_pct", F.when(F.col("position") != 0, traded))
    agg = runs.groupBy(*keys).agg(
        F.max_by("equity", "_rn").alias("final_equity"),
        F.min_by("_c0", "_rn").alias("_c0"),
        F.max_by("_c1", "_rn").alias("_c1"),
        F.min("_dd").alias("_dd"),
        F.count("_pct").alias("n_trades"),
        F.avg((F.col("_pct") > 0).cast("double")).alias("_win"),
        F.sum(F.when(F.col("_pct") > 0, F.col("_pct"))).alias("_wins"),
        F.sum(F.when(F.col("_pct") < 0, -F.col("_pct"))).alias("_losses"),
        F.avg("_pct").alias("_avg"),
        F.sum("_n").alias("_n"),
        F.sum("_sr").alias("_sr"),
        F.sum("_sr2").alias("_sr2"),
        F.coalesce(F.sum("_sd2"), F.lit(0.0)).alias("_sd2"),
    )
    n = F.col("_n")
    mean = F.col("_sr") / n
    sd = F.sqrt(F.greatest(F.lit(0.0), (F.col("_sr2") - n * mean * mean) / F.nullif(n - 1, F.lit(0))))
    year = math.sqrt(252.0)
    return agg.select(
        *keys,
        "final_equity",
        (100.0 * (F.col("final_equity") / CAPITAL - 1.0)).alias("return_pct"),
        (100.0 * ratio(F.col("_c1") - F.col("_c0"), "_c0")).alias("buy_hold_pct"),
        (100.0 * F.col("_dd")).alias("max_drawdown_pct"),
        "n_trades",
        (100.0 * F.col("_win")).alias("win_rate_pct"),
        ratio("_wins", "_losses").alias("profit_factor"),
        (100.0 * F.col("_avg")).alias("avg_trade_pct"),
        (year * ratio(mean, sd)).alias("sharpe"),
        (year * ratio(mean, F.sqrt(F.col("_sd2") / n))).alias("sortino"),
    )


def backtest(bars: DataFrame, n1: int = 10, n2: int = 30) -> DataFrame:
    return backtest_stats(equity_curve(sma_cross(bars, n1, n2)))


def grid_signals(bars: DataFrame) -> DataFrame:
    """Signals of all 63 pairs.  The distinct means are computed once per bar; a bar is
    then exploded per pair, carrying only its prices and signal."""
    spans = sorted({*range(5, 31, 5), *range(10, 71, 5)})
    s = by_symbol(bars.select("symbol", "ts", "open", "close"))
    s = s.with_columns({f"m{n}": sma(s.frames, n) for n in spans})
    prev = {f"p{n}": F.lag(f"m{n}").over(s.frames.ordered()) for n in spans}
    df = s.with_columns(prev).df
    by_span = {p: F.create_map(*[x for n in spans for x in (F.lit(n), F.col(f"{p}{n}"))]) for p in "mp"}
    df = df.withColumns({"_m": by_span["m"], "_p": by_span["p"]}).select("symbol", "rn", "open", "close", "_m", "_p")
    df = parameter_grid(df)
    side = F.signum(F.col("_m")[F.col("n1")] - F.col("_m")[F.col("n2")])
    prev_side = F.signum(F.col("_p")[F.col("n1")] - F.col("_p")[F.col("n2")])
    signal = F.when((prev_side == -1) & (side == 1), 1).when((prev_side == 1) & (side == -1), -1).otherwise(0)
    return df.select("symbol", "n1", "n2", "rn", "open", "close", signal.alias("signal"))


def grid_backtest(bars: DataFrame) -> DataFrame:
    """Statistics of every pair; dealt out by (symbol, n1, n2), so 63 times as many tasks
    can work as there are symbols."""
    keys = ("symbol", "n1", "n2")
    return backtest_stats(equity_curve(grid_signals(bars).repartition(*keys), keys), keys)


def optimise(bars: DataFrame) -> DataFrame:
    """The pair with the highest final equity per symbol; the first in grid order wins ties."""
    grid = grid_backtest(bars).withColumn("place", F.col("n1") * 1000 + F.col("n2"))
    stats = [s for s in STATS if s != "final_equity"]
    return best_of_grid(grid, "final_equity", "place", ["symbol"], ["n1", "n2", *stats]).drop("place")
