"""Additive trend + seasonality forecast with regressors, one ridge regression per symbol.

The rows of all symbols are reduced to Gram matrices in one pass: each task adds up x x'
per symbol, one row per symbol and task goes over the shuffle, and only k x k numbers per
symbol are solved.  No symbol's rows are ever gathered.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.expr import ratio
from barloom.operators.series import last_rows
from barloom.session import stored

HORIZON = 30
MIN_TRAIN = 10
REGRESSORS = ["rsi", "macd", "macd_signal", "atr", "benchmark_return"]
CHANGEPOINTS = 10
WEEKLY, YEARLY = 3, 10
Z80 = 1.2815515655446004  # half width of the 80% interval in deviations


def prepare(df: DataFrame, ds: str = "ts", y: str = "close", regressors: list[str] = REGRESSORS) -> DataFrame:
    """(symbol, ds, y, regressors that exist) without nulls; ds is a plain date."""
    keep = [r for r in regressors if r in df.columns]
    out = df.select("symbol", F.col(ds).cast("date").alias("ds"), F.col(y).cast("double").alias("y"), *keep)
    return out.na.drop()


def hold_out(df: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """Mark the last ``horizon`` rows per symbol as test rows, none where fewer than ten
    rows would be left to train on."""
    w = Window.partitionBy("symbol")
    place, n = F.row_number().over(w.orderBy("ds")), F.count(F.lit(1)).over(w)
    return df.withColumn("is_test", (n - horizon >= MIN_TRAIN) & (place > n - horizon))


def future_rows(df: DataFrame, regressors: list[str], horizon: int = HORIZON) -> DataFrame:
    """The next ``horizon`` business days per symbol with the last regressor values."""
    last = last_rows(df, 1, order="ds").drop("place")
    days = F.filter(F.sequence(F.date_add("ds", 1), F.date_add("ds", 2 * horizon)), lambda d: F.weekday(d) < 5)
    return last.select("symbol", F.explode(F.slice(days, 1, horizon)).alias("ds"), *regressors)


def _design(regressors: list[str]) -> list[Column]:
    """Columns of the regression: level, trend with bends in the first 80% of the history,
    weekly and yearly waves, regressors (scaled by their training deviation)."""
    day = F.unix_date("ds").cast("double")
    t = ratio(day - F.col("t0"), F.col("t1") - F.col("t0"))
    cols = [F.lit(1.0), t]
    cols += [F.greatest(F.lit(0.0), t - 0.8 * (i + 1) / (CHANGEPOINTS + 1)) for i in range(CHANGEPOINTS)]
    for period, order in ((7.0, WEEKLY), (365.25, YEARLY)):
        for k in range(1, order + 1):
            angle = 2.0 * math.pi * k / period * day
            cols += [F.sin(angle), F.cos(angle)]
    cols += [F.coalesce(ratio(F.col(r) - F.col(f"m_{r}"), f"s_{r}"), F.lit(0.0)) for r in regressors]
    return cols


def _penalties(n_regressors: int) -> np.ndarray:
    """Ridge weights: none on level and slope, strong on bends, light on the rest."""
    return np.array([0.0, 0.0] + [5.0] * CHANGEPOINTS + [0.01] * (2 * (WEEKLY + YEARLY) + n_regressors))


def _scales(train: DataFrame, regressors: list[str]) -> DataFrame:
    day = F.unix_date("ds").cast("double")
    return train.groupBy("symbol").agg(
        F.min(day).alias("t0"),
        F.max(day).alias("t1"),
        F.avg("y").alias("y_mean"),
        F.stddev_pop("y").alias("y_std"),
        *[F.avg(r).alias(f"m_{r}") for r in regressors],
        *[F.stddev_pop(r).alias(f"s_{r}") for r in regressors],
    )


#: partial sums of a key are merged in this many groups before the last merge
MERGE_GROUPS = 64
#: keys that a task holds sums of before it hands them on
HELD_KEYS = 512


def _partial_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of x x' per symbol over a whole task: one row a symbol, the upper triangle row by row."""
    held: dict[str | None, np.ndarray] = {}

    def rows() -> pa.RecordBatch:
        part = TaskContext.get().partitionId() % MERGE_GROUPS
        flat = [m[np.triu_indices(len(m))] for m in held.values()]
        columns = [pa.array(list(held), pa.string()), pa.array([part] * len(held), pa.int32()), pa.array(flat, pa.list_(pa.float64()))]
        return pa.RecordBatch.from_arrays(columns, ["symbol", "part", "g"])

    for batch in batches:
        codes = batch.column("symbol").dictionary_encode()
        width = len(batch.column("x")[0]) if batch.num_rows else 0
        x = batch.column("x").flatten().to_numpy().reshape(-1, width) if width else np.zeros((0, 0))
        index = codes.indices.fill_null(len(codes.dictionary)).to_numpy()
        names = [*codes.dictionary.to_pylist(), None]
        for code in np.unique(index):
            own = x[index == code]
            held[names[code]] = held.get(names[code], 0.0) + own.T @ own
        if len(held) >= HELD_KEYS:
            yield rows()
            held.clear()
    if held:
        yield rows()


def gram_sums(rows: DataFrame) -> DataFrame:
    """``rows`` (symbol, x array<double>) to one upper triangle ``g`` of the sum of x x' per symbol.

    A task adds up what it reads and sends one row a symbol; rows are not dealt out by symbol before, so a symbol
    with a third of all rows is as much work for each task as any other.  The partial sums merge in two steps, the
    first over groups of tasks, so that no merge reads more than a share of the tasks' rows.
    """
    plus = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    total = F.aggregate(F.slice("_g", 2, F.greatest(F.size("_g") - 1, F.lit(1))), F.element_at("_g", 1), plus)
    partial = rows.mapInArrow(_partial_grams, "symbol string, part int, g array<double>")
    for keys in (["symbol", "part"], ["symbol"]):
        partial = partial.groupBy(*keys).agg(F.collect_list("g").alias("_g")).select(*keys, total.alias("g"))
    return partial


def _square(flat) -> np.ndarray:
    """The symmetric matrix of an upper triangle."""
    flat = np.asarray(flat, dtype=float)
    k = (math.isqrt(8 * len(flat) + 1) - 1) // 2
    m = np.zeros((k, k))
    m[np.triu_indices(k)] = flat
    return m + np.triu(m, 1).T


def _solver(penalty: np.ndarray):
    @F.pandas_udf("beta array<double>, sigma double")
    def solve(g: pd.Series) -> pd.DataFrame:
        out = []
        for flat in g:
            m = _square(flat)
            xx, xz, zz, n = m[:-2, :-2], m[:-2, -2], m[-2, -2], m[-1, -1]
            beta = np.linalg.lstsq(xx + np.diag(penalty), xz, rcond=None)[0]
            sse = max(0.0, zz - 2.0 * beta @ xz + beta @ xx @ beta)
            out.append((beta.tolist(), math.sqrt(sse / max(1.0, n))))
        return pd.DataFrame(out, columns=["beta", "sigma"])

    return solve


def least_squares(df: DataFrame, y: str, regressors: list[str], ridge: float = 0.0) -> DataFrame:
    """One row per symbol: the coefficients (level first) of ``y`` on the regressors, and the root mean square of the
    residuals, on the rows without nulls."""
    rows = df.select("symbol", F.col(y).cast("double").alias(y), *[F.col(r).cast("double").alias(r) for r in regressors if r != y]).na.drop()
    x = F.array(F.lit(1.0), *regressors, y, F.lit(1.0))
    penalty = np.array([0.0] + [ridge] * len(regressors))
    return gram_sums(rows.select("symbol", x.alias("x"))).select("symbol", _solver(penalty)("g").alias("f")).select("symbol", "f.*")


def fit(train: DataFrame, regressors: list[str]) -> DataFrame:
    """One row per symbol: scales, coefficients and residual deviation."""
    scales = _scales(train, regressors)
    z = F.coalesce(ratio(F.col("y") - F.col("y_mean"), "y_std"), F.lit(0.0))
    rows = train.join(scales, "symbol").select("symbol", F.array(*_design(regressors), z, F.lit(1.0)).alias("x"))
    solved = gram_sums(rows).select("symbol", _solver(_penalties(len(regressors)))("g").alias("f"))
    return solved.select("symbol", "f.*").join(scales, "symbol")


def predict(rows: DataFrame, model: DataFrame, regressors: list[str]) -> DataFrame:
    """yhat with its 80% interval; the model is one row per symbol."""
    df = rows.join(model, "symbol").withColumn("x", F.array(*_design(regressors)))
    dot = F.aggregate(F.zip_with("x", "beta", lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
    yhat = F.col("y_mean") + F.col("y_std") * dot
    half = Z80 * F.col("sigma") * F.col("y_std")
    out = df.withColumns({"yhat": yhat, "_half": half})
    return out.select(
        *rows.columns, "yhat", (F.col("yhat") - F.col("_half")).alias("yhat_lower"), (F.col("yhat") + F.col("_half")).alias("yhat_upper")
    )


def residual_interval(scored: DataFrame, z: float = Z80) -> DataFrame:
    """Interval around any forecast from the moments of its own residuals: per symbol
    yhat +- z times the root mean square of (actual - yhat)."""
    err = F.col("actual") - F.col("yhat")
    spread = scored.groupBy("symbol").agg(F.sqrt(F.avg(err * err)).alias("_sigma"))
    half = z * F.col("_sigma")
    out = scored.join(spread, "symbol")
    return out.withColumns({"yhat_lower": F.col("yhat") - half, "yhat_upper": F.col("yhat") + half}).drop("_sigma")


def forecast(df: DataFrame, regressors: list[str] = REGRESSORS, horizon: int = HORIZON) -> DataFrame:
    """Prepare, hold out, fit, predict.  Held-out rows carry their real value; symbols too
    short to hold out get the next business days instead."""
    keep = [r for r in regressors if r in df.columns]
    split = stored(hold_out(prepare(df, regressors=keep), horizon), "forecast-rows")
    test = split.filter("is_test")
    model = fit(split.filter("NOT is_test"), keep)
    held = test.select("symbol", "ds", F.col("y").alias("actual"), *keep)
    short = split.join(test.select("symbol").distinct(), "symbol", "left_anti")
    ahead = future_rows(short, keep, horizon).withColumn("actual", F.lit(None).cast("double"))
    rows = held.unionByName(ahead.select(held.columns))
    return predict(rows, model, keep).select("symbol", "ds", "actual", "yhat", "yhat_lower", "yhat_upper")
