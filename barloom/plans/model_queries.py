"""Classifier and forecast queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.expr import rounded, rounded_cols
from barloom.operators import classifier as cl
from barloom.operators import forecast as fc
from barloom.operators import lookups as lk
from barloom.operators import series as se
from barloom.operators.indicators import pct_change
from barloom.plans import sql as q
from barloom.plans.feature_queries import FEATURE_SQL, features
from barloom.plans.registry import query
from barloom.session import stored
from barloom.sources import tables

SHORT = ["rsi", "macd", "roc", "atr_normalized", "price_momentum", "day_of_week"]


def _training(spark, sf):
    labelled = stored(cl.labelled_features(tables.index_bars(spark, sf)), "labelled")
    return labelled, stored(cl.training_rows(labelled, SHORT), "windows")


@query("mod_01_train_evaluate")
def mod_01(spark, sf):
    """Metrics per symbol on the held-out 30%."""
    return cl.train_and_evaluate(spark, tables.index_bars(spark, sf))["metrics"]


@query("mod_02_repeated_scoring")
def mod_02(spark, sf):
    _, rows = _training(spark, sf)
    models = cl.fit_bag(rows.filter("is_train"))
    return cl.score_bag(models, rows.filter("NOT is_train"))


@query("mod_03_next_step")
def mod_03(spark, sf):
    """The trained bag with the thresholds it found and the ranges of its training rows."""
    trained = cl.train_and_evaluate(spark, tables.index_bars(spark, sf))
    t = trained["thresholds"].first()
    return cl.next_step(trained["models"], trained["labelled"], trained["features"], F.lit(t.t_low), F.lit(t.t_high), trained["ranges"])


def with_regressors(spark, sf):
    """Features with the return of one segment as the market's."""
    df = features(spark, sf)
    return lk.with_benchmark_return(df, df.filter("symbol = 'BUILDING'"))


@query("mod_04_forecast")
def mod_04(spark, sf):
    return fc.forecast(with_regressors(spark, sf))


TWO_SQL = """lsq AS (SELECT symbol, count(*) AS n, avg(close) AS my, avg(ret) AS ma, avg(volume) AS mb, var_pop(ret) AS vaa, var_pop(volume) AS vbb, covar_pop(ret, volume) AS vab,
  covar_pop(close, ret) AS vya, covar_pop(close, volume) AS vyb, var_pop(close) AS vyy FROM num WHERE ret IS NOT NULL GROUP BY 1),
slopes AS (SELECT *, (vya * vbb - vyb * vab) / (vaa * vbb - vab * vab) AS b1, (vyb * vaa - vya * vab) / (vaa * vbb - vab * vab) AS b2 FROM lsq)"""


@query(
    "mod_04_least_squares",
    q.with_(q.INDEX_BARS, q.NUMBERED, TWO_SQL)
    + f"SELECT symbol, {q.rnd('my - b1 * ma - b2 * mb')} AS level, {q.rnd('b1')} AS slope_return, {q.rnd('b2')} AS slope_volume, {q.rnd('sqrt(greatest(0, vyy - b1 * vya - b2 * vyb))')} AS sigma FROM slopes",
)
def mod_04_least_squares(spark, sf):
    """The close on two regressors, the bar's return and volume, from the Gram sums of the forecast."""
    s = se.by_symbol(tables.index_bars(spark, sf))
    df = s.with_columns({"ret": pct_change(s.frames)}).df
    found = fc.least_squares(df, "close", ["ret", "volume"])
    beta = lambda i: rounded(F.element_at("beta", i))
    return found.select("symbol", beta(1).alias("level"), beta(2).alias("slope_return"), beta(3).alias("slope_volume"), rounded("sigma").alias("sigma"))


@query(
    "mod_04_trend",
    q.with_(q.INDEX_BARS, q.NUMBERED) + f"SELECT symbol, {q.rnd('regr_intercept(close, rn)')} AS level, {q.rnd('regr_slope(close, rn)', 9)} AS slope FROM num GROUP BY 1",
)
def mod_04_trend(spark, sf):
    """The close on the bar's number."""
    found = fc.least_squares(se.by_symbol(tables.index_bars(spark, sf)).df, "close", ["rn"])
    return found.select("symbol", rounded(F.element_at("beta", 1)).alias("level"), rounded(F.element_at("beta", 2), 9).alias("slope"))


PREP_SQL = """prep AS (SELECT symbol, CAST(ts AS DATE) AS ds, close AS y, rsi, macd, macd_signal, atr FROM feats
  WHERE rsi IS NOT NULL AND macd IS NOT NULL AND macd_signal IS NOT NULL AND atr IS NOT NULL)"""
PREP_COLS = ["y", "rsi", "macd", "macd_signal", "atr"]


@query("mod_05_prepare", q.with_(*FEATURE_SQL, PREP_SQL) + f"SELECT symbol, ds, {q.rnds(PREP_COLS)} FROM prep")
def mod_05(spark, sf):
    return fc.prepare(features(spark, sf)).select("symbol", "ds", *rounded_cols(PREP_COLS))


@query(
    "mod_06_hold_out",
    q.with_(q.INDEX_BARS, q.NUMBERED) + "SELECT symbol, ts AS ds, rn >= count(*) OVER (PARTITION BY symbol) - 30 AS is_test FROM num",
)
def mod_06(spark, sf):
    return fc.hold_out(fc.prepare(tables.index_bars(spark, sf))).select("symbol", "ds", "is_test")


@query(
    "mod_06_future_days",
    q.with_(q.INDEX_BARS)
    + f"""SELECT symbol, CAST(ds AS DATE) AS ds, {q.rnd('volume')} AS volume FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ds) AS d FROM (
    SELECT symbol, unnest(generate_series(last + 1, last + 60, INTERVAL 1 DAY)) AS ds, volume FROM (
      SELECT symbol, max(ts) AS last, arg_max(volume, ts) AS volume FROM bars GROUP BY 1)) WHERE isodow(ds) < 6) WHERE d <= 30""",
)
def mod_06_future(spark, sf):
    df = fc.prepare(tables.index_bars(spark, sf), regressors=["volume"])
    return fc.future_rows(df, ["volume"]).withColumn("volume", rounded("volume"))


@query("mod_07_interval")
def mod_07(spark, sf):
    """Half widths of the interval, equal for all days of a symbol."""
    df = fc.forecast(with_regressors(spark, sf))
    return df.groupBy("symbol").agg(
        rounded(F.min(F.col("yhat_upper") - F.col("yhat"))).alias("half_width"),
        F.avg(F.col("actual").between(F.col("yhat_lower"), F.col("yhat_upper")).cast("double")).alias("covered"),
    )




@query(
    "mod_07_residual_interval",
    q.with_(q.INDEX_BARS, q.NUMBERED)
    + f"""SELECT symbol, ds, {q.rnds(['yhat', 'yhat_lower', 'yhat_upper'])} FROM (
  SELECT symbol, ts AS ds, yhat, yhat - {fc.Z80!r} * s AS yhat_lower, yhat + {fc.Z80!r} * s AS yhat_upper FROM (
    SELECT *, sqrt(avg(pow(close - yhat, 2)) OVER (PARTITION BY symbol)) AS s FROM (
      SELECT symbol, ts, close, avg(close) OVER (PARTITION BY symbol ORDER BY rn ROWS 4 PRECEDING) AS yhat FROM num)))""",
)
def mod_07_residual(spark, sf):
    """Interval of a five-bar mean taken as forecast."""
    s = se.by_symbol(tables.index_bars(spark, sf))
    scored = s.df.select(
        "symbol", F.col("ts").alias("ds"), F.col("close").alias("actual"), F.avg("close").over(s.frames.last(5)).alias("yhat")
    )
    return fc.residual_interval(scored).select("symbol", "ds", *rounded_cols(["yhat", "yhat_lower", "yhat_upper"]))
