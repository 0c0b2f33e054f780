"""Indicator and feature windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.expr import rounded
from barloom.operators import indicators as ind
from barloom.operators import series as se
from barloom.operators.series import by_symbol
from barloom.plans import sql as q
from barloom.plans.registry import query
from barloom.sources import tables
from barloom.sources.bars import clean


def _series(bars):
    return se.by_symbol(clean(bars))


DIGITS = 4  # order prices run to 500,000, so four decimals are ten significant digits


def _digits(name: str) -> int:
    """A mean of 200 cent prices can end in ...5 at the fifth decimal, so means keep six."""
    return 6 if name.startswith("sma_") else DIGITS


def _cols(names: list[str]):
    return [rounded(n, _digits(n)).alias(n) for n in names]


def _rnds(names: list[str]) -> str:
    return ", ".join(f"{q.rnd(n, _digits(n))} AS {n}" for n in names)


def _out(s: se.Series, names: list[str]):
    return s.df.select("symbol", "ts", *_cols(names))


def _select(cols: str, ctes: str, names: list[str]) -> str:
    return f"SELECT symbol, ts, {_rnds(names)} FROM (SELECT num.symbol, ts, {cols} FROM num {ctes})"


SMA_COLS = [f"sma_{n}" for n in ind.SPANS]


@query(
    "win_01_sma",
    q.with_(q.ORDER_BARS, q.NUMBERED)
    + _select(", ".join(f"{q.roll('avg', 'close', n)} AS sma_{n}" for n in ind.SPANS), "", SMA_COLS),
)
def win_01(spark, sf):
    return _out(ind.add_sma(_series(tables.order_bars(spark, sf))), SMA_COLS)


EMA_COLS = [f"ema_{n}" for n in ind.SPANS]
EMA_SELECT = ", ".join(f"CASE WHEN num.rn >= {n - 1} THEN ema{n}.y END AS ema_{n}" for n in ind.SPANS)
EMA_JOINS = " ".join(f"JOIN ema{n} USING (symbol, rn)" for n in ind.SPANS)


@query(
    "win_02_ema",
    q.with_(q.ORDER_BARS, q.NUMBERED, *[q.ema(n) for n in ind.SPANS]) + _select(EMA_SELECT, EMA_JOINS, EMA_COLS),
)
def win_02(spark, sf):
    return _out(ind.add_ema(_series(tables.order_bars(spark, sf))), EMA_COLS)


MACD_COLS = ["macd", "macd_signal", "macd_hist"]
MACD_SELECT = "macd, macd_signal, macd - macd_signal AS macd_hist"
MACD_JOIN = "LEFT JOIN macd USING (symbol, rn)"


@query("win_03_macd", q.with_(q.ORDER_BARS, q.NUMBERED, q.MACD) + _select(MACD_SELECT, MACD_JOIN, MACD_COLS))
def win_03(spark, sf):
    return _out(ind.add_macd(_series(tables.order_bars(spark, sf))), MACD_COLS)


BB_COLS = ["bb_high", "bb_mid", "bb_low", "bb_width", "bb_pband"]
BB_SELECT = """bb_mid + 2 * sd AS bb_high, bb_mid, bb_mid - 2 * sd AS bb_low,
  100 * (4 * sd) / nullif(bb_mid, 0) AS bb_width, (close - (bb_mid - 2 * sd)) / nullif(4 * sd, 0) AS bb_pband"""
BB_CTE = f"bb AS (SELECT *, {q.roll('avg', 'close', 20)} AS bb_mid, {q.roll('stddev_pop', 'close', 20)} AS sd FROM num)"


@query(
    "win_04_bollinger",
    q.with_(q.ORDER_BARS, q.NUMBERED, BB_CTE) + f"SELECT symbol, ts, {q.rnds(BB_COLS, DIGITS)} FROM (SELECT symbol, ts, {BB_SELECT} FROM bb)",
)
def win_04(spark, sf):
    return _out(ind.add_bollinger(_series(tables.order_bars(spark, sf))), BB_COLS)


ADX_COLS = ["adx_14", "di_plus", "di_minus"]
ADX_SELECT = "adx.y AS adx_14, dxs.di_plus, dxs.di_minus"
ADX_JOIN = "LEFT JOIN dxs USING (symbol, rn) LEFT JOIN adx USING (symbol, rn)"


@query("win_05_adx", q.with_(q.ORDER_BARS, q.NUMBERED, q.MOVES, q.ADX) + _select(ADX_SELECT, ADX_JOIN, ADX_COLS))
def win_05(spark, sf):
    return _out(ind.add_adx(_series(tables.order_bars(spark, sf))), ADX_COLS)


@query(
    "win_06_rsi",
    q.with_(q.ORDER_BARS, q.NUMBERED, q.MOVES, q.RSI) + _select("rsi_14", "LEFT JOIN rsi USING (symbol, rn)", ["rsi_14"]),
)
def win_06(spark, sf):
    return _out(ind.add_rsi(_series(tables.order_bars(spark, sf))), ["rsi_14"])


STOCH_CTE = f"""k AS (SELECT symbol, ts, rn, 100 * (close - lo) / nullif(hi - lo, 0) AS stoch_k FROM
  (SELECT *, {q.roll('max', 'high', 14)} AS hi, {q.roll('min', 'low', 14)} AS lo FROM num)),
st AS (SELECT *, CASE WHEN count(stoch_k) OVER w = 3 THEN avg(stoch_k) OVER w END AS stoch_d
  FROM k WINDOW w AS (PARTITION BY symbol ORDER BY rn ROWS 2 PRECEDING))"""


@query(
    "win_07_stochastic",
    q.with_(q.ORDER_BARS, q.NUMBERED, STOCH_CTE) + f"SELECT symbol, ts, {q.rnds(['stoch_k', 'stoch_d'], DIGITS)} FROM st",
)
def win_07(spark, sf):
    return _out(ind.add_stochastic(_series(tables.order_bars(spark, sf))), ["stoch_k", "stoch_d"])


OBV_SQL = """CASE WHEN sum(volume) OVER (PARTITION BY symbol) > 0
  THEN sum(coalesce(sign(close - pc), 0) * volume) OVER (PARTITION BY symbol ORDER BY rn) END"""


@query(
    "win_08_obv",
    q.with_(q.ORDER_BARS, q.NUMBERED) + f"SELECT symbol, ts, {q.rnd(OBV_SQL, DIGITS)} AS obv FROM num",
)
def win_08(spark, sf):
    return _out(ind.add_obv(_series(tables.order_bars(spark, sf))), ["obv"])


@query(
    "win_09_atr",
    q.with_(q.ORDER_BARS, q.NUMBERED, q.MOVES, q.ATR) + _select("atr.y AS atr_14", "LEFT JOIN atr USING (symbol, rn)", ["atr_14"]),
)
def win_09(spark, sf):
    return _out(ind.add_atr(_series(tables.order_bars(spark, sf))), ["atr_14"])


RET_STD = "CASE WHEN rn >= 20 THEN 100 * stddev_samp(ret) OVER (PARTITION BY symbol ORDER BY rn ROWS 19 PRECEDING) END"


@query(
    "win_10_return_volatility",
    q.with_(q.ORDER_BARS, q.NUMBERED) + f"SELECT symbol, ts, {q.rnd(RET_STD, DIGITS)} AS ret_std_20 FROM num",
)
def win_10(spark, sf):
    return _out(ind.add_return_volatility(_series(tables.order_bars(spark, sf))), ["ret_std_20"])


SUITE_SELECT = ", ".join(
    [f"{q.roll('avg', 'close', n)} AS sma_{n}" for n in ind.SPANS]
    + [EMA_SELECT, MACD_SELECT]
    + [
        f"{q.roll('avg', 'close', 20)} AS bb_mid, {q.roll('stddev_pop', 'close', 20)} AS sd",
        ADX_SELECT,
        f"rsi_14, st.stoch_k, st.stoch_d, {OBV_SQL} AS obv, atr.y AS atr_14, {RET_STD} AS ret_std_20, close",
    ]
)
SUITE_JOINS = " ".join(
    [EMA_JOINS, MACD_JOIN, ADX_JOIN]
    + [f"LEFT JOIN {t} USING (symbol, rn)" for t in ("rsi", "atr")]
    + ["JOIN (SELECT symbol, rn, stoch_k, stoch_d FROM st) st USING (symbol, rn)"]
)
SUITE_CTES = [q.NUMBERED, *[q.ema(n) for n in ind.SPANS], q.MACD, q.MOVES, q.ADX, q.RSI, q.ATR, STOCH_CTE]
SUITE_DONE = f"""suite AS (SELECT * EXCLUDE (bb_mid), {BB_SELECT} FROM
  (SELECT num.symbol, ts, open, high, low, volume, {SUITE_SELECT} FROM num {SUITE_JOINS}))"""


def suite_sql(bars: str) -> str:
    return q.with_(bars, *SUITE_CTES, SUITE_DONE) + f"SELECT symbol, ts, {_rnds(ind.SUITE)} FROM suite"


@query("win_19_suite", suite_sql(q.ORDER_BARS))
def win_19(spark, sf):
    return ind.indicator_suite(tables.order_bars(spark, sf)).select("symbol", "ts", *_cols(ind.SUITE))


@query("win_19_suite_hourly_blocks", suite_sql(q.EVENT_BARS))
def win_19_blocks(spark, sf):
    """Block layout over hourly bars; the small block size makes several blocks even here."""
    bars = tables.event_bars(spark, sf)
    return ind.indicator_suite_blocked(bars, block_rows=512).select("symbol", "ts", *_cols(ind.SUITE))


@query(
    "win_11_shifts",
    q.with_(q.ORDER_BARS, q.NUMBERED)
    + f"""SELECT symbol, ts, {q.rnds(['lag_1', 'lag_5', 'lead_1', 'diff_1', 'pct_1', 'pct_5'], DIGITS)} FROM (
  SELECT symbol, ts, lag(close) OVER w AS lag_1, lag(close, 5) OVER w AS lag_5, lead(close) OVER w AS lead_1,
         close - lag(close) OVER w AS diff_1, close / nullif(lag(close) OVER w, 0) - 1 AS pct_1,
         close / nullif(lag(close, 5) OVER w, 0) - 1 AS pct_5
  FROM num WINDOW w AS (PARTITION BY symbol ORDER BY ts))""",
)
def win_11(spark, sf):
    s = _series(tables.order_bars(spark, sf))
    w = s.frames.ordered()
    s = s.with_columns(
        {
            "lag_1": F.lag("close").over(w),
            "lag_5": F.lag("close", 5).over(w),
            "lead_1": F.lead("close").over(w),
            "diff_1": ind.change(s.frames),
            "pct_1": ind.pct_change(s.frames),
            "pct_5": ind.pct_change(s.frames, k=5),
        }
    )
    return _out(s, ["lag_1", "lag_5", "lead_1", "diff_1", "pct_1", "pct_5"])


GAPPY = """gappy AS (SELECT symbol, ts, rn, CASE WHEN extract(dow FROM ts) IN (0, 3) THEN NULL ELSE close END AS close FROM num)"""


@query(
    "win_12_fill",
    q.with_(q.ORDER_BARS, q.NUMBERED, GAPPY)
    + f"""SELECT symbol, ts, {q.rnd('coalesce(f, b)')} AS close FROM (
  SELECT symbol, ts, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY rn) AS f,
         first_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY rn
           ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM gappy)""",
)
def win_12(spark, sf):
    """Closes of Sundays and Wednesdays are blanked, then filled."""
    bars = tables.order_bars(spark, sf)
    off = F.dayofweek("ts").isin(1, 4)
    s = se.by_symbol(bars.withColumn("close", F.when(~off, F.col("close"))))
    return se.fill_gaps(s, ["close"]).df.select("symbol", "ts", rounded("close").alias("close"))


@query(
    "win_13_roc",
    q.with_(q.ORDER_BARS, q.NUMBERED)
    + f"SELECT symbol, ts, {q.rnd('100 * (close / nullif(lag(close, 14) OVER (PARTITION BY symbol ORDER BY rn), 0) - 1)', DIGITS)} AS roc FROM num",
)
def win_13(spark, sf):
    s = _series(tables.order_bars(spark, sf))
    return _out(s.with_columns({"roc": ind.roc(s.frames)}), ["roc"])


@query(
    "win_14_without_range",
    q.with_(q.ORDER_BARS, q.NUMBERED)
    + f"""SELECT symbol, ts, CASE WHEN symbol < 'C' THEN -50.0 ELSE {q.rnd('-100 * (hi - close) / nullif(hi - lo, 0)', DIGITS)} END AS williams_r FROM
  (SELECT *, {q.roll('max', 'high', 14)} AS hi, {q.roll('min', 'low', 14)} AS lo FROM num)""",
)
def win_14_line(spark, sf):
    """Segments before C are taken as lines of closes, without highs and lows."""
    line = F.col("symbol") < "C"
    bars = tables.order_bars(spark, sf).withColumns({x: F.when(~line, F.col(x)) for x in ("high", "low")})
    s = by_symbol(bars)
    return _out(s.with_columns({"williams_r": ind.williams_r(s.frames)}), ["williams_r"])


@query(
    "win_14_williams_r",
    q.with_(q.ORDER_BARS, q.NUMBERED)
    + f"""SELECT symbol, ts, {q.rnd('-100 * (hi - close) / nullif(hi - lo, 0)', DIGITS)} AS williams_r FROM
  (SELECT *, {q.roll('max', 'high', 14)} AS hi, {q.roll('min', 'low', 14)} AS lo FROM num)""",
)
def win_14(spark, sf):
    s = _series(tables.order_bars(spark, sf))
    return _out(s.with_columns({"williams_r": ind.williams_r(s.frames)}), ["williams_r"])
