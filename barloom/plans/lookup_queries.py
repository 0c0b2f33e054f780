"""Projection, join, sort and set queries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.functions import text as tx
from barloom.functions.expr import rounded, rounded_cols
from barloom.operators import indicators as ind
from barloom.operators import lookups as lk
from barloom.operators import series as se
from barloom.plans import sql as q
from barloom.plans.indicator_queries import DIGITS, SUITE_CTES, SUITE_DONE
from barloom.plans.profile_queries import SPARSE_SQL, sparse_facts
from barloom.plans.registry import query
from barloom.plans.source_queries import BAR_COLS, FX_SQL, POINTS_SQL, VENDOR_SYMBOL_SQL, fx_payload, month_points, vendor_symbols
from barloom.sources import bars as br
from barloom.sources import payloads as pl
from barloom.sources import tables


@query(
    "prj_01_drop_nulls",
    q.with_(SPARSE_SQL)
    + f"SELECT symbol, priority, {q.rnds(['balance', 'open_price'])} FROM facts WHERE balance IS NOT NULL AND open_price IS NOT NULL",
)
def prj_01(spark, sf):
    df = sparse_facts(spark, sf).na.drop(subset=["balance", "open_price"])
    return df.select("symbol", "priority", *rounded_cols(["balance", "open_price"]))


@query("prj_02_fill_volume", q.with_(SPARSE_SQL) + f"SELECT symbol, {q.rnd('coalesce(open_price, 0)')} AS volume FROM facts")
def prj_02(spark, sf):
    return sparse_facts(spark, sf).select("symbol", rounded(F.coalesce("open_price", F.lit(0.0))).alias("volume"))


WANTED = ["sma_21", "ema_21", "macd_hist", "rsi_14"]


@query(
    "prj_03_indicator_projection",
    q.with_(q.ORDER_BARS, *SUITE_CTES, SUITE_DONE)
    + f"SELECT symbol, ts, {q.rnds(BAR_COLS)}, {q.rnd('sma_21')} AS sma_21, {q.rnds(WANTED[1:], DIGITS)} FROM suite",
)
def prj_03(spark, sf):
    df = ind.select_indicators(ind.indicator_suite(tables.order_bars(spark, sf)), WANTED + ["no_such_column"])
    return df.select("symbol", "ts", *rounded_cols(BAR_COLS), rounded("sma_21").alias("sma_21"), *rounded_cols(WANTED[1:], DIGITS))


@query(
    "prj_04_date_range",
    q.with_(q.ORDER_BARS) + f"SELECT symbol, ts, {q.rnds(BAR_COLS)} FROM bars WHERE ts BETWEEN DATE '1997-03-01' AND DATE '1997-06-30'",
)
def prj_04(spark, sf):
    start, end = date(1997, 3, 1), date(1997, 6, 30)
    bars = br.between_dates(tables.order_bars(spark, sf, start, end), F.lit(start), F.lit(end))
    return bars.select("symbol", "ts", *rounded_cols(BAR_COLS))


@query(
    "prj_05_membership",
    q.with_(q.ORDER_BARS)
    + f"SELECT symbol, ts, {q.rnd('close')} AS close FROM bars WHERE year(ts) IN (1996, 1999) AND ts IN (SELECT CAST(ts AS DATE) + INTERVAL 9000 DAY - INTERVAL 9000 DAY FROM bars WHERE volume > 2)",
)
def prj_05(spark, sf):
    bars = tables.order_bars(spark, sf)
    busy = bars.filter("volume > 2").select("ts").distinct()
    df = bars.filter(F.year("ts").isin(1996, 1999)).join(busy, "ts", "left_semi")
    return df.select("symbol", "ts", rounded("close").alias("close"))


@query(
    "prj_06_day_change",
    q.with_(q.ORDER_BARS, q.NUMBERED)
    + f"""SELECT symbol, ts, {q.rnd('close - pc')} AS change, {q.rnd('CASE WHEN pc = 0 THEN 0 ELSE 100 * (close - pc) / nullif(pc, 0) END')} AS change_pct,
  {q.rnd('100 * (close - pc) / nullif(pc, 0)')} AS change_pct_or_null FROM (SELECT symbol, ts, close, CASE WHEN rn % 50 = 0 THEN 0 ELSE pc END AS pc FROM num)""",
)
def prj_06(spark, sf):
    """Every 50th bar has a zero previous close."""
    s = se.by_symbol(tables.order_bars(spark, sf))
    prev = F.when(F.col("rn") % 50 == 0, 0.0).otherwise(F.lag("close").over(s.frames.ordered()))
    df = s.df.withColumn("prev", prev)
    ch = lk.day_change(F.col("close"), F.col("prev"))
    return df.select("symbol", "ts", *[rounded(v).alias(k) for k, v in ch.items()])


QUOTE_SQL = f"""SELECT symbol, l.ts AS ts, {q.rnd('l.close')} AS price, {q.rnd('l.close - l.pc')} AS change,
  {q.rnd('100 * (l.close - l.pc) / nullif(l.pc, 0)')} AS change_pct, {q.rnd('l.open')} AS open, {q.rnd('l.high')} AS high,
  {q.rnd('l.low')} AS low, {q.rnd('l.pc')} AS prev_close, CAST(l.volume AS BIGINT) AS volume
FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS d FROM num) l WHERE d = 1 AND pc IS NOT NULL"""
QUOTE_NUMBERS = ["price", "change", "change_pct", "open", "high", "low", "prev_close"]


@query("prj_07_quote_from_history", q.with_(q.NATION_BARS, q.NUMBERED) + QUOTE_SQL)
def prj_07(spark, sf):
    df = lk.quote_from_history(tables.nation_bars(spark, sf))
    return df.select("symbol", "ts", *rounded_cols(QUOTE_NUMBERS), "volume")


@query(
    "prj_08_latest_positive_rate",
    q.with_(FX_SQL) + f"SELECT 'USD_BRL' AS series_id, max(ts) AS date, {q.rnd('arg_max(rate, ts)')} AS value FROM rates WHERE rate > 0 AND ts IS NOT NULL",
)
def prj_08(spark, sf):
    rates = pl.fx_rates(fx_payload(spark, sf)).na.drop(subset=["ts"])
    rates = rates.select(F.lit("USD_BRL").alias("series_id"), F.col("ts").alias("date"), F.col("rate").alias("value"))
    return lk.latest_positive(rates).withColumn("value", rounded("value"))


@query(
    "prj_09_latest_macro",
    q.with_(POINTS_SQL)
    + f"""SELECT series_id, max(date) AS date, {q.rnd('arg_max_null(value, date)')} AS value,
  CASE WHEN series_id IN ('1-URGENT', '2-HIGH') THEN 'orders' END AS unit FROM points GROUP BY 1""",
)
def prj_09(spark, sf):
    """Units are known for two of the series only."""
    points = month_points(spark, sf)
    meta = points.select("series_id").distinct().filter(F.col("series_id").isin("1-URGENT", "2-HIGH"))
    return lk.latest_value(points, meta.withColumn("unit", F.lit("orders"))).withColumn("value", rounded("value"))


@query(
    "prj_10_symbol_search",
    "SELECT c_mktsegment || '-' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS symbol, c_name AS name FROM customer WHERE lower(c_mktsegment) LIKE '%build%' OR lower(c_name) LIKE '%build%' ORDER BY 1 LIMIT 10",
)
def prj_10(spark, sf):
    c = tables.table(spark, sf, "customer")
    key = F.concat_ws("-", "c_mktsegment", F.lpad(F.col("c_custkey").cast("string"), 9, "0"))
    return lk.search_symbols(c.select(key.alias("symbol"), F.col("c_name").alias("name")), "BUILD")


@query(
    "prj_11_text_formats",
    f"""SELECT c_custkey, upper(trim(symbol)) AS cleaned, replace(replace(symbol, '.SA', ''), '^', '') AS bare,
  upper(left(lower(symbol), 1)) || substr(lower(symbol), 2) AS capitalised,
  'R$ ' || translate(format('{{:,.2f}}', c_acctbal), ',.', '.,') AS money,
  printf('%.2f%%', c_acctbal / 64) AS pct FROM (SELECT c_custkey, c_acctbal, {VENDOR_SYMBOL_SQL} AS symbol FROM customer)""",
)
def prj_11(spark, sf):
    c = tables.table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    df = vendor_symbols(spark, sf).join(c, "c_custkey")
    s = F.col("symbol")
    return df.select(
        "c_custkey",
        tx.clean_symbol(s).alias("cleaned"),
        tx.bare_symbol(s).alias("bare"),
        tx.capitalised(s).alias("capitalised"),
        tx.money(F.col("c_acctbal")).alias("money"),
        tx.percent(F.col("c_acctbal") / 64).alias("pct"),
    )


@query(
    "prj_12_watchlist",
    """SELECT DISTINCT c_mktsegment AS symbol, 'asset' AS kind FROM customer WHERE c_mktsegment <> 'BUILDING'
UNION ALL SELECT n_name, 'index' FROM nation WHERE n_regionkey = 1""",
)
def prj_12(spark, sf):
    """Segments are watched as assets; no index is, so the defaults (nations of one region) apply."""
    segments = tables.table(spark, sf, "customer").select(F.col("c_mktsegment").alias("symbol")).distinct()
    rows = segments.filter("symbol != 'BUILDING'").withColumn("kind", F.lit("asset"))
    nations = tables.table(spark, sf, "nation")
    defaults = nations.filter("n_regionkey = 1").select(F.col("n_name").alias("symbol"), F.lit("index").alias("kind"))
    defaults = defaults.unionByName(segments.filter("symbol = 'BUILDING'").withColumn("kind", F.lit("asset")))
    return lk.watchlist(rows, defaults)


# -- joins -----------------------------------------------------------------------------


@query(
    "joi_01_regressor_join",
    q.with_(q.NATION_BARS.replace("bars AS", "nbars AS", 1), q.ORDER_BARS, q.NUMBERED)
    + f"""SELECT symbol, ts, {q.rnd('coalesce(last_value(x IGNORE NULLS) OVER a, first_value(x IGNORE NULLS) OVER b)')} AS x, true AS usable FROM (
  SELECT n.symbol, n.ts, r.close AS x FROM (SELECT DISTINCT symbol, ts + 1 AS ts FROM bars) n
  LEFT JOIN bars r ON r.symbol = n.symbol AND r.ts = n.ts)
WINDOW a AS (PARTITION BY symbol ORDER BY ts), b AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""",
)
def joi_01(spark, sf):
    """Days after a bar, with the close of that day where there is one."""
    bars = tables.order_bars(spark, sf)
    future = bars.select("symbol", F.date_add("ts", 1).alias("ts"))
    df = lk.join_regressors(future, bars.withColumnRenamed("close", "x"), ["x"])
    return df.select("symbol", "ts", rounded("x").alias("x"), "usable")


FORECAST_SQL = """fc AS (SELECT symbol, ts, m AS yhat, m - 1000 AS yhat_lower, m + 1000 AS yhat_upper FROM (
  SELECT symbol, ts, rn, avg(close) OVER (PARTITION BY symbol ORDER BY rn ROWS 4 PRECEDING) AS m FROM num) WHERE rn % 3 = 0)"""


@query(
    "joi_02_actual_forecast",
    q.with_(q.ORDER_BARS, q.NUMBERED, FORECAST_SQL)
    + f"SELECT symbol, ts, {q.rnds(['actual', 'yhat', 'yhat_lower', 'yhat_upper'])} FROM (SELECT symbol, ts, close AS actual, yhat, yhat_lower, yhat_upper FROM bars LEFT JOIN fc USING (symbol, ts))",
)
def joi_02(spark, sf):
    """A five-bar mean as forecast of every third bar."""
    bars = tables.order_bars(spark, sf)
    s = se.by_symbol(bars)
    m = F.avg("close").over(s.frames.last(5))
    fc = s.df.select("symbol", "ts", "rn", m.alias("yhat")).filter("rn % 3 = 0").drop("rn")
    fc = fc.withColumns({"yhat_lower": F.col("yhat") - 1000, "yhat_upper": F.col("yhat") + 1000})
    df = bars.withColumnRenamed("close", "actual").join(fc, ["symbol", "ts"], "left")
    return df.select("symbol", "ts", *rounded_cols(["actual", "yhat", "yhat_lower", "yhat_upper"]))


@query(
    "joi_03_benchmark_return",
    q.with_(q.ORDER_BARS, q.NUMBERED)
    + f"""SELECT b.symbol, b.ts, {q.rnd('b.close')} AS close, {q.rnd('coalesce(n.ret, 0)')} AS benchmark_return
FROM bars b LEFT JOIN (SELECT ts, ret FROM num WHERE symbol = 'BUILDING') n USING (ts)""",
)
def joi_03(spark, sf):
    bars = tables.order_bars(spark, sf)
    df = lk.with_benchmark_return(bars, bars.filter("symbol = 'BUILDING'"))
    return df.select("symbol", "ts", *rounded_cols(["close", "benchmark_return"]))


@query(
    "joi_07_parameter_grid",
    """SELECT n_name AS symbol, CAST(a AS INTEGER) AS n1, CAST(b AS INTEGER) AS n2 FROM nation, range(5, 31, 5) r(a), range(10, 71, 5) s(b) WHERE a < b""",
)
def joi_07(spark, sf):
    return lk.parameter_grid(tables.table(spark, sf, "nation").select(F.col("n_name").alias("symbol")))


# -- sort, limit, sets --------------------------------------------------------------------


@query(
    "srt_01_sorted_index",
    q.with_(q.ORDER_BARS)
    + f"SELECT symbol, ts, {q.rnd('close')} AS close, CAST(row_number() OVER (ORDER BY ts DESC, symbol) AS BIGINT) AS place FROM bars ORDER BY ts DESC, symbol",
)
def srt_01(spark, sf):
    """All bars, newest first.  Places come from the number of bars of the days after and the
    place inside a day, so only one row per day is numbered in one task."""
    bars = tables.order_bars(spark, sf).select("symbol", "ts", "close")
    later = F.sum("n").over(Window.orderBy(F.desc("ts")).rowsBetween(Window.unboundedPreceding, -1))
    days = bars.groupBy("ts").agg(F.count(F.lit(1)).alias("n")).select("ts", F.coalesce(later, F.lit(0)).alias("later"))
    inside = F.row_number().over(Window.partitionBy("ts").orderBy("symbol"))
    placed = bars.withColumn("inside", inside).join(days, "ts").orderBy(F.desc("ts"), "symbol")
    return placed.select("symbol", "ts", rounded("close").alias("close"), (F.col("later") + F.col("inside")).cast("long").alias("place"))


@query(
    "win_21_last_rows",
    q.with_(q.ORDER_BARS)
    + f"SELECT symbol, ts, {q.rnd('close')} AS close, CAST(place AS BIGINT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS place FROM bars) WHERE place <= 15",
)
def win_21(spark, sf):
    df = se.last_rows(tables.order_bars(spark, sf), 15)
    return df.select("symbol", "ts", rounded("close").alias("close"), F.col("place").cast("long").alias("place"))


@query("set_01_union", q.with_(q.ORDER_BARS) + f"SELECT symbol, ts, {q.rnd('close')} AS close, replica FROM bars, (SELECT unnest([0, 1]) AS replica)")
def set_01(spark, sf):
    bars = tables.order_bars(spark, sf).select("symbol", "ts", rounded("close").alias("close"))
    return bars.withColumn("replica", F.lit(0)).unionByName(bars.withColumn("replica", F.lit(1)))


@query(
    "set_02_distinct_dates",
    q.with_(q.ORDER_BARS) + "SELECT ts FROM bars WHERE symbol = 'BUILDING' UNION SELECT ts FROM bars WHERE symbol = 'MACHINERY'",
)
def set_02(spark, sf):
    bars = tables.order_bars(spark, sf).select("symbol", "ts")
    one, two = bars.filter("symbol = 'BUILDING'"), bars.filter("symbol = 'MACHINERY'")
    return one.select("ts").union(two.select("ts")).distinct()


@query(
    "srt_05_axis_ticks",
    q.with_(q.ORDER_BARS, q.NUMBERED) + "SELECT symbol, ts FROM (SELECT symbol, ts, rn, count(*) OVER (PARTITION BY symbol) AS n FROM num) WHERE rn % greatest(1, n // 10) = 0",
)
def srt_05_ticks(spark, sf):
    return lk.axis_ticks(tables.order_bars(spark, sf).select("symbol", "ts"))
