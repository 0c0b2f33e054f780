"""Scenario, backtest, alert and dashboard queries."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import functions as F

from barloom.functions.expr import rounded, rounded_cols
from barloom.operators import alerts as al
from barloom.operators import backtest as bk
from barloom.operators import lookups as lk
from barloom.operators import scenario as sc
from barloom.plans import sql as q
from barloom.plans.evaluation_queries import SCORED_SQL, scored
from barloom.plans.feature_queries import SIGNAL_SQL
from barloom.plans.lookup_queries import QUOTE_SQL
from barloom.plans.profile_queries import CLASS_SQL, SPARSE_SQL, sparse_facts
from barloom.plans.registry import query
from barloom.plans.source_queries import POINTS_SQL, month_points
from barloom.sources import tables

DAYS = 10


def scenario_sql(days: int) -> list[str]:
    return [
        q.INDEX_BARS,
        q.NUMBERED,
        """par AS (SELECT symbol, count(*) AS n, avg(r) AS mu, stddev_samp(r) AS sigma, arg_max(close, ts) AS s0 FROM (
  SELECT symbol, ts, close, ln(close / pc) AS r FROM num) GROUP BY 1)""",
        f"""paths AS (SELECT a.symbol, CAST(a.rn AS INTEGER) AS sim, CAST(d.day AS INTEGER) AS day, n, s0, s0 * b.close / a.close AS price
  FROM num a CROSS JOIN range({days + 1}) d(day) JOIN num b ON b.symbol = a.symbol AND b.rn = a.rn + d.day JOIN par ON par.symbol = a.symbol WHERE a.rn + {days} < n)""",
        f"fin AS (SELECT symbol, sim, n, s0, price AS final FROM paths WHERE day = {days})",
    ]


def _params(spark, sf):
    return sc.parameters(tables.index_bars(spark, sf))


@query("scn_01_parameters", q.with_(*scenario_sql(1)) + f"SELECT symbol, n, {q.rnds(['mu', 'sigma', 's0'], 9)} FROM par")
def scn_01(spark, sf):
    return _params(spark, sf).select("symbol", "n", *rounded_cols(["mu", "sigma", "s0"], 9))


@query(
    "scn_02_history_gate",
    q.with_(SPARSE_SQL)
    + """SELECT symbol, n_rows, n_prices, CASE WHEN n_rows < 30 THEN 'fewer than 30 rows' WHEN n_prices < 0.8 * n_rows THEN 'too many missing prices' WHEN lowest <= 0 THEN 'price not positive' END AS reason
FROM (SELECT symbol, count(*) AS n_rows, count(open_price) AS n_prices, min(open_price) AS lowest FROM facts GROUP BY 1)""",
)
def scn_02(spark, sf):
    return sc.history_error(sparse_facts(spark, sf).select("symbol", F.col("open_price").alias("close")))


@query(
    "scn_02_request_gate",
    """SELECT c_custkey, CASE WHEN period NOT IN ('7d', '1mo', '3mo', '6mo', '1y', '2y', '5y', '10y', 'max') THEN 'invalid period' WHEN days <= 0 THEN 'days must be positive'
  WHEN days > 1000 THEN 'days above 1000' WHEN sims <= 0 THEN 'simulations must be positive' WHEN sims > 10000 THEN 'simulations above 10000' END AS reason FROM (
  SELECT c_custkey, (c_nationkey + 1) || 'y' AS period, c_nationkey * 300 - 300 AS days, c_custkey * 20 - 100 AS sims FROM customer)""",
)
def scn_02_request(spark, sf):
    c = tables.table(spark, sf, "customer")
    period = F.concat((F.col("c_nationkey") + 1).cast("string"), F.lit("y"))
    reason = sc.request_error(period, F.col("c_nationkey") * 300 - 300, F.col("c_custkey") * 20 - 100)
    return c.select("c_custkey", reason.alias("reason"))


@query("scn_03_paths", q.with_(*scenario_sql(DAYS)) + f"SELECT symbol, sim, day, {q.rnd('price')} AS price FROM paths")
def scn_03(spark, sf):
    return sc.paths(tables.index_bars(spark, sf), DAYS).withColumn("price", rounded("price"))


STAT_SQL = """stats AS (SELECT *, 100 * (mean / start - 1) AS expected_return_pct, std / mean AS cv FROM (
  SELECT symbol, any_value(s0) AS start, avg(final) AS mean, quantile_cont(final, 0.5) AS median, min(final) AS min, max(final) AS max, stddev_pop(final) AS std,
    quantile_cont(final, 0.05) AS p5, quantile_cont(final, 0.95) AS p95, avg((final > s0)::INT) AS up FROM fin GROUP BY 1))"""


@query("scn_04_statistics", q.with_(*scenario_sql(DAYS), STAT_SQL) + f"SELECT symbol, {q.rnds(sc.STATS)} FROM stats")
def scn_04(spark, sf):
    df = sc.statistics(sc.final_prices(tables.index_bars(spark, sf), DAYS))
    return df.select("symbol", *rounded_cols(sc.STATS))


@query(
    "scn_05_risk_report",
    q.with_(*scenario_sql(DAYS), STAT_SQL)
    + f"""SELECT symbol, {q.rnd('expected_return_pct', 2)} AS expected_return_pct, CASE WHEN cv < 0.1 THEN 'low' WHEN cv < 0.3 THEN 'moderate' ELSE 'high' END AS risk,
  {q.rnd('100 * up', 1)} AS profit_probability_pct, {q.rnd('p5', 2)} AS band_low, {q.rnd('p95', 2)} AS band_high FROM stats""",
)
def scn_05(spark, sf):
    return sc.risk_report(sc.statistics(sc.final_prices(tables.index_bars(spark, sf), DAYS)))


CLASS_PROB_SQL = """sr AS (SELECT symbol, n, (final - s0) / s0 AS ret FROM fin),
sq AS (SELECT symbol, least(0.03, greatest(0.002, abs(CASE WHEN n < 1000 THEN quantile_cont(ret, 0.94) WHEN n < 5000 THEN quantile_cont(ret, 0.95) ELSE quantile_cont(ret, 0.96) END))) AS upper,
  -least(0.03, greatest(0.002, abs(CASE WHEN n < 1000 THEN quantile_cont(ret, 0.06) WHEN n < 5000 THEN quantile_cont(ret, 0.05) ELSE quantile_cont(ret, 0.04) END))) AS lower FROM sr GROUP BY symbol, n),
sprob AS (SELECT symbol, upper, lower, avg((ret < lower)::INT) AS s0, 1 - avg((ret < lower)::INT) - avg((ret > upper)::INT) AS s1, avg((ret > upper)::INT) AS s2 FROM sr JOIN sq USING (symbol) GROUP BY 1, 2, 3)"""
FIVE = scenario_sql(5)


@query("scn_06_class_probabilities", q.with_(*FIVE, CLASS_PROB_SQL) + f"SELECT symbol, {q.rnds(['upper', 'lower', 's0', 's1', 's2'])} FROM sprob")
def scn_06(spark, sf):
    df = sc.class_probabilities(sc.final_prices(tables.index_bars(spark, sf), 5))
    return df.select("symbol", *rounded_cols(["upper", "lower", "s0", "s1", "s2"]))


BLEND_SQL = [
    *FIVE,
    CLASS_PROB_SQL,
    CLASS_SQL,
    SCORED_SQL,
    """model AS (SELECT symbol, arg_max(p0, ts) AS p0, arg_max(p1, ts) AS p1, arg_max(p2, ts) AS p2 FROM scored GROUP BY 1),
bl AS (SELECT *, greatest(b0, b1, b2) AS blend_confidence, CASE WHEN b0 >= b1 AND b0 >= b2 THEN 0 WHEN b1 >= b2 THEN 1 ELSE 2 END AS blend_class FROM (
  SELECT m.*, 0.7 * p0 + 0.3 * s0 AS b0, 0.7 * p1 + 0.3 * s1 AS b1, 0.7 * p2 + 0.3 * s2 AS b2 FROM model m JOIN sprob USING (symbol)))""",
]


def _blended(spark, sf):
    row = F.max_by(F.struct("p0", "p1", "p2"), "ts")
    model = scored(spark, sf).groupBy("symbol").agg(row.alias("p")).select("symbol", "p.*")
    return sc.blend(model, sc.class_probabilities(sc.final_prices(tables.index_bars(spark, sf), 5)))


@query(
    "scn_07_blend",
    q.with_(*BLEND_SQL) + f"SELECT symbol, {q.rnds(['b0', 'b1', 'b2', 'blend_confidence'])}, blend_class, blend_confidence >= 0.6 AS accepted FROM bl",
)
def scn_07(spark, sf):
    return _blended(spark, sf).select("symbol", *rounded_cols(["b0", "b1", "b2", "blend_confidence"]), "blend_class", "accepted")


@query(
    "scn_08_final_pick",
    q.with_(*BLEND_SQL)
    + f"""SELECT symbol, CASE WHEN ok THEN blend_class WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS final_class,
  {', '.join(f"{q.rnd(f'CASE WHEN ok THEN b{i} ELSE p{i} END')} AS f{i}" for i in range(3))}, CASE WHEN ok THEN 'ensemble' ELSE 'model' END AS method
FROM (SELECT *, blend_confidence >= 0.6 AS ok FROM bl)""",
)
def scn_08(spark, sf):
    df = sc.final_pick(_blended(spark, sf))
    return df.select("symbol", "final_class", *rounded_cols(["f0", "f1", "f2"]), "method")


@query(
    "srt_04_median_path",
    q.with_(*[x.replace("paths AS (", "paths AS MATERIALIZED (").replace("fin AS (", "fin AS MATERIALIZED (") for x in scenario_sql(DAYS)])
    + f"""SELECT symbol, sim, day, {q.rnd('price')} AS price FROM paths JOIN (SELECT symbol, sim FROM (
  SELECT symbol, sim, row_number() OVER (PARTITION BY symbol ORDER BY final, sim) - 1 AS place, count(*) OVER (PARTITION BY symbol) AS c FROM fin) WHERE place = c // 2) USING (symbol, sim)""",
)
def srt_04(spark, sf):
    return lk.median_path(sc.paths(tables.index_bars(spark, sf), DAYS)).withColumn("price", rounded("price"))


@query(
    "srt_05_thinned_paths",
    q.with_(*scenario_sql(DAYS)) + f"SELECT symbol, sim, day, {q.rnd('price')} AS price FROM paths WHERE sim % greatest(1, (n - {DAYS}) // 50) = 0 AND sim < 50 * greatest(1, (n - {DAYS}) // 50)",
)
def srt_05(spark, sf):
    return lk.thin_paths(sc.paths(tables.index_bars(spark, sf), DAYS)).withColumn("price", rounded("price"))


# -- backtest ---------------------------------------------------------------------------------


def curve_sql(src: str, keys: str) -> str:
    """Equity by recursion over the bars, the rest by windows."""
    k = ", ".join(keys.split())
    on = " AND ".join(f"e.{x} = g.{x}" for x in keys.split())
    gk = ", ".join(f"g.{x}" for x in keys.split())
    return f"""held AS (SELECT *, coalesce(last_value(CASE WHEN signal <> 0 THEN signal END IGNORE NULLS) OVER (PARTITION BY {k} ORDER BY rn), 0) AS h FROM {src}),
pos AS (SELECT *, coalesce(lag(h) OVER (PARTITION BY {k} ORDER BY rn), 0) AS p1, coalesce(lag(close) OVER (PARTITION BY {k} ORDER BY rn), open) AS pcl FROM held),
pos2 AS (SELECT *, coalesce(lag(p1) OVER (PARTITION BY {k} ORDER BY rn), 0) AS p0 FROM pos),
gr AS (SELECT *, 1 + p0 * (open - pcl) / pcl AS onn, 1 - 0.002 * abs(p1 - p0) AS fee, 1 + p1 * (close - open) / open AS intr FROM pos2),
eq AS (
  SELECT {k}, rn, 100000.0 * onn * fee * intr AS equity FROM gr WHERE rn = 0
  UNION ALL
  SELECT {gk}, g.rn, greatest(0, e.equity * g.onn * g.fee * g.intr) FROM eq e JOIN gr g ON {on} AND g.rn = e.rn + 1),
cv AS (SELECT gr.*, eq.equity, sum((p1 <> p0)::INT) OVER (PARTITION BY {k} ORDER BY rn) AS run,
  equity / coalesce(lag(equity) OVER (PARTITION BY {k} ORDER BY rn), 100000) - 1 AS r,
  equity / greatest(100000, max(equity) OVER (PARTITION BY {k} ORDER BY rn)) - 1 AS dd FROM gr JOIN eq USING ({k}, rn)),
tg AS (SELECT *, CASE WHEN p1 <> p0 THEN fee * intr ELSE onn * fee * intr END
  * CASE WHEN lead(run) OVER (PARTITION BY {k} ORDER BY rn) > run THEN lead(onn) OVER (PARTITION BY {k} ORDER BY rn) ELSE 1 END AS tf FROM cv),
tr AS (SELECT {k}, run, product(tf) - 1 AS pct FROM tg WHERE p1 <> 0 GROUP BY {k}, run),
ts AS (SELECT {k}, count(*) AS n_trades, 100 * avg((pct > 0)::INT) AS win_rate_pct, sum(pct) FILTER (pct > 0) / nullif(-sum(pct) FILTER (pct < 0), 0) AS profit_factor,
  100 * avg(pct) AS avg_trade_pct FROM tr GROUP BY {k}),
cs AS (SELECT {k}, arg_max(equity, rn) AS final_equity, 100 * (arg_max(equity, rn) / 100000 - 1) AS return_pct, 100 * (arg_max(close, rn) / arg_min(close, rn) - 1) AS buy_hold_pct,
  100 * min(dd) AS max_drawdown_pct, sqrt(252) * avg(r) / nullif(stddev_samp(r), 0) AS sharpe,
  sqrt(252) * avg(r) / nullif(sqrt(sum(CASE WHEN r < 0 THEN r * r ELSE 0 END) / count(*)), 0) AS sortino FROM cv GROUP BY {k}),
bt AS (SELECT cs.*, coalesce(n_trades, 0) AS n_trades, win_rate_pct, profit_factor, avg_trade_pct FROM cs LEFT JOIN ts USING ({k}))"""


BT_NUMBERS = [s for s in bk.STATS if s != "n_trades"]


@query(
    "bkt_01_equity_curve",
    q.with_(q.INDEX_BARS, q.NUMBERED, SIGNAL_SQL, curve_sql("sg", "symbol")) + f"SELECT symbol, ts, signal, p1 AS position, {q.rnd('equity', 4)} AS equity FROM cv",
)
def bkt_01_curve(spark, sf):
    df = bk.equity_curve(bk.sma_cross(tables.index_bars(spark, sf)))
    return df.select("symbol", "ts", "signal", "position", rounded("equity", 4).alias("equity"))


@query(
    "bkt_01_cross_backtest",
    q.with_(q.INDEX_BARS, q.NUMBERED, SIGNAL_SQL, curve_sql("sg", "symbol")) + f"SELECT symbol, n_trades, {q.rnds(BT_NUMBERS, 4)} FROM bt",
)
def bkt_01(spark, sf):
    return bk.backtest(tables.index_bars(spark, sf)).select("symbol", "n_trades", *rounded_cols(BT_NUMBERS, 4))


SPANS = sorted({*range(5, 31, 5), *range(10, 71, 5)})
GRID_SQL = f"""gm AS (SELECT *, {', '.join(f"{q.roll('avg', 'close', n)} AS m{n}" for n in SPANS)} FROM num),
gs AS (SELECT symbol, rn, open, close, n1, n2, sign(f - s) AS d FROM (SELECT symbol, rn, open, close, n1, n2, CASE n1 {' '.join(f'WHEN {n} THEN m{n}' for n in SPANS)} END AS f,
  CASE n2 {' '.join(f'WHEN {n} THEN m{n}' for n in SPANS)} END AS s FROM gm, (SELECT CAST(a AS INTEGER) AS n1, CAST(b AS INTEGER) AS n2 FROM range(5, 31, 5) x(a), range(10, 71, 5) y(b) WHERE a < b))),
gg AS (SELECT *, CASE WHEN pd < 0 AND d > 0 THEN 1 WHEN pd > 0 AND d < 0 THEN -1 ELSE 0 END AS signal FROM (
  SELECT *, lag(d) OVER (PARTITION BY symbol, n1, n2 ORDER BY rn) AS pd FROM gs))"""


@query(
    "bkt_02_grid",
    q.with_(q.INDEX_BARS, q.NUMBERED, GRID_SQL, curve_sql("gg", "symbol n1 n2")) + f"SELECT symbol, n1, n2, n_trades, {q.rnds(BT_NUMBERS, 4)} FROM bt",
)
def bkt_02_grid(spark, sf):
    return bk.grid_backtest(tables.index_bars(spark, sf)).select("symbol", "n1", "n2", "n_trades", *rounded_cols(BT_NUMBERS, 4))


@query(
    "bkt_02_optimise",
    q.with_(q.INDEX_BARS, q.NUMBERED, GRID_SQL, curve_sql("gg", "symbol n1 n2"))
    + f"""SELECT symbol, n1, n2, n_trades, {q.rnds(BT_NUMBERS, 4)} FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY final_equity DESC, n1, n2) AS d FROM bt) WHERE d = 1""",
)
def bkt_02(spark, sf):
    return bk.optimise(tables.index_bars(spark, sf)).select("symbol", "n1", "n2", "n_trades", *rounded_cols(BT_NUMBERS, 4))


@query(
    "srt_03_best_of_grid",
    q.with_(q.INDEX_BARS)
    + """SELECT symbol, month, n, place FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY n DESC, place) AS d FROM (
  SELECT symbol, month(ts) AS month, CAST(sum(volume) AS BIGINT) AS n, CAST(min(month(ts)) AS BIGINT) AS place FROM bars GROUP BY 1, 2)) WHERE d = 1""",
)
def srt_03(spark, sf):
    """Busiest calendar month per segment."""
    bars = tables.index_bars(spark, sf)
    month = F.month("ts").cast("long")
    per = bars.groupBy("symbol", month.alias("month")).agg(F.sum("volume").cast("long").alias("n"))
    best = lk.best_of_grid(per.withColumn("place", F.col("month")), "n", "place", ["symbol"], ["month"])
    return best.select("symbol", "month", "n", "place")


# -- alerts and dashboard -------------------------------------------------------------------------

# one rule per customer: segment as symbol, balance as price reference or RSI limit
RULES_SQL = """rules AS (SELECT c_custkey AS rule_id, c_mktsegment AS symbol, c_custkey % 4 AS t, 95 + c_acctbal / 1000 AS ref,
  CASE WHEN c_custkey % 8 >= 4 THEN 45 + c_nationkey END AS lim, c_custkey % 5 <> 0 AS active, CASE WHEN c_custkey % 3 = 0 THEN c_name END AS message FROM customer)"""


def _limit_sql(default: str) -> str:
    return f"CAST(coalesce(lim, {default}) AS INTEGER)"


def fired_sql(last: str) -> str:
    return f"""fired AS (SELECT rule_id, symbol, 'ALERT: ID:' || rule_id || ' - ' || symbol || coalesce(' - ' || message, '') || what AS message FROM (
  SELECT rule_id, rules.symbol, message, CASE WHEN t = 0 AND close > ref THEN ' - Price (' || printf('%.2f', close) || ') ABOVE ' || printf('%.2f', ref) || '!'
    WHEN t = 1 AND close < ref THEN ' - Price (' || printf('%.2f', close) || ') BELOW ' || printf('%.2f', ref) || '!'
    WHEN t = 2 AND rsi_14 > {_limit_sql('70')} THEN ' - RSI (' || printf('%.2f', rsi_14) || ') OVERBOUGHT (> ' || {_limit_sql('70')} || ')!'
    WHEN t = 3 AND rsi_14 < {_limit_sql('30')} THEN ' - RSI (' || printf('%.2f', rsi_14) || ') OVERSOLD (< ' || {_limit_sql('30')} || ')!' END AS what
  FROM rules JOIN ({last}) b ON b.symbol = rules.symbol WHERE active) WHERE what IS NOT NULL)"""


def rules(spark, sf):
    c = tables.table(spark, sf, "customer")
    kind = F.element_at(F.array(*[F.lit(t) for t in ("price_above", "price_below", "rsi_sobrecompra", "rsi_oversold")]), (F.col("c_custkey") % 4 + 1).cast("int"))
    limit = F.when(F.col("c_custkey") % 8 >= 4, (F.col("c_nationkey") + 45).cast("double"))
    condition = F.to_json(F.struct((95 + F.col("c_acctbal") / 1000).alias("reference"), limit.alias("rsi_limit")))
    raw = c.select(
        F.col("c_custkey").alias("rule_id"),
        F.col("c_mktsegment").alias("symbol"),
        kind.alias("type"),
        condition.alias("condition"),
        (F.col("c_custkey") % 5 != 0).alias("active"),
        F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).alias("message"),
    )
    return al.parse_rules(raw)


LAST_RSI = "SELECT num.symbol, close, rsi_14 FROM num JOIN rsi USING (symbol, rn) JOIN (SELECT symbol, max(rn) AS rn FROM num GROUP BY 1) m USING (symbol, rn)"
RSI_BASE = [q.INDEX_BARS, q.NUMBERED, q.MOVES, q.RSI]


@query("alr_01_rules", q.with_(*RSI_BASE, RULES_SQL, fired_sql(LAST_RSI)) + "SELECT rule_id, symbol, message FROM fired")
def alr_01(spark, sf):
    return al.evaluate_rules(al.latest_indicators(tables.index_bars(spark, sf)), rules(spark, sf))


RECENT = q.INDEX_BARS.replace("raw_bars AS (", "raw_bars0 AS (", 1).replace("FROM raw_bars)", "FROM raw_bars0 WHERE ts BETWEEN DATE '2001-08-01' - 260 AND DATE '2001-08-01' QUALIFY count(*) OVER (PARTITION BY symbol) >= 60)")


AS_OF = date(2001, 8, 1)


def recent_bars(spark, sf):
    """The history an alert cycle needs; the range is pushed into the scan of the orders."""
    return tables.index_bars(spark, sf, AS_OF - timedelta(days=al.HISTORY_DAYS), AS_OF)


@query(
    "alr_02_alert_run",
    q.with_(RECENT, q.NUMBERED, q.MOVES, q.RSI, RULES_SQL, fired_sql(LAST_RSI)) + "SELECT rule_id, symbol, message FROM fired WHERE rule_id % 10 <> 1",
)
def alr_02(spark, sf):
    """Rules whose number ends in 1 fired in the cycle before."""
    bars, rl = recent_bars(spark, sf), rules(spark, sf)
    fired = al.alert_run(bars, rl.filter("rule_id % 10 = 1"), F.lit(AS_OF))
    return al.alert_run(bars, rl, F.lit(AS_OF), fired)


@query("joi_04_rules_latest_bar", q.with_(*RSI_BASE, RULES_SQL, fired_sql(LAST_RSI)) + "SELECT symbol, count(*) AS n FROM fired GROUP BY 1")
def joi_04(spark, sf):
    fired = al.evaluate_rules(al.latest_indicators(tables.index_bars(spark, sf)), rules(spark, sf))
    return fired.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


@query(
    "joi_05_not_fired",
    q.with_(*RSI_BASE, RULES_SQL, fired_sql(LAST_RSI)) + "SELECT rule_id, symbol, message FROM fired WHERE rule_id % 2 = 1",
)
def joi_05(spark, sf):
    fired = al.evaluate_rules(al.latest_indicators(tables.index_bars(spark, sf)), rules(spark, sf))
    return al.not_fired(fired, fired.filter("rule_id % 2 = 0"))


@query("joi_06_rule_symbols", "SELECT DISTINCT c_mktsegment AS symbol FROM customer WHERE c_custkey % 5 <> 0")
def joi_06(spark, sf):
    return al.rule_symbols(rules(spark, sf))


@query(
    "dsh_01_dashboard",
    q.with_(q.NATION_BARS, q.NUMBERED, POINTS_SQL, f"quo AS ({QUOTE_SQL})")
    + f"""SELECT 'quotes' AS section, symbol AS name, ts, price AS value, change_pct FROM quo
UNION ALL SELECT 'macro', series_id, max(date), {q.rnd('arg_max_null(value, date)')}, CAST(NULL AS DOUBLE) FROM points GROUP BY 2
UNION ALL SELECT 'series', series_id, date, {q.rnd('value')}, CAST(NULL AS DOUBLE) FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date DESC) AS d FROM points) WHERE d <= 5""",
)
def dsh_01(spark, sf):
    """Quotes of every symbol, latest macro values and the tails of their series."""
    points = month_points(spark, sf)
    macro = points.groupBy("series_id").agg(F.max("date").alias("date"), F.max_by("value", "date").alias("value"))
    quotes = lk.quote_from_history(tables.nation_bars(spark, sf))
    return al.dashboard(quotes, macro, points).withColumns({"value": rounded("value"), "change_pct": rounded("change_pct")})
