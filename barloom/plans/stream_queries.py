"""Streaming queries: each runs a stream to its end and reads what it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.expr import rounded, rounded_cols
from barloom.plans import sql as q
from barloom.plans.registry import query
from barloom.plans.scenario_queries import LAST_RSI, fired_sql
from barloom.plans.source_queries import BAR_COLS
from barloom.session import new_path, stored
from barloom.sources import tables
from barloom.streaming import rsi_state, snapshots, ticks

# bars whose end the watermark (newest tick minus one hour) has passed
EMITTED_SQL = [
    q.EVENT_BARS.replace("bars AS", "all_bars AS", 1),
    "bars AS (SELECT * FROM all_bars WHERE ts + INTERVAL 2 HOUR <= (SELECT date_trunc('millisecond', max(ts)) FROM events))",
]
BAR_SCHEMA = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double"


def arriving(spark, sf):
    """The event table as a stream of four micro-batches in order of time."""
    path = new_path(spark, "events")
    files = ticks.in_order_of_time(spark, tables.table(spark, sf, "events"), path)
    return ticks.event_stream(spark, f"{path}/*", files, "part-*.parquet")


def _bar_files(spark, sf) -> str:
    path = new_path(spark, "stream-bars")
    stream = ticks.bar_rows(ticks.streaming_bars(arriving(spark, sf)))
    ticks.run_to_files(stream, path, new_path(spark, "stream-bars-checkpoint"))
    return path


@query("str_01_streaming_bars", q.with_(*EMITTED_SQL) + f"SELECT symbol, ts, {q.rnds(BAR_COLS)} FROM bars")
def str_01(spark, sf):
    return spark.read.schema(BAR_SCHEMA).parquet(_bar_files(spark, sf)).select("symbol", "ts", *rounded_cols(BAR_COLS))


# one price rule per user and event type, on the user's largest value
EVENT_RULES_SQL = """rules AS (SELECT event_type AS symbol, user_id * 1000 + ascii(event_type) AS rule_id, user_id % 2 AS t, max(value) / 3 AS ref FROM events WHERE user_id % 7 <> 0 GROUP BY event_type, user_id)"""


def event_rules(spark, sf):
    ev = tables.table(spark, sf, "events")
    agg = ev.groupBy("event_type", "user_id").agg((F.max("value") / 3).alias("ref"))
    return agg.select(
        F.col("event_type").alias("symbol"),
        (F.col("user_id") * 1000 + F.ascii("event_type")).alias("rule_id"),
        F.when(F.col("user_id") % 2 == 0, "price_above").otherwise("price_below").alias("type"),
        F.struct(F.col("ref").alias("reference"), F.lit(None).cast("double").alias("rsi_limit")).alias("condition"),
        (F.col("user_id") % 7 != 0).alias("active"),
    )


FIRED_SQL = "fired AS (SELECT rule_id, rules.symbol, ts, close, ref, t FROM bars JOIN rules USING (symbol) WHERE CASE t WHEN 0 THEN close > ref ELSE close < ref END)"


@query(
    "str_02_price_alerts",
    q.with_(*EMITTED_SQL, EVENT_RULES_SQL, FIRED_SQL)
    + """SELECT rule_id, symbol, 'ALERT: ID:' || rule_id || ' - ' || symbol || ' - Price (' || printf('%.2f', close) || ') ' || CASE t WHEN 0 THEN 'ABOVE' ELSE 'BELOW' END || ' ' || printf('%.2f', ref) || '!' AS message FROM fired""",
)
def str_02(spark, sf):
    path = new_path(spark, "stream-alerts")
    bars = ticks.streaming_bars(arriving(spark, sf))
    alerts = ticks.price_alerts(bars, event_rules(spark, sf)).drop("at")
    ticks.run_to_files(alerts, path, new_path(spark, "stream-alerts-checkpoint"))
    return spark.read.schema("rule_id bigint, symbol string, message string").parquet(path)


@query(
    "str_03_fire_once",
    q.with_(*EMITTED_SQL, EVENT_RULES_SQL, FIRED_SQL) + "SELECT rule_id, any_value(symbol) AS symbol FROM fired GROUP BY rule_id",
)
def str_03(spark, sf):
    path = new_path(spark, "stream-once")
    bars = ticks.streaming_bars(arriving(spark, sf))
    alerts = ticks.fire_once(ticks.price_alerts(bars, event_rules(spark, sf)))
    ticks.run_to_files(alerts.select("rule_id", "symbol"), path, new_path(spark, "stream-once-checkpoint"))
    return spark.read.schema("rule_id bigint, symbol string").parquet(path)


@query(
    "str_04_streaming_rsi",
    q.with_(*EMITTED_SQL, q.NUMBERED, q.MOVES, q.RSI)
    + f"SELECT symbol, ts, {q.rnd('close')} AS close, {q.rnd('rsi_14')} AS rsi_14 FROM num LEFT JOIN rsi USING (symbol, rn)",
)
def str_04(spark, sf):
    """Ticks to bars to RSI in one stream: two stateful steps under one watermark."""
    path = new_path(spark, "stream-rsi")
    bars = ticks.streaming_bars(arriving(spark, sf)).select("symbol", F.col("w.start").cast("timestamp_ntz").alias("ts"), "close", F.window_time("w").alias("at"))
    ticks.run_to_files(rsi_state.streaming_rsi(bars, late=None), path, new_path(spark, "stream-rsi-checkpoint"), **rsi_state.STORE)
    out = spark.read.schema(rsi_state.OUTPUT).parquet(path)
    return out.select("symbol", "ts", rounded("close").alias("close"), rounded("rsi_14").alias("rsi_14"))


# a rule per user and event type: prices or RSI, by the user's number
CYCLE_RULES_SQL = """rules AS (SELECT event_type AS symbol, user_id * 1000 + ascii(event_type) AS rule_id, user_id % 4 AS t, max(value) / 3 AS ref,
  CASE WHEN user_id % 8 >= 4 THEN 45 + user_id % 13 END AS lim, user_id % 7 <> 0 AS active, CAST(NULL AS VARCHAR) AS message FROM events GROUP BY event_type, user_id)"""
# the ticks known after each of the four batches, as symbols of their own
PREFIX_SQL = [
    """ticks AS (SELECT event_type || '#' || p AS symbol, ts, event_id, value FROM events, range(1, 5) x(p)
  WHERE p = 4 OR epoch_us(ts) < (SELECT epoch_us(min(ts)) + (epoch_us(max(ts)) - epoch_us(min(ts))) * p / 4.0 FROM events))""",
    """all_bars AS (SELECT symbol, date_trunc('hour', ts) AS ts, arg_min(value, event_id) AS open, max(value) AS high, min(value) AS low,
  arg_max(value, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume FROM ticks GROUP BY 1, 2)""",
    """bars AS (SELECT * FROM (SELECT * FROM all_bars QUALIFY CAST(ts AS DATE) >= CAST(max(ts) OVER (PARTITION BY symbol) AS DATE) - 260) QUALIFY count(*) OVER (PARTITION BY symbol) >= 60)""",
]
PREFIX_LAST = "SELECT regexp_replace(symbol, '#.$', '') AS symbol, close, rsi_14 FROM (" + LAST_RSI + ")"


def cycle_rules(spark, sf):
    agg = tables.table(spark, sf, "events").groupBy("event_type", "user_id").agg((F.max("value") / 3).alias("ref"))
    user = F.col("user_id")
    kinds = F.array(*[F.lit(t) for t in ("price_above", "price_below", "rsi_overbought", "rsi_oversold")])
    limit = F.when(user % 8 >= 4, (45 + user % 13).cast("double"))
    return agg.select(
        F.col("event_type").alias("symbol"),
        (user * 1000 + F.ascii("event_type")).alias("rule_id"),
        F.get(kinds, (user % 4).cast("int")).alias("type"),
        F.struct(F.col("ref").alias("reference"), limit.alias("rsi_limit")).alias("condition"),
        (user % 7 != 0).alias("active"),
        F.lit(None).cast("string").alias("message"),
    )


@query(
    "str_05_alert_cycles",
    q.with_(*PREFIX_SQL, q.NUMBERED, q.MOVES, q.RSI, CYCLE_RULES_SQL, fired_sql(PREFIX_LAST)) + "SELECT DISTINCT rule_id, symbol, message FROM fired",
)
def str_05(spark, sf):
    """An alert cycle per micro-batch, each on its own ticks and the snapshot of the batch before."""
    path = new_path(spark, "alert-cycles")
    rules = stored(cycle_rules(spark, sf), "cycle-rules")
    cycle = snapshots.AlertSnapshots(new_path(spark, "alert-snapshots"), rules).cycle
    ticks.alert_cycles(arriving(spark, sf), cycle, path, new_path(spark, "alert-cycles-checkpoint"))
    schema = "rule_id bigint, symbol string, message string"
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path)
