"""Source, payload, store and sink queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.expr import rounded, rounded_cols
from barloom.operators import indicators as ind
from barloom.operators.profile import exact_quantiles
from barloom.plans import sql as q
from barloom.plans.registry import query
from barloom.session import new_path
from barloom.sources import bars as br
from barloom.sources import payloads as pl
from barloom.sources import sinks, store, tables

BAR_COLS = list(br.OHLCV)


@query("src_01_bars_daily", q.with_(q.ORDER_BARS) + f"SELECT symbol, ts, {q.rnds(BAR_COLS)} FROM bars")
def src_01(spark, sf):
    return tables.order_bars(spark, sf).select("symbol", "ts", *rounded_cols(BAR_COLS))


@query("src_01_bars_hourly", q.with_(q.EVENT_BARS) + f"SELECT symbol, ts, {q.rnds(BAR_COLS)} FROM bars")
def src_01_hourly(spark, sf):
    return tables.event_bars(spark, sf).select("symbol", "ts", *rounded_cols(BAR_COLS))


@query("src_01_bars_by_nation", q.with_(q.NATION_BARS) + f"SELECT symbol, ts, {q.rnds(BAR_COLS)} FROM bars")
def src_01_nation(spark, sf):
    return tables.nation_bars(spark, sf).select("symbol", "ts", *rounded_cols(BAR_COLS))


def _resampled_sql(unit: str) -> str:
    return q.with_(q.ORDER_BARS) + f"""SELECT symbol, CAST(date_trunc('{unit}', ts) AS DATE) AS ts,
  {q.rnd('arg_min(open, ts)')} AS open, {q.rnd('max(high)')} AS high, {q.rnd('min(low)')} AS low,
  {q.rnd('arg_max(close, ts)')} AS close, {q.rnd('sum(volume)')} AS volume FROM bars GROUP BY 1, 2"""


@query("src_01_bars_weekly", _resampled_sql("week"))
def src_01_weekly(spark, sf):
    return br.resample(tables.order_bars(spark, sf), "1wk").select("symbol", "ts", *rounded_cols(BAR_COLS))


@query("src_01_bars_monthly", _resampled_sql("month"))
def src_01_monthly(spark, sf):
    return br.resample(tables.order_bars(spark, sf), "1mo").select("symbol", "ts", *rounded_cols(BAR_COLS))


@query(
    "src_02_normalise",
    f"""SELECT CAST(o_custkey AS VARCHAR) AS symbol, o_orderkey AS seq, CAST(o_orderdate AS DATE) AS ts,
  {q.rnd('o_totalprice')} AS open, {q.rnd("CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END")} AS high,
  CAST(NULL AS DOUBLE) AS low, {q.rnd('o_totalprice')} AS close,
  {q.rnd("CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END")} AS volume, o_orderpriority AS note FROM orders""",
)
def src_02(spark, sf):
    """Raw columns in any case, text with junk in it, no low price at all."""
    o = tables.table(spark, sf, "orders")
    raw = o.select(
        F.col("o_custkey").cast("string").alias("symbol"),
        F.col("o_orderdate").cast("date").alias("ts"),
        F.col("o_orderpriority").alias("note"),
        F.when(F.col("o_orderstatus") != "F", F.lit("1")).alias("VOLUME"),
        F.col("o_totalprice").cast("string").alias("Close"),
        F.col("o_totalprice").alias("OPEN"),
        F.when(F.col("o_orderstatus") == "P", "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("High"),
        F.col("o_orderkey").alias("seq"),
    )
    return br.normalise(raw).select("symbol", "seq", "ts", *rounded_cols(BAR_COLS), "note")


@query("src_03_columnar_payload", q.with_(q.ORDER_BARS) + f"SELECT symbol, ts, {q.rnds(BAR_COLS)} FROM bars")
def src_03(spark, sf):
    raw = pl.to_columnar_payload(tables.order_bars(spark, sf))
    return pl.columnar_bars(raw).select("symbol", F.col("ts").cast("date").alias("ts"), *rounded_cols(BAR_COLS))


@query(
    "src_04_dated_payload",
    q.with_(q.ORDER_BARS) + f"SELECT symbol, ts, {q.rnds(BAR_COLS)}, {q.rnd('close')} AS adj_close FROM bars",
)
def src_04(spark, sf):
    raw = pl.to_dated_payload(tables.order_bars(spark, sf))
    return pl.dated_bars(raw).select("symbol", "ts", *rounded_cols(BAR_COLS + ["adj_close"]))


POINTS_SQL = """points AS (SELECT o_orderpriority AS series_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS date,
  CASE WHEN month(o_orderdate) % 5 = 0 THEN NULL ELSE CAST(count(*) AS DOUBLE) / 4 END AS value
  FROM orders GROUP BY 1, 2, month(o_orderdate))"""


def month_points(spark, sf):
    """Monthly order counts per priority; May and October have no value."""
    o = tables.table(spark, sf, "orders").select("o_orderpriority", "o_orderdate")
    month = F.trunc(F.col("o_orderdate").cast("date"), "month")
    agg = o.groupBy(F.col("o_orderpriority").alias("series_id"), month.alias("date")).agg(F.count(F.lit(1)).alias("n"))
    return agg.select("series_id", "date", F.when(F.month("date") % 5 != 0, F.col("n") / 4.0).alias("value"))


def _series_payload(points):
    row = F.struct(F.col("date").cast("string").alias("d"), "value")
    packed = points.groupBy("series_id").agg(F.sort_array(F.collect_list(row)).alias("r"))
    body = F.to_json(F.struct(F.col("r.d").alias("date"), F.col("r.value").alias("value")))
    return packed.select("series_id", body.alias("payload"))


@query("src_05_series_payload", q.with_(POINTS_SQL) + f"SELECT series_id, date, {q.rnd('value')} AS value FROM points")
def src_05(spark, sf):
    points = pl.series_points(_series_payload(month_points(spark, sf)), "date", "value")
    return points.withColumn("value", rounded("value"))


@query(
    "src_05_series_payload_no_null",
    q.with_(POINTS_SQL) + f"SELECT series_id, date, {q.rnd('value')} AS value FROM points WHERE value IS NOT NULL",
)
def src_05_no_null(spark, sf):
    points = pl.series_points(_series_payload(month_points(spark, sf)), "date", "value", keep_null=False)
    return points.withColumn("value", rounded("value"))


FX_SQL = """rates AS (SELECT CASE WHEN day(d) = 13 THEN NULL ELSE d + INTERVAL 13 HOUR END AS ts,
  CASE WHEN isodow(d) = 7 THEN NULL WHEN isodow(d) = 3 THEN 0.0 ELSE n / 8 END AS rate
  FROM (SELECT CAST(o_orderdate AS DATE) AS d, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY 1))"""


def fx_payload(spark, sf):
    """One payload per year of daily rates: Sundays null, Wednesdays zero, the 13th unreadable."""
    o = tables.table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("d"))
    daily = o.groupBy("d").agg(F.count(F.lit(1)).cast("double").alias("n"))
    at = F.when(F.dayofmonth("d") == 13, "n/a").otherwise(F.concat(F.col("d").cast("string"), F.lit("T13:00:00")))
    rate = F.when(F.dayofweek("d") == 1, None).when(F.dayofweek("d") == 4, 0.0).otherwise(F.col("n") / 8)
    rows = daily.select(F.year("d").alias("year"), F.struct("d", at.alias("at"), rate.alias("rate")).alias("r"))
    packed = rows.groupBy("year").agg(F.sort_array(F.collect_list("r")).alias("r"))
    body = F.to_json(F.struct(F.col("r.at").alias("dataHoraCotacao"), F.col("r.rate").alias("cotacaoVenda")))
    return packed.select("year", body.alias("payload"))


@query("src_06_fx_payload", q.with_(FX_SQL) + f"SELECT ts, {q.rnd('rate')} AS rate FROM rates")
def src_06(spark, sf):
    return pl.fx_rates(fx_payload(spark, sf)).withColumn("rate", rounded("rate"))


@query(
    "src_07_expectations",
    f"""SELECT '2-HIGH' AS indicator, CAST(year(o_orderdate) AS INTEGER) AS year, {q.rnd('avg(o_totalprice)', 4)} AS mean,
  {q.rnd('median(o_totalprice)')} AS median FROM orders
  WHERE o_orderpriority = '2-HIGH' AND o_orderstatus <> 'P' AND year(o_orderdate) BETWEEN 1997 AND 1998 GROUP BY 2""",
)
def src_07(spark, sf):
    """Yearly expectations per priority; those of pending orders have no numeric year."""
    o = tables.table(spark, sf, "orders").select("o_orderpriority", "o_orderdate", "o_totalprice", "o_orderstatus")
    year = F.year("o_orderdate").cast("string")
    ref = F.when(F.col("o_orderstatus") == "P", F.concat(year, F.lit("-T1"))).otherwise(year)
    keys = ["o_orderpriority", "ref"]
    facts = o.select("o_orderpriority", ref.alias("ref"), "o_totalprice")
    medians = exact_quantiles(facts, "o_totalprice", [0.5], keys).select(*keys, F.col("value").alias("median"))
    agg = facts.groupBy(*keys).agg(F.avg("o_totalprice").alias("mean")).join(medians, keys)
    packed = agg.groupBy("o_orderpriority").agg(F.collect_list(F.struct("ref", "mean", "median")).alias("r"))
    body = F.struct(
        F.transform("r", lambda x: F.col("o_orderpriority")).alias("Indicador"),
        F.col("r.ref").alias("DataReferencia"),
        F.col("r.mean").alias("Media"),
        F.col("r.median").alias("Mediana"),
    )
    raw = packed.select(F.to_json(body).alias("payload"))
    out = pl.expectations(raw, "2-HIGH", 1997, 2)
    return out.select("indicator", "year", rounded("mean", 4).alias("mean"), rounded("median").alias("median"))


QUOTE_COLS = ["price", "change", "change_pct", "open", "high", "low", "prev_close"]


@query(
    "src_08_quotes",
    q.with_(q.EVENT_BARS, q.NUMBERED)
    + f"""SELECT symbol, CAST(epoch(ts) AS BIGINT) AS quoted_at, {q.rnds(QUOTE_COLS)} FROM (
  SELECT symbol, ts, CASE WHEN close < 1 THEN 0 WHEN close > 200 THEN NULL ELSE close END AS price, close - pc AS change,
    100 * (close - pc) / nullif(pc, 0) AS change_pct, open, high, low, pc AS prev_close FROM num)
  WHERE price IS NOT NULL AND price <> 0""",
)
def src_08(spark, sf):
    """One quote payload per bar; a price below 1 arrives as 0, one above 200 as null."""
    bars = tables.event_bars(spark, sf)
    f = ind.by_symbol(bars).frames
    prev = F.lag("close").over(f.ordered())
    c = F.when(F.col("close") < 1, 0.0).when(F.col("close") <= 200, F.col("close"))
    fields = {
        "c": c,
        "d": F.col("close") - prev,
        "dp": 100.0 * (F.col("close") - prev) / F.nullif(prev, F.lit(0.0)),
        "o": F.col("open"),
        "h": F.col("high"),
        "l": F.col("low"),
        "pc": prev,
        "t": F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts")),
    }
    raw = bars.select("symbol", F.struct(*[v.alias(k) for k, v in fields.items()]).alias("q"))
    raw = raw.select("symbol", F.to_json("q").alias("payload"))
    return pl.quotes(raw).select("symbol", "quoted_at", *rounded_cols(QUOTE_COLS))


STATEMENT_SQL = """counts AS (SELECT n_name AS symbol, year(o_orderdate) AS y, o_orderpriority AS concept, count(*) AS n
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3),
periods AS (SELECT symbol, y, row_number() OVER (PARTITION BY symbol ORDER BY y DESC) AS period FROM (SELECT DISTINCT symbol, y FROM counts)),
items AS (SELECT symbol, CAST(period AS INTEGER) AS period, make_date(y, 12, 31) AS end_date, concept,
  CASE WHEN n % 7 = 0 THEN 'None' WHEN n % 5 = 0 THEN NULL ELSE CAST(n * 1000 AS VARCHAR) END AS v
  FROM counts JOIN periods USING (symbol, y) WHERE period <= 3)"""


def statement_payload(spark, sf):
    """Yearly order counts (in thousands) per priority and nation as statements, newest
    year first; every concept is repeated with another value after the first one."""
    o = tables.table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderpriority")
    c = tables.table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    n = tables.table(spark, sf, "nation").select("n_nationkey", "n_name")
    df = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    counts = df.groupBy(
        F.col("n_name").alias("symbol"), F.year("o_orderdate").alias("y"), F.col("o_orderpriority").alias("concept")
    ).agg(F.count(F.lit(1)).alias("n"))
    value = (
        F.when(F.col("n") % 7 == 0, "None")
        .when(F.col("n") % 5 == 0, None)
        .otherwise(F.format_number(F.col("n") * 1000, 0))
    )
    item = F.struct("concept", value.alias("value"))
    periods = counts.groupBy("symbol", "y").agg(F.sort_array(F.collect_list(item)).alias("r"))
    again = F.transform("r", lambda i: F.struct(i.concept.alias("concept"), F.lit("1").alias("value")))
    period = F.struct(
        "y", F.format_string("%d-12-31", F.col("y")).alias("endDate"), F.concat("r", again).alias("report")
    )
    per_symbol = periods.groupBy("symbol").agg(F.sort_array(F.collect_list(period), asc=False).alias("p"))
    data = F.transform("p", lambda p: F.struct(p.endDate.alias("endDate"), p.report.alias("report")))
    return per_symbol.select("symbol", F.to_json(F.struct(data.alias("data"))).alias("payload"))


@query(
    "src_09_statement_items",
    q.with_(STATEMENT_SQL)
    + """SELECT symbol, period, end_date, concept, count(*) AS n_values FROM items, range(2) GROUP BY 1, 2, 3, 4""",
)
def src_09(spark, sf):
    items = pl.statement_items(statement_payload(spark, sf))
    return items.groupBy("symbol", "period", "end_date", "concept").agg(F.count(F.lit(1)).alias("n_values"))


@query(
    "src_10_statement_pivot",
    q.with_(STATEMENT_SQL)
    + "SELECT symbol, concept, "
    + ", ".join(f"{q.rnd(f'max(CASE WHEN period = {k} THEN TRY_CAST(v AS DOUBLE) END)')} AS period_{k}" for k in (1, 2, 3))
    + " FROM items GROUP BY 1, 2",
)
def src_10(spark, sf):
    df = pl.statement_pivot(pl.statement_items(statement_payload(spark, sf)))
    return df.select("symbol", "concept", *rounded_cols(["period_1", "period_2", "period_3"]))


VENDOR_SYMBOL_SQL = """CASE c_nationkey WHEN 0 THEN '^BVSP' WHEN 1 THEN '^GSPC' WHEN 2 THEN '^IXIC' WHEN 3 THEN '^OTHER'
  WHEN 4 THEN c_mktsegment || '.SA' ELSE c_mktsegment END"""


def vendor_symbols(spark, sf):
    k = F.col("c_nationkey")
    sym = (
        F.when(k == 0, "^BVSP")
        .when(k == 1, "^GSPC")
        .when(k == 2, "^IXIC")
        .when(k == 3, "^OTHER")
        .when(k == 4, F.concat("c_mktsegment", F.lit(".SA")))
        .otherwise(F.col("c_mktsegment"))
    )
    return tables.table(spark, sf, "customer").select("c_custkey", sym.alias("symbol"))


@query(
    "src_11_symbol_router",
    f"""SELECT c_custkey, symbol, CASE WHEN symbol = '^BVSP' OR symbol LIKE '%.SA' THEN 'brazil' ELSE 'united states' END AS country,
  CASE symbol WHEN '^BVSP' THEN 'Bovespa' WHEN '^GSPC' THEN 'S&P 500' WHEN '^IXIC' THEN 'Nasdaq Composite' ELSE replace(symbol, '.SA', '') END AS clean_symbol,
  CASE WHEN symbol IN ('^BVSP', '^GSPC', '^IXIC') THEN 'index' ELSE 'stock' END AS kind,
  CASE WHEN symbol LIKE '^%' THEN 'index' WHEN symbol LIKE '%.SA%' THEN 'stock_br' ELSE 'stock_us' END AS asset_class
FROM (SELECT c_custkey, {VENDOR_SYMBOL_SQL} AS symbol FROM customer)""",
)
def src_11(spark, sf):
    df = vendor_symbols(spark, sf).withColumn("r", br.route_symbol(F.col("symbol")))
    return df.select("c_custkey", "symbol", "r.*", br.asset_class(F.col("symbol")).alias("asset_class"))


@query(
    "src_12_source_fallback",
    """SELECT symbol, ts, priority, close FROM (
  SELECT *, min(priority) OVER (PARTITION BY symbol) AS best FROM (
    SELECT CAST(user_id AS VARCHAR) AS symbol, CAST(ts AS DATE) AS ts, round(value, 6) + 0.0 AS close,
      CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 3 END AS priority FROM events)
  WHERE priority < 3 OR ts BETWEEN DATE '2024-01-10' AND DATE '2024-01-20') WHERE priority = best""",
)
def src_12(spark, sf):
    """Values per user; clicks are the first source, views the second, the rest the third."""
    ev = tables.table(spark, sf, "events")
    kind = F.col("event_type")
    raw = ev.select(
        F.col("user_id").cast("string").alias("symbol"),
        F.col("ts").cast("date").alias("ts"),
        rounded("value").alias("close"),
        F.when(kind == "click", 1).when(kind == "view", 2).otherwise(3).alias("priority"),
    )
    day = lambda s: F.lit(s).cast("date")
    return br.first_source(raw, 3, day("2024-01-10"), day("2024-01-20"))


@query(
    "src_13_period_range",
    """SELECT c_custkey, period, DATE '2001-08-01' - CAST(days AS INTEGER) AS start_date, DATE '2001-08-01' AS end_date FROM (
  SELECT *, CASE k WHEN 0 THEN m * 365 WHEN 1 THEN m * 30 WHEN 2 THEN m ELSE 365 END AS days FROM (
    SELECT c_custkey, c_nationkey % 9 + 1 AS m, c_custkey % 4 AS k,
      CASE c_custkey % 4 WHEN 0 THEN (c_nationkey % 9 + 1) || 'y' WHEN 1 THEN (c_nationkey % 9 + 1) || 'mo'
        WHEN 2 THEN (c_nationkey % 9 + 1) || 'd' ELSE 'max' END AS period FROM customer))""",
)
def src_13(spark, sf):
    m, k = (F.col("c_nationkey") % 9 + 1).cast("string"), F.col("c_custkey") % 4
    period = (
        F.when(k == 0, F.concat(m, F.lit("y")))
        .when(k == 1, F.concat(m, F.lit("mo")))
        .when(k == 2, F.concat(m, F.lit("d")))
        .otherwise("max")
    )
    df = tables.table(spark, sf, "customer").select("c_custkey", period.alias("period"))
    lo, hi = br.period_range(F.col("period"), F.lit("2001-08-01").cast("date"))
    return df.select("c_custkey", "period", lo.alias("start_date"), hi.alias("end_date"))


@query(
    "src_14_payload_key",
    """SELECT event_id, md5('quote:' || event_type || ':{"days": ' || (event_id % 7) || ', "symbol": "' || event_type || '"}') AS key FROM events""",
)
def src_14(spark, sf):
    ev = tables.table(spark, sf, "events").select("event_id", "event_type")
    params = {"symbol": F.col("event_type"), "days": F.col("event_id") % 7}
    return ev.select("event_id", store.payload_key(F.lit("quote"), F.col("event_type"), params).alias("key"))


@query(
    "src_15_latest_payload",
    """SELECT key, value, ts, CASE WHEN 1706486400 - ts >= ttl THEN 'expired' WHEN value LIKE '%}' THEN 'live' ELSE 'bad_json' END AS state FROM (
  SELECT user_id AS key, arg_max(value, event_id) AS value, round(arg_max(ts, event_id), 3) AS ts, arg_max(ttl, event_id) AS ttl FROM (
    SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN left(props, 4) ELSE props END AS value,
      epoch(ts) AS ts, CASE WHEN event_type = 'view' THEN 60 ELSE 86400 * 5 END AS ttl FROM events) GROUP BY 1)""",
)
def src_15(spark, sf):
    """Event properties as cached payloads per user: views live a minute, others five
    days; the text of error events is cut off."""
    ev = tables.table(spark, sf, "events")
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    raw = ev.select(
        F.col("user_id").alias("key"),
        F.when(F.col("event_type") == "error", F.substring("props", 1, 4)).otherwise(F.col("props")).alias("value"),
        (F.timestamp_diff("MICROSECOND", epoch, F.col("ts")) / 1e6).alias("ts"),
        F.when(F.col("event_type") == "view", 60).otherwise(86400 * 5).alias("ttl"),
    )
    return store.latest_payload(raw, 1706486400.0).withColumn("ts", F.round("ts", 3))


@query(
    "src_16_upsert",
    f"""WITH ch AS (SELECT o_custkey AS k, arg_max(o_orderstatus, o_orderkey) AS st, arg_max(o_totalprice, o_orderkey) AS p FROM orders GROUP BY 1)
SELECT c_custkey, CASE WHEN st IS NULL THEN c_mktsegment ELSE st END AS segment, {q.rnd('coalesce(p, c_acctbal)')} AS balance
FROM customer LEFT JOIN ch ON k = c_custkey WHERE st IS NULL OR st <> 'F'""",
)
def src_16(spark, sf):
    """Customers updated by their orders; a last order that is filled deletes the row."""
    base = tables.table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
    o = tables.table(spark, sf, "orders")
    changes = o.select(
        F.col("o_custkey").alias("c_custkey"),
        F.col("o_orderstatus").alias("segment"),
        F.col("o_totalprice").alias("balance"),
        (F.col("o_orderstatus") == "F").alias("deleted"),
        F.col("o_orderkey").alias("seq"),
    )
    return store.upsert(base, changes, ["c_custkey"]).withColumn("balance", rounded("balance"))


@query(
    "src_16_unique_insert_update_delete",
    f"""SELECT k, CASE WHEN c.c_custkey IS NOT NULL AND o.p > 400000 THEN 'big' ELSE coalesce(c.c_mktsegment, 'new') END AS segment,
  {q.rnd('CASE WHEN c.c_custkey IS NOT NULL THEN coalesce(o.p, c.c_acctbal) ELSE o.p END')} AS balance FROM (
  SELECT c_custkey AS k FROM customer UNION SELECT o_custkey FROM orders)
  LEFT JOIN customer c ON c.c_custkey = k
  LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS p FROM orders GROUP BY 1) o ON o.o_custkey = k
  WHERE k % 10 <> 3""",
)
def src_16_parts(spark, sf):
    """Unique insert, update of some fields, delete."""
    cust = tables.table(spark, sf, "customer")
    base = cust.select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
    top = tables.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("balance"))
    changes = top.withColumn("segment", F.when(F.col("balance") > 400000, "big"))
    updated = store.update_fields(base, changes, ["k"], ["segment", "balance"])
    grown = store.insert_new(updated, top.withColumn("segment", F.lit("new")), ["k"])
    gone = grown.filter("k % 10 = 3").select("k")
    return store.delete_keys(grown, gone, ["k"]).withColumn("balance", rounded("balance"))


@query(
    "snk_01_delimited",
    q.with_(q.ORDER_BARS)
    + "SELECT symbol, strftime(ts, '%Y-%m-%d') AS ts, "
    + ", ".join(f"replace(CAST({c} AS VARCHAR), '.', ',') AS {c}" for c in BAR_COLS)
    + " FROM bars",
)
def snk_01(spark, sf):
    path = new_path(spark, "delimited")
    sinks.write_delimited(tables.order_bars(spark, sf), path)
    return spark.read.option("sep", ";").option("header", True).csv(path)


@query(
    "snk_02_report",
    q.with_(q.ORDER_BARS)
    + """SELECT unnest(['--- ' || symbol || ' ---', 'Number of bars: ' || n, 'First day: ' || lo, 'Last day: ' || hi, '--------------------']) AS value
  FROM (SELECT symbol, count(*) AS n, CAST(min(ts) AS VARCHAR) AS lo, CAST(max(ts) AS VARCHAR) AS hi FROM bars GROUP BY 1)""",
)
def snk_02(spark, sf):
    agg = tables.order_bars(spark, sf).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("number_of_bars"), F.min("ts").alias("first_day"), F.max("ts").alias("last_day")
    )
    path = new_path(spark, "report")
    sinks.write_report(agg, F.col("symbol"), {n: F.col(n) for n in ("number_of_bars", "first_day", "last_day")}, path)
    return spark.read.text(path)


@query(
    "snk_03_history",
    q.with_(q.ORDER_BARS) + f"SELECT symbol, ts, year(ts) AS year, {q.rnds(BAR_COLS)}, 'orders' AS source FROM bars".replace("year(ts) AS", "CAST(year(ts) AS INTEGER) AS"),
)
def snk_03(spark, sf):
    """Bars written twice (an older load with other prices first), read back from disk."""
    bars = tables.order_bars(spark, sf).withColumns({"source": F.lit("orders"), "loaded_at": F.lit(2)})
    older = bars.withColumns({"close": F.col("close") - 1, "loaded_at": F.lit(1)})
    path = new_path(spark, "history")
    sinks.write_history(bars.unionByName(older), path)
    schema = "symbol string, ts date, year int, open double, high double, low double, close double, volume double, source string"
    return spark.read.schema(schema).parquet(path).select("symbol", "ts", "year", *rounded_cols(BAR_COLS), "source")
