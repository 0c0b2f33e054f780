import datetime as dt
import hashlib
import json

from pyspark.sql import functions as F

from barloom.functions import text as tx
from barloom.operators import lookups as lk
from barloom.sources import bars as br
from barloom.sources import payloads as pl
from barloom.sources import store


def test_payload_key_is_md5_of_sorted_params(spark):
    df = spark.createDataFrame([("AAPL", 7)], "s string, n int")
    key = df.select(store.payload_key(F.lit("quote"), F.col("s"), {"b": F.col("s"), "a": F.col("n")}).alias("k")).first().k
    params = json.dumps({"b": "AAPL", "a": 7}, sort_keys=True)
    assert key == hashlib.md5(f"quote:AAPL:{params}".encode()).hexdigest()
    bare = df.select(store.payload_key(F.lit("quote"), F.col("s")).alias("k")).first().k
    assert bare == hashlib.md5(b"quote:AAPL:").hexdigest()


def test_latest_payload_states(spark):
    rows = [("hit", '{"a": 1}', 100.0, 60), ("old", '{"a": 1}', 10.0, 60), ("bad", '{"a"', 100.0, 60), ("edge", "{}", 40.0, 60), ("hit", "{}", 1.0, 60)]
    raw = spark.createDataFrame(rows, "key string, value string, ts double, ttl int")
    got = {r.key: (r.state, r.value) for r in store.latest_payload(raw, 100.0).collect()}
    assert got["hit"] == ("live", '{"a": 1}')
    assert got["old"][0] == "expired" and got["bad"][0] == "bad_json"
    assert got["edge"][0] == "expired"  # now - ts equals the ttl


def test_keyed_tables(spark):
    base = spark.createDataFrame([(1, "a", True), (2, "b", True)], "id int, message string, active boolean")
    changes = spark.createDataFrame(
        [(1, "x", False, False, 1), (2, "b", True, True, 2), (3, "c", True, False, 1), (3, "d", True, False, 5)],
        "id int, message string, active boolean, deleted boolean, seq int",
    )
    got = {r.id: (r.message, r.active) for r in store.upsert(base, changes, ["id"]).collect()}
    assert got == {1: ("x", False), 3: ("d", True)}
    again = spark.createDataFrame([(2, "z", True), (4, "e", True)], base.schema)
    assert sorted(r.message for r in store.insert_new(base, again, ["id"]).collect()) == ["a", "b", "e"]
    patch = spark.createDataFrame([(1, None, False)], base.schema)
    got = {r.id: (r.message, r.active) for r in store.update_fields(base, patch, ["id"], ["message", "active"]).collect()}
    assert got == {1: ("a", False), 2: ("b", True)}
    assert [r.id for r in store.delete_keys(base, patch, ["id"]).collect()] == [2]


def test_fallback_takes_whole_symbols(spark):
    rows = [("A", 1, 1), ("A", 2, 2), ("B", 1, 2), ("B", 2, 3), ("C", 1, 3), ("C", 9, 3)]
    df = spark.createDataFrame(rows, "symbol string, ts int, priority int")
    got = sorted((r.symbol, r.ts) for r in br.first_source(df, 3, 0, 5).collect())
    assert got == [("A", 1), ("B", 1), ("C", 1)]


def test_payload_shapes(spark):
    raw = spark.createDataFrame([("S", '{"Date":[1672531200000],"Open":[1.0],"High":[2.0],"Low":[0.5],"Close":[1.5],"Volume":[null]}'), ("T", "oops")], "symbol string, payload string")
    rows = pl.columnar_bars(raw).collect()
    assert [(r.symbol, r.ts, r.close, r.volume) for r in rows] == [("S", dt.datetime(2023, 1, 1), 1.5, 0.0)]
    raw = spark.createDataFrame([("S", '{"2024-01-02":{"1. open":"1","2. high":"2","3. low":"0.5","4. close":"1.5","5. adjusted close":"1.4","6. volume":"10"}}')], "symbol string, payload string")
    r = pl.dated_bars(raw).first()
    assert (r.ts, r.open, r.adj_close, r.volume) == (dt.date(2024, 1, 2), 1.0, 1.4, 10.0)
    raw = spark.createDataFrame([("Q", '{"c":150.0,"d":1.5,"dp":1.0,"o":149.0,"h":151.0,"l":148.0,"pc":148.5,"t":1678886400}'), ("Z", '{"c":0}')], "symbol string, payload string")
    assert [(r.symbol, r.price, r.quoted_at) for r in pl.quotes(raw).collect()] == [("Q", 150.0, 1678886400)]


def test_statement_pivot_takes_first_value_of_three_periods(spark):
    data = [
        {"endDate": "2023-12-31", "report": [{"concept": "Rev", "value": "1,234"}, {"concept": "Rev", "value": "9"}, {"concept": "Tax", "value": "None"}]},
        {"report": [{"concept": "Rev", "value": "7"}]},
        {"endDate": "2021-12-31", "report": [{"concept": "Rev", "value": None}, {"concept": "Rev", "value": "5"}]},
        {"endDate": "2020-12-31", "report": [{"concept": "Rev", "value": "4"}]},
    ]
    raw = spark.createDataFrame([("S", json.dumps({"data": data}))], "symbol string, payload string")
    got = {r.concept: (r.period_1, r.period_2, r.period_3) for r in pl.statement_pivot(pl.statement_items(raw)).collect()}
    assert got == {"Rev": (1234.0, None, None), "Tax": (None, None, None)}


def test_quote_from_two_bars(spark):
    rows = [("G", dt.date(2023, 3, 14), 140.5), ("G", dt.date(2023, 3, 15), 142.5), ("H", dt.date(2023, 3, 15), 1.0)]
    df = spark.createDataFrame(rows, "symbol string, ts date, close double").withColumns({c: F.col("close") for c in ("open", "high", "low")}).withColumn("volume", F.lit(5.0))
    got = lk.quote_from_history(df).collect()
    assert [(r.symbol, r.price, r.prev_close, r.change) for r in got] == [("G", 142.5, 140.5, 2.0)]


def test_period_days(spark):
    df = spark.createDataFrame([("2y",), ("3mo",), ("260d",), ("max",)], "p string")
    assert [r.d for r in df.select(br.period_days(F.col("p")).alias("d")).collect()] == [730, 90, 260, 365]


def test_text_formats(spark):
    df = spark.createDataFrame([(1234.5, "2024-01-31 10:00")], "v double, d string")
    r = df.select(tx.money(F.col("v")).alias("m"), tx.date_br(F.col("d")).alias("d"), tx.change_percent(F.col("v"), F.lit(1000.0)).alias("c"), tx.change_percent(F.col("v"), F.lit(0.0)).alias("z")).first()
    assert (r.m, r.d, r.c, r.z) == ("R$ 1.234,50", "31/01/2024", "+23.45%", "N/A")
