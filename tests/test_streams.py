"""Streams over several batches and after a retry; history over several loads; plans."""

import datetime as dt
import random

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from barloom.operators.backtest import grid_backtest
from barloom.operators.indicators import add_rsi
from barloom.operators.series import by_symbol
from barloom.plans.stream_queries import event_rules
from barloom.sources import sinks
from barloom.sources.tables import order_bars
from barloom.streaming import rsi_state, snapshots, ticks

SMALL = "/root/testdata/sf0.001"


def test_retried_batch_writes_the_same_messages(spark, tmp_path):
    path = str(tmp_path / "alerts")
    rows = lambda ids: spark.createDataFrame([(i, "X", f"m{i}") for i in ids], "rule_id bigint, symbol string, message string")
    ticks.write_cycle(rows([0, 1]), path, 0)
    for _ in range(2):
        ticks.write_cycle(rows([0, 1, 2, 3]), path, 1)
    ticks.write_cycle(rows([3, 4]), path, 2)
    found = spark.read.parquet(path).select("batch", "message").collect()
    assert sorted((r["batch"], r["message"]) for r in found) == [(0, "m0"), (0, "m1"), (1, "m2"), (1, "m3"), (2, "m4")]


def test_rule_fires_once_over_four_batches(spark, tmp_path):
    (tmp_path / "in").mkdir()
    events = pq.read_table(f"{SMALL}/events.parquet").sort_by("ts")
    step = -(-events.num_rows // 4)
    for i in range(4):
        pq.write_table(events.slice(i * step, step), tmp_path / "in" / f"events{i}.parquet")
    bars = ticks.streaming_bars(ticks.event_stream(spark, str(tmp_path / "in"), 1))
    alerts = ticks.fire_once(ticks.price_alerts(bars, event_rules(spark, SMALL)))
    ticks.run_to_files(alerts.select("rule_id"), str(tmp_path / "out"), str(tmp_path / "state"))
    fired = [r["rule_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert fired and len(fired) == len(set(fired))


def test_second_load_of_a_day_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "history")
    bars = spark.createDataFrame([("X", dt.date(2024, 1, i), "a", float(i), i) for i in (1, 2)], "symbol string, ts date, source string, close double, loaded_at int")
    sinks.write_history(bars, path)
    sinks.write_history(bars.withColumn("close", F.col("close") + 1), path)
    sinks.write_history(bars.withColumn("ts", F.col("ts") + F.expr("interval 5 days")), path)
    assert sorted(r["close"] for r in spark.read.parquet(path).collect()) == [1.0, 1.0, 2.0, 2.0]


def test_grid_is_dealt_out_by_pair(spark):
    plan = grid_backtest(order_bars(spark, SMALL))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(symbol" in plan and "n1#" in plan.split("REPARTITION_BY_COL")[0].rsplit("hashpartitioning", 1)[1]
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def _ticks(spark, rows):
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, price double, qty double, seq bigint")


def test_alert_snapshot_equals_all_ticks_with_a_late_row_and_a_retry(spark, tmp_path):
    rng = random.Random(3)
    start = dt.datetime(2024, 1, 1)
    ticks_of = lambda symbol, first, n: [(symbol, start + dt.timedelta(hours=first + i, minutes=m), 100 + 10 * rng.random(), 1.0, (first + i) * 10 + m) for i in range(n) for m in (5, 3)]
    batches = [ticks_of("A", 0, 70) + ticks_of("B", 0, 20), ticks_of("A", 70, 10), ticks_of("B", 20, 60), ticks_of("A", 80, 5)]
    batches[2].append(("A", start + dt.timedelta(hours=75, minutes=50), 400.0, 1.0, 759))  # late by some hours
    rules = spark.createDataFrame(
        [(i, s, t, (ref, lim), True, None) for i, (s, t, ref, lim) in enumerate((s, t, r, x) for s in "AB" for t in ("price_above", "price_below", "rsi_overbought", "rsi_oversold") for r, x in ((103.0, 45.0), (107.0, 55.0)))],
        "rule_id bigint, symbol string, type string, condition struct<reference: double, rsi_limit: double>, active boolean, message string",
    )
    shots = snapshots.AlertSnapshots(str(tmp_path / "shots"), rules)
    known = []
    for n, rows in enumerate(batches):
        known += rows
        want = snapshots.newest_alerts(snapshots.bar_parts(_ticks(spark, known)), rules).filter(F.col("symbol").isin([r[0] for r in rows]))
        want = sorted(r["message"] for r in want.collect())
        for _ in range(2 if n in (1, 2) else 1):
            assert sorted(r["message"] for r in shots.cycle(_ticks(spark, rows), n).collect()) == want
        assert want or n == 0
    held = spark.read.parquet(str(tmp_path / "shots" / "bars-1"))
    assert held.filter("symbol = 'A' AND high = 400.0").count() == 1 and held.count() == 85 + 80


def test_streaming_rsi_puts_late_bars_in_place(spark, tmp_path):
    rng = random.Random(8)
    start, price, rows = dt.datetime(2024, 1, 1), 100.0, []
    for i in range(120):
        price += rng.uniform(-2, 2)
        rows += [(s, start + dt.timedelta(hours=i), price + j) for j, s in enumerate("XY")]
    # neighbours change places within and between the four files; one bar comes twice
    late = sorted(rows, key=lambda r: (r[1] - start).total_seconds() / 3600 + rng.uniform(0, 5))
    schema = "symbol string, ts timestamp_ntz, close double"
    for i in range(4):
        part = late[i * 60 : (i + 1) * 60] + (late[50:51] if i == 1 else [])
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ticks.run_to_files(rsi_state.streaming_rsi(stream, "6 hours"), str(tmp_path / "out"), str(tmp_path / "state"), **rsi_state.STORE)
    got = {(r["symbol"], r["ts"]): r["rsi_14"] for r in spark.read.schema(rsi_state.OUTPUT).parquet(str(tmp_path / "out")).collect()}
    flat = spark.createDataFrame(rows, schema).withColumns({"high": F.col("close"), "low": F.col("close")})
    want = {(r["symbol"], r["ts"]): r["rsi_14"] for r in add_rsi(by_symbol(flat)).df.filter(F.col("ts") <= F.lit(start + dt.timedelta(hours=119 - 6))).collect()}
    assert got.keys() == want.keys() and len(got) == 2 * 114
    for k, v in want.items():
        assert (got[k] is None) == (v is None) and (v is None or abs(got[k] - v) < 1e-9)


def test_rules_meet_only_blocks_that_fire(spark):
    rules = spark.createDataFrame(
        [(i, "Z", "price_above" if i % 2 else "price_below", (float(i), None), True) for i in range(1000)] + [(2000, "Z", "price_above", (None, None), True)],
        "rule_id bigint, symbol string, type string, condition struct<reference: double, rsi_limit: double>, active boolean",
    )
    price, edges = ticks.reference_blocks(rules, 16)
    bars = spark.createDataFrame([("Z", c) for c in (-1.0, 300.0, 300.5, 999.0, 5000.0)], "symbol string, close double")
    met = ticks.crossed_blocks(bars, edges).join(price, ["symbol", "type", "block"])
    fires = F.when(F.col("type") == "price_above", F.col("close") > F.col("reference")).otherwise(F.col("close") < F.col("reference"))
    every = bars.join(price, "symbol").filter(fires).count()
    assert met.filter(fires).count() == every
    assert met.count() - every <= 2 * 5 * (1000 // 2 // 16 + 2)
