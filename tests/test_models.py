import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import alerts as al
from barloom.operators import augment as au
from barloom.operators import backtest as bk
from barloom.operators import evaluate as ev
from barloom.operators import features as ft
from barloom.operators import forecast as fc
from barloom.operators import profile as pf
from barloom.operators import scenario as sc
from barloom.operators import selection as sl
from barloom.sources.tables import index_bars

SMALL = "/root/testdata/sf0.001"


def test_exact_quantiles_with_one_hot_key_and_ties(spark):
    df = spark.range(30_000).select(
        F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 7).cast("string"))).alias("symbol"),
        (F.when(F.col("id") % 5 == 0, 42.0).otherwise(F.hash("id") % 10_000) / 7.0).alias("v"),
    )
    probs = [0.0, 0.05, 0.5, 0.951, 1.0]
    got = {(r.symbol, r.p): r.value for r in pf.exact_quantiles(df, "v", probs, ["symbol"], coarse=8).collect()}
    pdf = df.toPandas()
    for symbol, part in pdf.groupby("symbol"):
        for p in probs:
            assert got[(symbol, p)] == pytest.approx(np.quantile(part["v"], p))


def test_student_p_values(spark):
    # two-sided 5% points of the t table
    df = spark.createDataFrame([(12.706, 1), (2.571, 5), (2.228, 10), (1.984, 100), (0.0, 7)], "t double, dof bigint")
    got = [r.p for r in df.select(pf.student_p(F.col("t"), F.col("dof")).alias("p")).collect()]
    assert got[:4] == pytest.approx([0.05] * 4, abs=2e-4) and got[4] == pytest.approx(1.0)


def test_fine_threshold_search_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    p = rng.dirichlet([0.05, 1.0, 0.05], size=300)
    real = rng.integers(0, 3, 300)
    df = spark.createDataFrame([(int(r), *map(float, x)) for r, x in zip(real, p)], "real int, p0 double, p1 double, p2 double")
    got = ev.search_thresholds_fine(df).first()
    best, args = 0.0, None
    width = (0.05 - 0.001) / 999
    for i in range(1000):
        t1 = 0.001 + i * width
        start = t1 + 0.001
        step = (0.05 - start) / 99
        low = p[:, 0] > t1
        for k in range(100):
            pred = np.where(p[:, 2] > start + k * step, 2, np.where(low, 0, 1))
            cm = np.bincount(real * 3 + pred, minlength=9).reshape(3, 3)
            den = cm.sum(0) + cm.sum(1)
            f1 = round(float((np.where(den > 0, 2 * np.diag(cm) / np.maximum(den, 1), 0) * cm.sum(1)).sum() / 300), 12)
            if f1 > best:
                best, args = f1, (t1, start + k * step)
    assert got.f1 == pytest.approx(best)
    assert (got.t_low, got.t_high) == pytest.approx(args)


def test_regression_metrics(spark):
    rows = [("a", i, *x) for i, x in enumerate(zip((10.0, 11.0, 12.0, 11.0, 10.0), (10.5, 10.5, 11.5, 11.5, 9.5)))]
    rows += [("b", i, *x) for i, x in enumerate(zip((10.0, 11.0, 10.0, 12.0, 11.0), (10.0, 12.0, 9.0, 13.0, 10.0)))]
    df = spark.createDataFrame(rows, "symbol string, ts int, actual double, predicted double")
    got = {r.symbol: r for r in ev.regression_metrics(df).collect()}
    assert got["a"].mae == pytest.approx(0.5)
    assert (got["b"].hits, got["b"].comparisons, got["b"].hit_rate) == (4, 4, 1.0)
    assert ev.regression_metrics(df.filter("symbol = 'c'")).count() == 0


def test_backtest_of_two_hand_made_trades(spark):
    opens = [100.0, 100.0, 110.0, 120.0, 115.0, 100.0, 90.0]
    closes = [100.0, 105.0, 115.0, 118.0, 110.0, 95.0, 92.0]
    signal = [0, 1, 0, -1, 0, 0, 0]
    rows = [("Z", i, o, c, s) for i, (o, c, s) in enumerate(zip(opens, closes, signal))]
    df = spark.createDataFrame(rows, "symbol string, rn int, open double, close double, signal int")
    curve = bk.equity_curve(df)
    pos = [r.position for r in curve.orderBy("rn").collect()]
    assert pos == [0, 0, 1, 1, -1, -1, -1]
    r = bk.backtest_stats(curve).first()
    # long from open 110 to open 115; then short, rebalanced at each open and close
    long_trade = (1 - 0.002) * 115 / 110
    short = (1 - 0.004) * (1 + 5 / 115) * (1 + 10 / 110) * (1 + 5 / 100) * (1 + 5 / 95) * (1 - 2 / 90)
    assert r.n_trades == 2
    assert r.final_equity == pytest.approx(100_000 * long_trade * short)
    assert r.avg_trade_pct == pytest.approx(50 * (long_trade - 1 + short - 1))
    assert r.buy_hold_pct == pytest.approx(-8.0)


def test_ruined_account_stays_at_zero(spark):
    rows = [("Z", 0, 10.0, 10.0, -1), ("Z", 1, 10.0, 25.0, 0), ("Z", 2, 25.0, 5.0, 0)]
    df = spark.createDataFrame(rows, "symbol string, rn int, open double, close double, signal int")
    assert [r.equity for r in bk.equity_curve(df).orderBy("rn").collect()] == [100_000.0, 0.0, 0.0]


def test_scenarios_are_stretches_of_history(spark):
    bars = index_bars(spark, SMALL)
    params = sc.parameters(bars)
    a = sc.paths(bars, 5)
    closes = {}
    for r in bars.orderBy("ts").collect():
        closes.setdefault(r.symbol, []).append(r.close)
    want = {(k, i, d): x[-1] * x[i + d] / x[i] for k, x in closes.items() for i in range(len(x) - 5) for d in range(6)}
    got = {(r.symbol, r.sim, r.day): r.price for r in a.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - v) <= 1e-9 * abs(v) for k, v in want.items())
    first = a.filter("day = 0").select("symbol", "price").distinct()
    assert first.join(params, "symbol").filter("abs(price - s0) > 1e-9").count() == 0
    again = sc.paths(bars.repartition(7), 5)
    assert a.exceptAll(again).count() == 0
    ends = sc.final_prices(bars, 5)
    assert {(r.symbol, r.sim): r.final for r in ends.collect()} == {k[:2]: v for k, v in got.items() if k[2] == 5}
    assert sc.paths(bars, 1000).count() == 0 and sc.final_prices(bars, 1000).count() == 0
    with pytest.raises(ValueError):
        sc.paths(bars, 1001)


def test_sequences_and_split(spark):
    rows = [("A", i, float(i), i % 3) for i in range(200)]
    df = spark.createDataFrame(rows, "symbol string, ts int, f double, y int")
    seq = ft.sequences(df, ["f"], "y").orderBy("ts").collect()
    assert len(seq) == 185
    assert [v[0] for v in seq[0].x] == [float(i) for i in range(15)]
    assert ft.ordered_split(df).filter("is_train").count() == 140


def test_jitter_is_repeatable_and_labels_stay(spark):
    df = ft.feature_suite(index_bars(spark, SMALL)).select("symbol", "ts", "close", "volume").withColumn("target_class", F.dayofmonth("ts") % 3)
    one = au.augment(df, ["close", "volume"])
    assert one.filter("replica > 0").count() > 0
    labels = one.groupBy("symbol", "ts").agg(F.countDistinct("target_class").alias("n")).filter("n > 1")
    assert labels.count() == 0
    assert au.replica_checks(one, ["close", "volume"]).filter("NOT valid").count() == 0


def test_greedy_choices():
    corr = {("a", "b"): 0.9, ("a", "c"): 0.1, ("b", "c"): -0.95}
    assert sl.redundancy_groups(["a", "b", "c"], corr) == [["a", "b"]]
    assert sl.correlation_filter(["a", "b", "c"], corr, {"a": 0.1, "b": 0.2, "c": 0.2}) == ["b"]
    assert sl.correlation_filter(["a", "b"], corr, {"a": 0.3, "b": 0.2}) == ["a"]


def test_forecast_follows_trend_and_week(spark):
    day = dt.date(2020, 1, 1)
    rows = [("T", day + dt.timedelta(days=i), 100 + 0.1 * i + 3 * math.sin(2 * math.pi * i / 7)) for i in range(800)]
    df = spark.createDataFrame(rows, "symbol string, ts date, close double")
    out = fc.forecast(df, []).collect()
    assert len(out) == 30
    assert max(abs(r.yhat - r.actual) for r in out) < 1.0
    short = fc.forecast(df.limit(20), []).collect()
    assert len(short) == 30 and all(r.actual is None and r.ds.weekday() < 5 for r in short)


def _rules(spark):
    rows = [
        (1, "X", "price_above", '{"reference": 90.0}', True, "Check"),
        (2, "X", "rsi_overbought", '{"rsi_limit": 70}', True, None),
        (3, "X", "price_above", '{"reference": 90.0}', False, None),
        (4, "Y", "price_above", '{"reference": 90.0}', True, None),
        (5, "X", "preco_abaixo", '{"valor_referencia": 50.0}', True, None),
    ]
    return al.parse_rules(spark.createDataFrame(rows, "rule_id int, symbol string, type string, condition string, active boolean, message string"))


def test_alert_rules(spark):
    fire = lambda close, rsi: {r.rule_id: r.message for r in al.evaluate_rules(spark.createDataFrame([("X", close, rsi)], "symbol string, close double, rsi_14 double"), _rules(spark)).collect()}
    got = fire(100.0, 75.0)
    assert set(got) == {1, 2}
    assert got[1] == "ALERT: ID:1 - X - Check - Price (100.00) ABOVE 90.00!"
    assert got[2] == "ALERT: ID:2 - X - RSI (75.00) OVERBOUGHT (> 70)!"
    assert fire(50.0, 50.0) == {}
    assert set(fire(49.0, None)) == {5}


def test_history_diagnostics(spark):
    over = [("over", e, 1.0 / e, 0.5 + 0.05 * e, 0.9, 0.6) for e in range(1, 13)]
    done = [("done", e, 0.5, 0.5, 0.8, 0.79) for e in range(1, 13)]
    df = spark.createDataFrame(over + done, "run string, epoch int, loss double, val_loss double, acc double, val_acc double")
    got = {r.run: r for r in ev.history_diagnostics(df).collect()}
    assert got["over"].overfitting and got["over"].overfitting_trend and not got["over"].converged
    assert got["over"].indicators == "high_loss_ratio,high_accuracy_gap"
    assert got["done"].converged and not got["done"].overfitting


def test_replicas_join_the_training_rows_only(spark):
    from barloom.operators import classifier as cl
    from barloom.session import stored

    labelled = stored(cl.labelled_features(index_bars(spark, SMALL)), "labelled")
    names = ["rsi", "macd", "roc"]
    rows = stored(cl.training_rows(labelled, names), "windows")
    train = rows.filter("is_train")
    grown = cl.with_replicas(train, labelled, names)
    assert grown.filter("NOT symbol LIKE '%#%'").count() == train.count()
    late = rows.filter("NOT is_train").groupBy("symbol").agg(F.min("ts").alias("first_test"))
    made = grown.filter("symbol LIKE '%#%'").withColumn("symbol", F.substring_index("symbol", "#", 1))
    assert made.count() > 0
    assert made.join(late, "symbol").filter("ts >= first_test").count() == 0
    model = cl.fit(train)
    p = cl.score(model, rows.filter("NOT is_train")).withColumn("total", F.col("p0") + F.col("p1") + F.col("p2"))
    assert p.filter("abs(total - 1) > 1e-9").count() == 0


def test_gram_sums_of_a_hot_symbol_over_many_tasks(spark):
    rng = np.random.default_rng(6)
    rows = [("hot" if i % 3 else f"s{i % 50}", *map(float, rng.normal(size=3))) for i in range(3000)] + [(None, 1.0, 2.0, 3.0), ("s1", None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "symbol string, a double, b double, y double").repartition(90)
    got = {r["symbol"]: r for r in fc.least_squares(df, "y", ["a", "b"]).collect()}
    for symbol in ("hot", "s0", "s6"):
        own = np.array([r[1:] for r in rows if r[0] == symbol and r[1] is not None])
        x = np.column_stack([np.ones(len(own)), own[:, :2]])
        beta, *_ = np.linalg.lstsq(x, own[:, 2], rcond=None)
        assert got[symbol].beta == pytest.approx(beta.tolist(), abs=1e-9)
        assert got[symbol].sigma == pytest.approx(float(np.sqrt(np.mean((own[:, 2] - x @ beta) ** 2))), abs=1e-9)
    sent = fc.gram_sums(df.na.drop().selectExpr("symbol", "array(1D, a, b) AS x")).collect()
    assert all(len(r["g"]) == 6 for r in sent) and None not in {r["symbol"] for r in sent if r["symbol"] == "hot"}


def test_long_symbols_have_replicas(spark):
    df = spark.range(6000).selectExpr("'long' AS symbol", "timestamp_ntz'2020-01-01' + make_interval(0, 0, 0, 0, cast(id AS int)) AS ts", "100D + id % 7 AS close", "1D AS volume", "cast(id % 3 AS int) AS target_class")
    assert au.policy(df).first()["replicas"] == 1 and au.policy(df, 0).first()["replicas"] == 0
    made = au.augment(df, ["close", "volume"])
    assert made.count() == 12_000 and made.filter("replica = 1").select("technique").distinct().count() == 1


def test_class_profile_of_all_class_columns(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("a", 2, None), ("b", None, "y")], "symbol string, my_class int, target string")
    got = {(r["symbol"], r["column_name"], r["class_value"]): (r["n"], r["n_classes"]) for r in pf.class_distributions(df).collect()}
    assert got == {("a", "my_class", "1"): (1, 2), ("a", "my_class", "2"): (2, 2), ("a", "target", "x"): (2, 1), ("b", "target", "y"): (1, 1)}
