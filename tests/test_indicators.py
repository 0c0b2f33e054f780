import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from barloom.operators import indicators as ind
from barloom.operators import series as se
from barloom.sources.bars import clean
from barloom.sources.tables import event_bars, index_bars

SMALL = "/root/testdata/sf0.001"


def column(df, name):
    return [r[name] for r in df.orderBy("ts").collect()]


def naive_smooth(x, alpha, start=0, seed=None):
    out, y = [], None
    for i, v in enumerate(x):
        if i == start:
            y = v if seed is None else seed
        elif i > start:
            y = alpha * v + (1 - alpha) * y
        out.append(None if i < start else y)
    return out


def test_sma_value_and_warm_up(bars31):
    got = column(ind.add_sma(se.by_symbol(bars31), (5,)).df, "sma_5")
    assert got[:4] == [None] * 4
    assert got[4] == pytest.approx(11.8)


def test_ema_warm_up_and_values(bars31):
    got = column(ind.add_ema(se.by_symbol(bars31), (5,)).df, "ema_5")
    assert got[3] is None and got[4] is not None
    want = naive_smooth(column(bars31, "close"), 2 / 6)
    assert got[4:] == pytest.approx(want[4:])


def test_rsi_and_adx_first_rows(bars31):
    suite = ind.indicator_suite(bars31)
    rsi, adx = column(suite, "rsi_14"), column(suite, "adx_14")
    assert rsi[13] is None and rsi[14] is not None
    assert adx[26] is None and adx[27] is not None
    assert suite.count() == 31
    assert set(ind.SUITE) <= set(suite.columns)


def test_short_history_is_all_null(bars31):
    short = bars31.filter(F.col("ts") < dt.date(2023, 1, 5))
    suite = ind.indicator_suite(short)
    for name in ("sma_9", "ema_9", "macd", "rsi_14", "adx_14", "atr_14", "stoch_k", "ret_std_20"):
        assert column(suite, name) == [None] * 4


def test_null_prices_are_dropped(bars31):
    holes = bars31.withColumn("close", F.when(F.col("ts") != dt.date(2023, 1, 3), F.col("close"))).withColumn(
        "open", F.when(F.col("ts") != dt.date(2023, 1, 2), F.col("open"))
    )
    assert clean(holes).count() == 29


def test_missing_price_columns_are_refused(bars31):
    with pytest.raises(ValueError):
        clean(bars31.select("symbol", "ts", "open", "high"))


def test_obv_is_null_without_volume(bars31):
    none = ind.add_obv(se.by_symbol(bars31.withColumn("volume", F.lit(0.0)))).df
    assert column(none, "obv") == [None] * 31


@pytest.mark.parametrize("alpha", [2 / 4, 2 / 10, 1 / 14, 2 / 201])
def test_smoothing_equals_the_plain_recursion_over_many_segments(spark, alpha):
    n = 5000
    df = spark.range(n).select(
        F.lit("A").alias("symbol"), F.col("id").alias("ts"), (100 + 10 * F.sin(F.col("id") / 7.0) + F.col("id") % 13).alias("x")
    )
    x = column(df, "x")
    got = column(se.smooth(se.by_symbol(df), [se.Smooth("y", "x", alpha)]).df, "y")
    assert got == pytest.approx(naive_smooth(x, alpha), rel=1e-12)


def test_block_layout_equals_symbol_layout(spark):
    bars = event_bars(spark, SMALL)
    names = ["symbol", "ts", *ind.SUITE]
    one = {(r.symbol, r.ts): r for r in ind.indicator_suite(bars).select(*names).collect()}
    two = ind.indicator_suite_blocked(bars, block_rows=100).select(*names).collect()
    assert len(one) == len(two)
    for r in two:
        for name in ind.SUITE:
            a, b = one[(r.symbol, r.ts)][name], r[name]
            assert (a is None) == (b is None), name
            if a is not None:
                assert math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9), name


def test_bucket_numbering_equals_row_number(spark):
    bars = index_bars(spark, SMALL)
    plain = {(r.symbol, r.ts): r.rn for r in se.by_symbol(bars).df.collect()}
    got = se.numbered_by_bucket(bars, F.year("ts")).collect()
    assert all(plain[(r.symbol, r.ts)] == r.rn for r in got) and len(got) == len(plain)


def test_fill_gaps(spark):
    rows = [("A", 0, None), ("A", 1, 2.0), ("A", 2, None), ("B", 0, None)]
    df = spark.createDataFrame(rows, "symbol string, ts int, v double")
    got = {(r.symbol, r.ts): r.v for r in se.fill_gaps(se.by_symbol(df), ["v"]).df.collect()}
    assert got == {("A", 0): 2.0, ("A", 1): 2.0, ("A", 2): 2.0, ("B", 0): None}
