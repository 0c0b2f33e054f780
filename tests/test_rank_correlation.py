"""Rank correlation of keys of any size beside pandas."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators.selection import rank_correlation, ties_ranked


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(2)
    data = []
    for i in range(1500):
        t = None if i % 97 == 0 else round(rng.gauss(0, 1), 2)
        # ties, a value in a third of all rows, a constant, nulls
        data.append(("a" if i % 3 else "b", t, float(rng.randrange(5)), 7.0 if i % 3 == 0 else round((t or 0.0) ** 3 + rng.random(), 1), 1.0, None if i % 50 == 0 else rng.random()))
    return spark.createDataFrame(data, "symbol string, t double, few double, hot double, same double, gaps double").repartition(4)


def test_rank_correlation_beside_pandas(rows):
    features = ["few", "hot", "same", "gaps"]
    found = {(r[0], r[1]): r[2] for r in rank_correlation(rows, features, "t").collect()}
    whole = rows.toPandas().dropna()
    assert len(found) == 8
    for symbol, part in whole.groupby("symbol"):
        for f in features:
            if part[f].nunique() < 2:
                assert found[symbol, f] is None
            else:
                assert found[symbol, f] == pytest.approx(part[f].rank().corr(part["t"].rank()), abs=1e-9)


@pytest.mark.parametrize("blocks", [2, 16, 256])
def test_ranks_do_not_depend_on_the_blocks(rows, blocks):
    long = rows.where("t IS NOT NULL").select("symbol", "t")
    found = {(r["symbol"], r["t"]): r["rank_t"] for r in ties_ranked(long, "t", ["symbol"], blocks).collect()}
    table = long.toPandas()
    table["r"] = table.groupby("symbol")["t"].rank()
    assert found == {(s, t): r for s, t, r in pd.DataFrame(table).itertuples(index=False)}


def test_rank_correlation_of_nothing(rows):
    assert rank_correlation(rows.where(F.lit(False)), ["few"], "t").count() == 0
