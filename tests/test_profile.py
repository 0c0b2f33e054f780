"""The full profile record beside the families it is made of."""

import json

from barloom.operators import profile as pf
from barloom.plans.profile_queries import agg_20
from barloom.operators import labels as lb
from barloom.session import stored
from barloom.sources import tables
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


def test_full_profile_holds_classes_and_column_types(spark):
    found = {r["symbol"]: r for r in agg_20(spark, SMALL).collect()}
    bars = lb.direction_labels(tables.order_bars(spark, SMALL), F.lit(0.012), F.lit(-0.012))
    bars = stored(bars.withColumn("target_return", F.floor(F.col("target_return") * 1000 + 0.5).cast("long")), "test-bars")
    assert set(found) == {r[0] for r in bars.select("symbol").distinct().collect()}
    counts = {(r["symbol"], r["column_name"], r["class_value"]): r["n"] for r in pf.class_distributions(bars).collect()}
    kinds = {r["column_name"]: r["n_distinct"] for r in pf.column_types(bars).collect()}
    seen = {}
    for symbol, r in found.items():
        assert {x["column_name"]: x["n_distinct"] for x in json.loads(r["column_types"])} == kinds
        seen |= {(symbol, x["column_name"], x["class_value"]): x["n"] for x in json.loads(r["class_balance"])}
    assert seen == counts and {c for _, c, _ in seen} == {"target_class", "target_return"}


def test_full_profile_without_class_columns(spark):
    rows = pf.full_profile(stored(tables.order_bars(spark, SMALL), "test-plain")).collect()
    assert rows and all(r["class_balance"] is None and len(r["column_types"]) == 7 for r in rows)
