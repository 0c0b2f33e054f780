"""The dashboard over rows of two regions."""

import datetime as dt

import duckdb
from check_queries import rows_of

from barloom.plans import load_all


def _tables(spark, folder):
    """Nations of regions 0, 1 and 3 with orders on two days, one of region 2 with orders on one day only."""
    nations = [(0, "ALGERIA", 0), (1, "ARGENTINA", 1), (2, "INDIA", 2), (3, "FRANCE", 3)]
    orders, key = [], 0
    for nation, _, region in nations:
        for day in range(1 if region == 2 else 2):
            key += 1
            orders.append((key, nation, 100.0 * (nation + 1) + day, dt.datetime(2000, 1, 3 + day), "1-URGENT"))
    made = {
        "nation": (nations, "n_nationkey int, n_name string, n_regionkey int"),
        "customer": ([(n, n, "BUILDING") for n, _, _ in nations], "c_custkey int, c_nationkey int, c_mktsegment string"),
        "orders": (orders, "o_orderkey int, o_custkey int, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"),
    }
    for name, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


def test_dashboard_quotes_every_nation(spark, tmp_path):
    _tables(spark, tmp_path)
    queries, sql = load_all()
    df = queries["dsh_01_dashboard"](spark, str(tmp_path))
    rows = [tuple(r) for r in df.collect()]
    quotes = {r[1]: r[3] for r in rows if r[0] == "quotes"}
    assert quotes == {"ALGERIA": 101.0, "ARGENTINA": 201.0, "FRANCE": 401.0}

    con = duckdb.connect()
    for name in ("nation", "customer", "orders"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    res = con.execute(sql["dsh_01_dashboard"])
    assert rows_of(df.columns, rows) == rows_of([d[0] for d in res.description], res.fetchall())
