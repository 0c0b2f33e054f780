"""Readers of the driver tables and the bar tables derived from them."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.sources.bars import bars_from_ticks


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hour_of(ts: Column) -> Column:
    """Start of the hour, without a time-zone round trip."""
    return F.make_timestamp_ntz(F.year(ts), F.month(ts), F.dayofmonth(ts), F.hour(ts), F.lit(0), F.lit(0))


def in_period(df: DataFrame, ts: str, start: date | None, end: date | None) -> DataFrame:
    """Inclusive date range on the raw time column, so that it reaches the parquet scan (a
    filter on the bar's date would not: the date is computed)."""
    midnight = lambda d: F.lit(d.isoformat()).cast("timestamp_ntz")
    if start is not None:
        df = df.filter(F.col(ts) >= midnight(start))
    if end is not None:
        df = df.filter(F.col(ts) < midnight(end + timedelta(days=1)))
    return df


def order_ticks(spark: SparkSession, sf_dir: str, start: date | None = None, end: date | None = None) -> DataFrame:
    """One tick per order; the symbol is the customer's market segment."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    orders = in_period(orders, "o_orderdate", start, end)
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        F.col("c_mktsegment").alias("symbol"),
        F.col("o_orderdate").alias("ts"),
        F.col("o_totalprice").alias("price"),
        F.lit(1.0).alias("qty"),
        F.col("o_orderkey").alias("seq"),
    )


def nation_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tick per order; the symbol is the customer's nation."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .join(nation, customer.c_nationkey == nation.n_nationkey)
        .select(
            F.col("n_name").alias("symbol"),
            F.col("o_orderdate").alias("ts"),
            F.col("o_totalprice").alias("price"),
            F.lit(1.0).alias("qty"),
            F.col("o_orderkey").alias("seq"),
        )
    )


def event_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tick per event; the symbol is the event type."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"),
        "ts",
        F.col("value").alias("price"),
        F.lit(1.0).alias("qty"),
        F.col("event_id").alias("seq"),
    )


def order_bars(spark: SparkSession, sf_dir: str, start: date | None = None, end: date | None = None) -> DataFrame:
    """Daily bars per market segment."""
    return bars_from_ticks(order_ticks(spark, sf_dir, start, end), F.col("ts").cast("date"))


def nation_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars per nation."""
    return bars_from_ticks(nation_ticks(spark, sf_dir), F.col("ts").cast("date"))


def event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars per event type."""
    return bars_from_ticks(event_ticks(spark, sf_dir), hour_of(F.col("ts")))


def index_bars(spark: SparkSession, sf_dir: str, start: date | None = None, end: date | None = None) -> DataFrame:
    """Daily bars per market segment on a damped scale (price to the power 0.01, base
    100 at 250,000, six decimals): the raw closes jump tenfold from day to day, the
    damped ones move by a percent or two, as label thresholds and backtests expect."""
    bars = order_bars(spark, sf_dir, start, end)
    damp = {p: F.round(100.0 * F.pow(F.col(p) / 250000.0, F.lit(0.01)), 6) for p in ("open", "high", "low", "close")}
    return bars.withColumns(damp)
