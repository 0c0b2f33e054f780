"""Canonical bars: building, normalising, source fallback, period ranges, routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRICES = ("open", "high", "low", "close")
OHLCV = PRICES + ("volume",)

BARS_SCHEMA = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("ts", T.DateType()),
        *[T.StructField(n, T.DoubleType()) for n in OHLCV],
        T.StructField("source", T.StringType()),
    ]
)


def bars_from_ticks(ticks: DataFrame, bar_start: Column) -> DataFrame:
    """OHLCV bars from ``(symbol, ts, price, qty, seq)``.

    Every aggregate merges map-side, so a symbol holding a third of all ticks still
    sends one partial row per bar and task into the shuffle.
    """
    return ticks.groupBy("symbol", bar_start.alias("ts")).agg(
        F.min_by("price", "seq").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "seq").alias("close"),
        F.sum("qty").alias("volume"),
    )


def interval_start(ts: Column, interval: str) -> Column:
    """Bar start for the intervals ``1d``, ``1wk`` (Monday) and ``1mo``."""
    day = ts.cast("date")
    if interval == "1d":
        return day
    return F.trunc(day, {"1wk": "week", "1mo": "month"}[interval])


def resample(bars: DataFrame, interval: str) -> DataFrame:
    """Coarser bars from finer ones."""
    return bars.groupBy("symbol", interval_start(F.col("ts"), interval).alias("ts")).agg(
        F.min_by("open", "ts").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "ts").alias("close"),
        F.sum("volume").alias("volume"),
    )


def normalise(df: DataFrame, symbol: str = "symbol", ts: str = "ts") -> DataFrame:
    """Any-case OHLCV columns to canonical bars: missing volume becomes 0, a missing
    price column null, text is coerced to numbers (null where it is not one), the five
    come first and other columns are kept."""
    known = {name.lower(): name for name in df.columns if name.lower() in OHLCV}

    def number(name: str) -> Column:
        if name not in known:
            return F.lit(None).cast("double")
        return F.col(f"`{known[name]}`").cast("string").try_cast("double")

    cols = [number(p).alias(p) for p in PRICES]
    cols.append(F.coalesce(number("volume"), F.lit(0.0)).alias("volume"))
    rest = [F.col(f"`{n}`") for n in df.columns if n.lower() not in OHLCV and n not in (symbol, ts)]
    return df.select(F.col(symbol).alias("symbol"), F.col(ts).alias("ts"), *cols, *rest)


def clean(bars: DataFrame) -> DataFrame:
    """Indicator input: rows with a null price go, a null volume counts as 0."""
    missing = [p for p in PRICES if p not in bars.columns]
    if missing:
        raise ValueError(f"bars lack the columns {', '.join(missing)}")
    volume = F.coalesce(F.col("volume"), F.lit(0.0)) if "volume" in bars.columns else F.lit(0.0)
    return bars.na.drop(subset=list(PRICES)).withColumn("volume", volume)


def first_source(bars: DataFrame, last_priority: int | None = None, start=None, end=None) -> DataFrame:
    """Whole-symbol fallback: the lowest ``priority`` that has any row of a symbol
    supplies all of its rows; the last source is first cut to [start, end]."""
    if last_priority is not None:
        bars = bars.filter((F.col("priority") != last_priority) | F.col("ts").between(F.lit(start), F.lit(end)))
    best = bars.groupBy("symbol").agg(F.min("priority").alias("priority"))
    return bars.join(best, ["symbol", "priority"], "left_semi")


def period_days(period: Column) -> Column:
    """Days covered by ``Ny``, ``Nmo`` or ``Nd``; anything else means 365."""
    n = F.regexp_extract(period, r"(\d+)", 1)
    num = F.when(n != "", n).otherwise("0").cast("int")
    return (
        F.when(period.rlike(r"^\d+y$"), num * 365)
        .when(period.rlike(r"^\d+mo$"), num * 30)
        .when(period.rlike(r"^\d+d$"), num)
        .otherwise(F.lit(365))
    )


def period_range(period: Column, as_of: Column, start: Column | None = None, end: Column | None = None):
    """(start, end) of a period seen from ``as_of``; an explicit pair takes its place."""
    lo, hi = F.date_sub(as_of, period_days(period)), as_of
    if start is not None and end is not None:
        given = start.isNotNull() & end.isNotNull()
        lo, hi = F.when(given, start).otherwise(lo), F.when(given, end).otherwise(hi)
    return lo, hi


def between_dates(bars: DataFrame, start, end) -> DataFrame:
    """Inclusive range filter; on a bars table it reaches the parquet scan."""
    return bars.filter(F.col("ts").between(start, end))


def route_symbol(symbol: Column) -> Column:
    """Country, clean symbol and asset type of a vendor symbol."""
    # fixed values: index symbols, the Brazilian suffix and the default country
    index = {
        "^BVSP": ("brazil", "Bovespa"),
        "^GSPC": ("united states", "S&P 500"),
        "^IXIC": ("united states", "Nasdaq Composite"),
    }
    country, name, kind = F.lit("united states"), symbol, F.lit("stock")
    sa = symbol.endswith(".SA")
    country = F.when(sa, F.lit("brazil")).otherwise(country)
    name = F.when(sa, F.regexp_replace(symbol, r"\.SA$", "")).otherwise(name)
    for sym, (where, label) in index.items():
        hit = symbol == sym
        country = F.when(hit, F.lit(where)).otherwise(country)
        name = F.when(hit, F.lit(label)).otherwise(name)
        kind = F.when(hit, F.lit("index")).otherwise(kind)
    return F.struct(country.alias("country"), name.alias("clean_symbol"), kind.alias("kind"))


def asset_class(symbol: Column) -> Column:
    return (
        F.when(symbol.startswith("^"), "index").when(symbol.contains(".SA"), "stock_br").otherwise("stock_us")
    )


def dedupe_bars(bars: DataFrame) -> DataFrame:
    """One row per (symbol, ts, source): the last written by ``loaded_at``."""
    w = Window.partitionBy("symbol", "ts", "source").orderBy(F.desc("loaded_at"))
    return bars.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
