"""Vendor payloads (JSON text) to rows.

A payload is one vendor answer - a symbol's history for the asked period - so the
arrays inside one are bounded by that period.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: field names of the vendor payloads
COLUMNAR_SCHEMA = (
    "Date array<bigint>, Open array<double>, High array<double>, Low array<double>, Close array<double>, Volume array<double>"
)
DATED_FIELDS = {
    "1. open": "open",
    "2. high": "high",
    "3. low": "low",
    "4. close": "close",
    "5. adjusted close": "adj_close",
    "6. volume": "volume",
}
FX_SCHEMA = "dataHoraCotacao array<string>, cotacaoVenda array<double>"
EXPECTATION_SCHEMA = "Indicador array<string>, DataReferencia array<string>, Media array<double>, Mediana array<double>"
QUOTE_SCHEMA = "c double, dp double, d double, o double, h double, l double, pc double, t bigint"
STATEMENT_SCHEMA = "data array<struct<endDate: string, report: array<struct<concept: string, value: string>>>>"


def millis_to_utc(ms: Column) -> Column:
    """Epoch milliseconds as a zone-free UTC timestamp."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return epoch + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (ms / 1000).cast("decimal(18,6)"))


def columnar_bars(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """``{"Date":[ms],"Open":[..],..}`` to bars; text that is not such JSON yields no rows."""
    p = raw.select("symbol", F.from_json(payload, COLUMNAR_SCHEMA).alias("p"))
    rows = p.select("symbol", F.explode(F.arrays_zip(*[F.col(f"p.{n}") for n in ("Date", "Open", "High", "Low", "Close", "Volume")])).alias("r"))
    return rows.select(
        "symbol",
        millis_to_utc(F.col("r.Date")).alias("ts"),
        F.col("r.Open").alias("open"),
        F.col("r.High").alias("high"),
        F.col("r.Low").alias("low"),
        F.col("r.Close").alias("close"),
        F.coalesce(F.col("r.Volume"), F.lit(0.0)).alias("volume"),
    )


def dated_bars(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """``{"2024-01-02":{"1. open":".."}}`` to bars with the adjusted close."""
    schema = T.MapType(T.StringType(), T.MapType(T.StringType(), T.StringType()))
    rows = raw.select("symbol", F.explode(F.from_json(payload, schema)).alias("day", "f"))
    return rows.select(
        "symbol",
        F.col("day").cast("date").alias("ts"),
        *[F.col("f").getItem(k).try_cast("double").alias(v) for k, v in DATED_FIELDS.items()],
    )


def series_points(
    raw: DataFrame, date_field: str, value_field: str, payload: str = "payload", keep_null: bool = True
) -> DataFrame:
    """``{"date":[iso],"value":[..]}`` to (series_id, date, value)."""
    schema = T.StructType(
        [T.StructField(date_field, T.ArrayType(T.StringType())), T.StructField(value_field, T.ArrayType(T.DoubleType()))]
    )
    p = raw.select("series_id", F.from_json(payload, schema).alias("p"))
    rows = p.select("series_id", F.explode(F.arrays_zip(F.col(f"p.{date_field}"), F.col(f"p.{value_field}"))).alias("r"))
    out = rows.select(
        "series_id", F.col("r")[date_field].try_cast("date").alias("date"), F.col("r")[value_field].alias("value")
    )
    return out if keep_null else out.na.drop(subset=["value"])


def fx_rates(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """Selling rates; a time that does not parse becomes null and the row stays."""
    p = raw.select(F.from_json(payload, FX_SCHEMA).alias("p"))
    rows = p.select(F.explode(F.arrays_zip("p.dataHoraCotacao", "p.cotacaoVenda")).alias("r"))
    return rows.select(
        F.col("r.dataHoraCotacao").try_cast("timestamp_ntz").alias("ts"), F.col("r.cotacaoVenda").alias("rate")
    )


def expectations(raw: DataFrame, indicator: str, first_year: int, n_years: int, payload: str = "payload") -> DataFrame:
    """Expectations of one indicator for the reference years first..first+n-1."""
    p = raw.select(F.from_json(payload, EXPECTATION_SCHEMA).alias("p"))
    zipped = F.arrays_zip("p.Indicador", "p.DataReferencia", "p.Media", "p.Mediana")
    rows = p.select(F.explode(zipped).alias("r")).select(
        F.col("r.Indicador").alias("indicator"),
        F.col("r.DataReferencia").try_cast("int").alias("year"),
        F.col("r.Media").alias("mean"),
        F.col("r.Mediana").alias("median"),
    )
    years = list(range(first_year, first_year + n_years))
    return rows.filter((F.col("indicator") == indicator) & F.col("year").isin(years))


def quotes(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """Quote columns of usable answers: a missing or zero current price is none."""
    p = raw.select("symbol", F.from_json(payload, QUOTE_SCHEMA).alias("q")).filter("q.c IS NOT NULL AND q.c != 0")
    return p.select(
        "symbol",
        F.col("q.c").alias("price"),
        F.col("q.d").alias("change"),
        F.col("q.dp").alias("change_pct"),
        F.col("q.o").alias("open"),
        F.col("q.h").alias("high"),
        F.col("q.l").alias("low"),
        F.col("q.pc").alias("prev_close"),
        F.col("q.t").alias("quoted_at"),
    )


def statement_items(raw: DataFrame, periods: int = 3, payload: str = "payload") -> DataFrame:
    """Nested statement to (symbol, period, end_date, pos, concept, value), newest periods first."""
    p = raw.select("symbol", F.from_json(payload, STATEMENT_SCHEMA).alias("p"))
    first = F.filter(F.slice("p.data", 1, periods), lambda x: x.endDate.isNotNull())
    per = p.select("symbol", F.posexplode(first).alias("period", "d"))
    items = per.select(
        "symbol", (F.col("period") + 1).alias("period"), F.col("d.endDate").try_cast("date").alias("end_date"), F.posexplode("d.report").alias("pos", "i")
    )
    return items.select("symbol", "period", "end_date", "pos", F.col("i.concept").alias("concept"), F.col("i.value").alias("value"))


def statement_number(text: Column) -> Column:
    """Number of a statement value: thousands commas go, null and 'None' are null."""
    return F.when(text != "None", F.replace(text, F.lit(","), F.lit("")).try_cast("double"))


def statement_pivot(items: DataFrame, periods: int = 3) -> DataFrame:
    """Concept by period; the first value of a repeated concept counts."""
    def first_value(k: int) -> Column:
        here = F.col("period") == k
        item = F.when(here, F.struct(F.col("value").alias("value")))
        return statement_number(F.min_by(item, F.when(here, F.col("pos"))).getField("value")).alias(f"period_{k}")

    return items.groupBy("symbol", "concept").agg(*[first_value(k) for k in range(1, periods + 1)])


# -- the way back: payload text from rows ------------------------------------------------


def to_columnar_payload(bars: DataFrame) -> DataFrame:
    """One payload per symbol and year, in time order."""
    row = F.struct("ts", "open", "high", "low", "close", "volume")
    packed = bars.groupBy("symbol", F.year("ts").alias("year")).agg(F.sort_array(F.collect_list(row)).alias("r"))
    day_ms = F.transform(
        "r", lambda x: F.datediff(x.ts, F.lit("1970-01-01").cast("date")).cast("bigint") * 86_400_000
    )
    fields = [day_ms.alias("Date")]
    for field, name in (("Open", "open"), ("High", "high"), ("Low", "low"), ("Close", "close"), ("Volume", "volume")):
        fields.append(F.col(f"r.{name}").alias(field))
    return packed.select("symbol", "year", F.to_json(F.struct(*fields)).alias("payload"))


def to_dated_payload(bars: DataFrame) -> DataFrame:
    cells = {k: ("close" if v == "adj_close" else v) for k, v in DATED_FIELDS.items()}
    fields = F.create_map(*[x for k, v in cells.items() for x in (F.lit(k), F.col(v).cast("string"))])
    entry = F.struct(F.col("ts").cast("string").alias("k"), fields.alias("v"))
    packed = bars.groupBy("symbol", F.year("ts").alias("year")).agg(F.collect_list(entry).alias("e"))
    return packed.select("symbol", "year", F.to_json(F.map_from_entries("e")).alias("payload"))
