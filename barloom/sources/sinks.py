"""Exports: delimited files, text reports, partitioned history."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.sources.bars import dedupe_bars

KEY = ("symbol", "ts", "source")


def decimal_comma(df: DataFrame) -> DataFrame:
    """Text columns for export: ISO dates, decimal commas."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        if kind in ("double", "float", "decimal"):
            out.append(F.translate(F.col(f.name).cast("string"), ".", ",").alias(f.name))
        elif kind in ("date", "timestamp", "timestamp_ntz"):
            out.append(F.date_format(f.name, "yyyy-MM-dd").alias(f.name))
        else:
            out.append(F.col(f.name).cast("string").alias(f.name))
    return df.select(*out)


def write_delimited(df: DataFrame, path: str) -> None:
    """``;``-separated files with decimal commas; written by all tasks in parallel."""
    decimal_comma(df).write.option("sep", ";").option("header", True).csv(path)


def report_lines(title: Column, values: dict[str, Column]) -> Column:
    """Array of report lines: title, ``Key name: value`` lines, closing rule."""
    lines = [F.concat(F.lit("--- "), title, F.lit(" ---"))]
    for key, value in values.items():
        label = key.replace("_", " ").capitalize()
        lines.append(F.concat(F.lit(f"{label}: "), F.coalesce(value.cast("string"), F.lit("None"))))
    lines.append(F.lit("-" * 20))
    return F.array(*lines)


def write_report(df: DataFrame, title: Column, values: dict[str, Column], path: str) -> None:
    """One block of lines per row."""
    df.select(F.concat_ws("\n", report_lines(title, values)).alias("value")).write.text(path)


def write_history(bars: DataFrame, path: str, mode: str = "append") -> None:
    """Bars table partitioned by symbol and year, one row per (symbol, ts, source), also over
    several loads: rows whose key an earlier load wrote are left out.

    Rows are shuffled by (symbol, year), so no task writes more than one calendar year of
    a symbol and no partition is split over many files.
    """
    out = dedupe_bars(bars).withColumn("year", F.year("ts"))
    if mode == "append":
        try:
            held = bars.sparkSession.read.parquet(path).select("year", *KEY)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
        else:
            out = out.join(held, ["year", *KEY], "left_anti").select(out.columns)
    out.repartition("symbol", "year").write.mode(mode).partitionBy("symbol", "year").parquet(path)
