"""The corpus pipeline: quality rules, near-duplicates, decontamination, mixing, sharding.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept; all but the last return
the columns of documents.  A stage that cannot be written in SQL is compared with brute force in the tests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import decontaminate, mixing, near_dedup, quality, sharding
from barloom.session import stored

SHARDS = 40


def _same_columns(out: DataFrame, docs: DataFrame) -> DataFrame:
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are near their language's references."""
    return _same_columns(quality.judged(docs).where("_quality.kept"), docs)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8."""
    return near_dedup.one_of_each(docs, k=5, percent=80)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated with benchmark items."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = docs.select(whole, F.col("text").alias("_text"))
    found = decontaminate.verdicts(decontaminate.scan(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), text="_text"))
    return found.where("not contaminated").select("_row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources by weight; a document stands in it as often as it is taken."""
    return mixing.mix(docs)


def into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row of the mix."""
    return sharding.shard(docs, SHARDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("near_dedup", keep_one_of_each),
    ("decontaminate", keep_clean),
    ("mix", mix_sources),
    ("shard", into_shards),
]

#: the verdicts of the first two stages (distances, sketches) have no SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages one after the other; what a stage keeps is written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
