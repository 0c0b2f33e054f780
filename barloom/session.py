"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None, **conf) -> SparkSession:
    """A UTC session with adaptive execution; on a cluster leave ``master`` unset.

    ``shuffle_partitions`` is only for small local runs.  At scale leave it to the
    cluster's setting: AQE coalesces from there to advisory-sized partitions.
    """
    builder = (
        SparkSession.builder.appName("barloom")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        # bars are few bytes but many window steps: keep tasks for all cores, do not merge
        # partitions up to the default 1 MB
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, taken from ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine (tests) is a local
    temporary folder made, and then remembered in the session.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.barloom.workdir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
        folder = tempfile.mkdtemp(prefix="barloom-")
        spark.conf.set("spark.barloom.workdir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/barloom/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table that several jobs read into the shared folder and read it back; the
    lineage is cut and a lost executor costs a re-read, not a recomputation."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def batches_by_bytes(spark: SparkSession, most: str = "4m") -> None:
    """Send texts to Python in Arrow batches of a few MB: 10,000 rows of long texts, which are held several times over
    beside the heap, fill an executor.  A limit that the session names stays."""
    if BATCH_BYTES not in spark.conf.getAll:
        spark.conf.set(BATCH_BYTES, most)
