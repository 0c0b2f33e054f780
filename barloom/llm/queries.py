"""The registered queries: each operator over its whole table, with the columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import bwt_dedup, decontaminate, filter_audit, html_paths, line_dedup, lz_prints, mixing, near_dedup, pii, quality, secrets, sharding, token_alignment
from barloom.llm.oracles import ORACLES
from barloom.session import stored

__all__ = ["ORACLES", "QUERIES"]

SHARDS = 40
#: a fixed key, so that results can be compared; a real run names a secret one
KEY = "registered-query"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_paths.extracted(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.verdicts(decontaminate.scan(docs, _table(spark, sf_dir, "benchmark")))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    sizes = stored(mixing.measured(docs).drop("text"), "mix-sizes")
    taken = mixing.allotted(sizes, sizes, mixing.targets(sizes))
    return taken.select("doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * F.col("copies")).alias("taken"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    result, _ = bwt_dedup.cleaned(docs, words=bwt_dedup.PASSAGE)
    return result.select("doc_id", "n_bytes", "n_removed", "n_spans", F.col("sha").alias("kept_sha256"), (F.col("n_removed") > 0).alias("has_repeats"), "shares_passage")


def op5_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality.judged(docs).select(
        "doc_id", *[f"_quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance")]
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = line_dedup.deduplicated(docs)
    text = F.coalesce("_lines.text", F.lit(""))
    return found.select("doc_id", "_lines.n_lines", "_lines.n_removed", "_lines.n_runs", F.length(text).alias("n_chars_kept"), F.sha2(text.cast("binary"), 256).alias("kept_sha256"))


def op7_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(_table(spark, sf_dir, "documents").select("doc_id", "text"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = secrets.BASE + secrets.ADDED
    found = secrets.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"), rules)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(r.name).alias(f"n_{r.name}") for r in secrets.BASE],
        F.sha2(secrets.listed(F.col("spans"), secrets.BASE).cast("binary"), 256).alias("base_sha256"),
        secrets.listed(F.col("spans"), rules).alias("spans"),
    )


def op9_minhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"), k=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replaced(_table(spark, sf_dir, "documents").select("doc_id", "text"), KEY)


def op11_align_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.link_counts(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz_prints.prints(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = filter_audit.counters(spark, f"{sf_dir}/documents.parquet", _table(spark, sf_dir, "labels"))
    return filter_audit.audit(counts)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_html_text,
        op2_decontaminate,
        op3_mix_sources,
        op4_suffix_dedup,
        op5_quality_divergence,
        op6_line_dedup,
        op7_sampled_splitters,
        op8_secret_scan,
        op9_minhash_join,
        op10_pii_surrogates,
        op11_align_tokens,
        op12_lz_fingerprint,
        op13_filter_audit,
    )
}
