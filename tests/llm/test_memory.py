"""What the text operators hold at once beside the JVM's heap."""

import random
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barloom.llm import near_dedup, quality
from barloom.llm import words as w
from barloom.session import BATCH_BYTES


@pytest.fixture
def unset(spark):
    """The session without a limit of its own, and as it was afterwards."""
    before = spark.conf.getAll.get(BATCH_BYTES)
    spark.conf.unset(BATCH_BYTES)
    yield spark
    spark.conf.unset(BATCH_BYTES)
    if before is not None:
        spark.conf.set(BATCH_BYTES, before)


def _texts(n, size):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(500)]
    return [" ".join(rng.choice(words) for _ in range(size)) for _ in range(n)]


@pytest.mark.parametrize("name", ["features", "sketch"])
def test_workers_hold_a_few_mb_of_a_batch(name):
    texts = pa.array(_texts(60, 250) * 100)
    assert texts.nbytes > 8e6
    lang = pa.array(["en"] * len(texts))
    ref = {"chars": [9, 1, 0, 0, 2, 0, 0, 0], "words": "ab cd", "counts": [5, 4], "total": 5000}
    run = {"features": lambda: quality._features(ref).func(texts, lang, pa.array([ref] * len(texts))), "sketch": lambda: near_dedup._sketch(5).func(texts)}[name]
    tracemalloc.start()
    try:
        out = run()
        assert tracemalloc.get_traced_memory()[1] < 60e6
    finally:
        tracemalloc.stop()
    # the same figures for the same text, wherever the runs are cut
    rows = out.to_pylist()
    assert len(rows) == len(texts) and rows == rows[:60] * 100


def test_runs_do_not_change_word_hashes(monkeypatch):
    texts = pa.array(_texts(20, 400) + ["z" * 700_000 + " y", "", None])
    whole = [x.tolist() for _, _, data, at in w.texts(texts, 1 << 30) for x in near_dedup.sets(data, at, 3)]
    monkeypatch.setattr(w, "_BLOCK", 1 << 12)
    assert [x.tolist() for _, _, data, at in w.texts(texts, 3000) for x in near_dedup.sets(data, at, 3)] == whole


@pytest.mark.parametrize("method", [quality.judged, near_dedup.near_duplicates])
def test_texts_reach_python_in_batches_of_few_mb(unset, odd, method):
    method(odd)
    rows = unset.range(0, 6000, 1, 1).select(F.concat(F.repeat(F.lit("word "), 800), F.col("id").cast("string")).alias("text"))
    size = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches)
    assert rows.mapInArrow(size, "n long").agg(F.max("n")).first()[0] < 9e6
    unset.conf.set(BATCH_BYTES, "1m")
    method(odd)
    assert unset.conf.get(BATCH_BYTES) == "1m"
