"""Quality rules by divergence from language references.

Two histograms of a document, of character classes and of common words, are compared with those of its language
by the Jensen-Shannon distance (base 2, so 0 to 1).  References are counts over all documents of a language, with its
``COMMON`` most frequent words; every language has one, and the table of them is joined to the documents.  A histogram of
few words is noise: the word distance counts only from ``LEAST_WORDS`` words on, the character distance from
``LEAST_CHARS`` characters on.  A distance to a reference of fewer than ``REFERENCE_WORDS`` words or ``REFERENCE_CHARS``
characters, or to the pooled one of a null language, is given but rejects nothing; the base rules alone decide there.

Cases: null or empty text has no words and fails the base rule; a null language is measured by the pooled reference; equal
counts of words are ordered by the word; with an empty table there is no reference and no row; rows that repeat count
as often as they occur; other columns are kept by :func:`judged`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm import words as w
from barloom.llm.types import DOUBLE, LONG, row
from barloom.session import batches_by_bytes, stored

COMMON = 60
LEAST_WORDS = 50
LEAST_CHARS = 200
MOST_CHAR_DISTANCE = 0.32
MOST_WORD_DISTANCE = 0.47
#: the size that a reference must have to reject a document
REFERENCE_WORDS = 2_000
REFERENCE_CHARS = 10_000
#: marks counted as symbols (fixed by the base rules)
SYMBOLS = b"#*$%&|<>"
CLASSES = ("lower", "upper", "letter", "digit", "blank", "sentence", "symbol", "other")


def _classes() -> np.ndarray:
    """The class of the character that a byte starts; continuation bytes start none."""
    table = np.full(256, 7)
    table[0x61:0x7B], table[0x41:0x5B], table[0xC0:], table[0x30:0x3A] = 0, 1, 2, 3
    table[w.BLANKS] = 4
    table[list(b".,;:!?'\"()-")] = 5
    table[list(SYMBOLS)] = 6
    matrix = np.zeros((256, len(CLASSES)), np.int64)
    matrix[np.arange(256), table] = 1
    matrix[0x80:0xC0] = 0
    return matrix


_CLASSES = _classes()


def _byte_counts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.array([np.bincount(data[a:b], minlength=256) for a, b in zip(at[:-1], at[1:])]).reshape(-1, 256)


def _classed(batches):
    """Class counts of each run of texts and language: rows (lang, item, n)."""
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        counts: dict[str | None, np.ndarray] = {}
        for first, end, data, at in w.texts(batch.column("text")):
            chars = _byte_counts(data, at) @ _CLASSES
            for lang, own in zip(langs[first:end], chars):
                counts[lang] = counts.get(lang, 0) + own
        rows = [(lang, name, int(n)) for lang, own in counts.items() for name, n in zip(CLASSES, own) if n]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int64()))], ["lang", "item", "n"])


def references(docs: DataFrame, text: str = "text", lang: str = "lang", common: int = COMMON) -> DataFrame:
    """The references (lang, chars, words, counts, total) of all languages and of the whole (null), from all documents.

    Counts are summed per word over the cluster; ``words`` are the ``common`` most frequent ones, parted by blanks.
    """
    batches_by_bytes(docs.sparkSession)
    texts = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    chars = texts.mapInArrow(_classed, "lang string, item string, n long").groupBy("lang", "item").agg(F.sum("n").alias("n"))
    words = texts.select("lang", F.explode(F.split("text", r"[\x20\x09-\x0D]+")).alias("item")).where("item != ''").groupBy("lang", "item").agg(F.count(F.lit(1)).alias("n"))
    words = stored(words, "quality-words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n")).select("lang", F.lit("").alias("item"), "n")
    kind = lambda rows, name: rows.select("lang", F.lit(name).alias("kind"), "item", "n")
    few = stored(kind(chars, "chars").unionByName(kind(totals, "total")), "quality-counts")
    by_lang = few.unionByName(kind(words, "words"))
    own = by_lang.where(F.col("lang").isNotNull())
    pooled = by_lang.groupBy("kind", "item").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("lang"), "kind", "item", "n")
    every = own.unionByName(pooled)
    part = F.pmod(F.xxhash64("item"), F.lit(64))
    top = (
        every.where("kind = 'words'")
        .withColumn("_rank", F.row_number().over(Window.partitionBy("lang", part).orderBy(F.desc("n"), "item")))
        .where(F.col("_rank") <= common)
        .withColumn("_rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "item")))
        .where(F.col("_rank") <= common)
        .drop("_rank")
    )
    number = lambda kind, item: F.coalesce(F.sum(F.when((F.col("kind") == kind) & (F.col("item") == item), F.col("n"))), F.lit(0))
    listed = F.array_sort(F.collect_list(F.when(F.col("kind") == "words", F.struct((-F.col("n")).alias("n"), "item"))))
    made = top.unionByName(every.where("kind != 'words'")).groupBy("lang").agg(F.array(*[number("chars", c) for c in CLASSES]).alias("chars"), listed.alias("_w"), number("total", "").alias("total"))
    made = made.select("lang", "chars", F.array_join("_w.item", " ").alias("words"), F.transform("_w.n", lambda n: -n).alias("counts"), "total")
    return stored(made, "quality-references")


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2) of the rows of two tables of counts; 0 where a row has no counts."""
    p = p / np.maximum(p.sum(-1, keepdims=True), 1)
    q = q / np.maximum(q.sum(-1, keepdims=True), 1)
    m = (p + q) / 2
    part = lambda x: np.where(x > 0, x * np.log2(np.maximum(x, 1e-300) / np.maximum(m, 1e-300)), 0).sum(-1)
    return np.sqrt(np.clip((part(p) + part(q)) / 2, 0, 1))


RESULT = pa.struct([(n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [("char_distance", pa.float64()), ("word_distance", pa.float64())])
RESULT_TYPE = row(**{x.name: LONG if x.type == pa.int64() else DOUBLE for x in RESULT})


def _repeated(hashes: np.ndarray, first: np.ndarray, k: int = 8) -> np.ndarray:
    """Words of each text that lie in runs of ``k`` words found twice or more in it."""
    runs, doc, start = w.shingles(hashes, first, k)
    out = np.zeros(len(first) - 1, np.int64)
    if not len(runs):
        return out
    own = w.mix(runs ^ w.mix(doc.astype(np.uint64) + np.uint64(1)))
    ordered = np.sort(own)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return out
    at = np.minimum(np.searchsorted(twice, own), len(twice) - 1)
    again = start[twice[at] == own]
    edges = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edges, again, 1)
    np.add.at(edges, again + k, -1)
    inside = np.concatenate([[0], np.cumsum(np.cumsum(edges)[:-1] > 0)])
    return inside[first[1:]] - inside[first[:-1]]


def _dup_lines(raw: bytes) -> int:
    seen: set[bytes] = set()
    n = 0
    for line in raw.split(b"\n"):
        if line in seen:
            n += 1
        elif line and not line.isspace():
            seen.add(line)
    return n


def _tables(refs: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Class counts and word counts (the last of them of all other words) by reference; sorted keys of (reference,
    word) and the column of each."""
    char_refs = np.array([x["chars"] for x in refs], float).reshape(-1, len(CLASSES))
    width = max(len(x["counts"]) for x in refs) + 1
    word_refs = np.zeros((len(refs), width))
    keys, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for i, x in enumerate(refs):
        size = len(x["counts"])
        word_refs[i, :size] = x["counts"]
        word_refs[i, -1] = x["total"] - sum(x["counts"])
        if size:
            raw = np.frombuffer(x["words"].encode(), np.uint8)
            starts, ends, _ = w.cut(raw, np.array([0, len(raw)]))
            h = w.word_hashes(raw, starts, ends)
            keys.append(w.mix(h ^ w.mix(np.full(len(h), i + 1, np.uint64))))
            places.append(np.arange(size))
    key, place = np.concatenate(keys), np.concatenate(places)
    order = np.argsort(key)
    return char_refs, word_refs, key[order], place[order]


def _features(pooled: dict):
    @F.arrow_udf(RESULT_TYPE)
    def features(texts: pa.Array, langs: pa.Array, refs: pa.Array) -> pa.Array:
        out: list[pa.Array] = []
        index: dict[str | None, int] = {None: 0}
        held = [pooled]
        lang = np.zeros(len(langs), np.int64)
        for i, x in enumerate(langs.to_pylist()):
            if x not in index:
                own = refs[i].as_py()
                index[x] = len(held) if own else 0
                held += [own] if own else []
            lang[i] = index[x]
        char_refs, word_refs, keys, places = _tables(held)
        width = word_refs.shape[1]
        for first, end, data, at in w.texts(texts):
            starts, ends, first_word = w.cut(data, at)
            hashes = w.word_hashes(data, starts, ends)
            n = np.diff(first_word)
            by_byte = _byte_counts(data, at)
            chars = by_byte @ _CLASSES
            own = lang[first:end]
            of_word = np.repeat(np.arange(end - first), n)
            common = np.zeros((end - first, width))
            if len(keys) and len(hashes):
                salted = w.mix(hashes ^ w.mix(own.astype(np.uint64) + np.uint64(1))[of_word])
                found = np.minimum(np.searchsorted(keys, salted), len(keys) - 1)
                hit = keys[found] == salted
                common += np.bincount(of_word[hit] * width + places[found[hit]], minlength=(end - first) * width).reshape(-1, width)
            common[:, -1] = n - common.sum(1)
            raw = data.tobytes()
            n_chars = chars.sum(1)
            out.append(
                pa.StructArray.from_arrays(
                    [
                        pa.array(n),
                        pa.array(n_chars - by_byte[:, w.BLANKS].sum(1)),
                        pa.array(by_byte[:, list(SYMBOLS)].sum(1)),
                        pa.array([_dup_lines(raw[a:b]) for a, b in zip(at[:-1], at[1:])], pa.int64()),
                        pa.array(_repeated(hashes, first_word)),
                        pa.array(np.where(n_chars >= LEAST_CHARS, distance(chars, char_refs[own]), 0.0)),
                        pa.array(np.where(n >= LEAST_WORDS, distance(common, word_refs[own]), 0.0)),
                    ],
                    [x.name for x in RESULT],
                )
            )
        return pa.concat_arrays(out) if out else pa.array([], RESULT)

    return features


def judged(docs: DataFrame, refs: DataFrame | None = None, text: str = "text", lang: str = "lang", result: str = "_quality") -> DataFrame:
    """``docs`` with a struct ``result``: the base counts, both distances, ``base_failed`` and ``kept``."""
    batches_by_bytes(docs.sparkSession)
    refs = references(docs, text, lang) if refs is None else refs
    q = result
    columns = ["chars", "words", "counts", "total"]
    pooled = refs.where("lang is null").select(*columns).first()
    whole = pooled.asDict() if pooled else {"chars": [0] * len(CLASSES), "words": "", "counts": [], "total": 0}
    own = refs.where("lang is not null").select(F.col("lang").alias("_ref_lang"), F.struct(*columns).alias("_ref"))
    columns = [F.col(f"`{c}`") for c in docs.columns if c != q]
    out = docs.select(F.struct(*columns).alias("_all"), F.col(text).alias("_text"), F.col(lang).cast("string").alias("_lang"))
    out = out.join(own, F.col("_lang") == F.col("_ref_lang"), "left").withColumn(q, _features(whole)("_text", "_lang", "_ref"))
    failed = (F.col(f"{q}.n_words") < 20) | (100 * F.col(f"{q}.n_repeat_words") > 30 * F.col(f"{q}.n_words"))
    few_chars = F.coalesce(F.aggregate("_ref.chars", F.lit(0).cast("long"), lambda a, n: a + n), F.lit(0)) < REFERENCE_CHARS
    few_words = F.coalesce("_ref.total", F.lit(0)) < REFERENCE_WORDS
    near = (few_chars | (F.col(f"{q}.char_distance") <= MOST_CHAR_DISTANCE)) & (few_words | (F.col(f"{q}.word_distance") <= MOST_WORD_DISTANCE))
    return out.select("_all.*", F.col(q).withField("base_failed", failed).withField("kept", ~failed & near).alias(q))
