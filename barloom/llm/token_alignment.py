"""Alignment of two tokenizers' tokens over the same bytes, and how often each pair of ids ends together.

Both tokenizers cut a text's bytes; a byte offset where a token of both ends is a shared cut.  Groups are found by divide
and conquer: from the token of A in the middle of an interval outwards, the nearest end that bisection finds among the
ends of B is a shared cut; both halves are worked on in the same way, and an interval without an inner cut is a group.
All intervals of a run of texts are halved at once, level by level, so a step is a few array operations.

The last tokens of a group of A and of B end together: a link.  Links are counted by pair of ids in three steps.  A task
takes documents in blocks of about ``BLOCK`` bytes of text and writes one row a block, with its documents, their links as
places in the block's list of pairs, and how often each pair occurs in the block.  The blocks' counts are summed by pair
(they merge map-side; a pair that is in all blocks is one row a block).  Each block's pairs get their corpus-wide counts
back, and the documents' sums are made block by block.  What a task holds is bounded by a block, or by one longer text.

Cases: a text that is null or empty, or that a tokenizer does not give back byte by byte, has no tokens, so zeros and an
empty group list; special tokens' strings in a text are plain text; rows with null or equal ids each count; an empty
table gives no rows; other columns are not read (:func:`aligned` keeps them).
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.types import INT, LONG, many, row
from barloom.session import stored

#: the vocabulary files; parameters of all functions here
FILE_A, FILE_B = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: bytes of text of a block, and of a run that is encoded at once
BLOCK, RUN = 4 << 20, 1 << 18
RESULT = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _byte_level() -> dict[str, int]:
    """The characters that stand for the 256 bytes in byte-level vocabularies: printable ones for themselves, the others
    by the characters from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers and the bytes of their tokens, from the contents of their files."""

    def __init__(self, a: bytes, b: bytes) -> None:
        import sentencepiece
        import tiktoken

        model = json.loads(a)
        byte_of = _byte_level()
        special = {t["content"] for t in model["added_tokens"] if t["special"]}
        entries = {bytes(byte_of[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
        # GPT-2's pattern of words, which this pre-tokenizer stands for (fixed value)
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        self.a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=entries, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        n = max(entries.values()) + 1
        self.bytes_a = [b""] * n
        for token, i in entries.items():
            self.bytes_a[i] = token
        self.bytes_b = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        self.n_b = len(self.bytes_b)
        self.size_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.size_b = np.array([len(x) for x in self.bytes_b], np.int64)
        # a token of A ends with , or | (last of its group), one of B with , or ;
        self.written = [f"{i}{c}" for c in ",|" for i in range(n)] + [f"{i}{c}" for c in ",;" for i in range(self.n_b)]

    def encoded(self, text: str) -> tuple[list[int], list[int]]:
        """The ids of A and of B; none where a text is not given back."""
        if not text:
            return [], []
        spaced = " " + text
        raw = spaced.encode()
        a, b = self.a.encode_ordinary(spaced), self.b.encode(text)
        whole = b"".join(map(self.bytes_a.__getitem__, a)) == raw and b"".join(map(self.bytes_b.__getitem__, b)) == raw
        return (a, b) if whole else ([], [])


_loaded: dict[bytes, Tokenizers] = {}


def _tokenizers(files: tuple[bytes, bytes]) -> Tokenizers:
    """One pair a worker."""
    key = hashlib.sha256(files[0] + files[1]).digest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Tokenizers(*files)
    return _loaded[key]


def _read(*paths: str) -> tuple[bytes, ...]:
    """The vocabulary files, a few MB, which tasks get along with the code."""
    out = []
    for path in paths:
        with open(path, "rb") as f:
            out.append(f.read())
    return tuple(out)


def _nearest(a: np.ndarray, b: np.ndarray, middle: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each interval, the place nearest to its middle in [low, high) of ``a`` whose end is also one of ``b``, or -1."""
    out = np.full(len(middle), -1, np.int64)
    left = np.flatnonzero(low < high)
    inner, outer = 0, 1
    while len(left):
        away = np.arange(inner, outer)
        steps = np.stack([away, -away], 1).ravel() if inner else away
        at = middle[left][:, None] + steps
        inside = (at >= low[left][:, None]) & (at < high[left][:, None])
        value = a[np.where(inside, at, 0)]
        found = np.searchsorted(b, value.ravel()).reshape(value.shape)
        shared = inside & (b[np.minimum(found, len(b) - 1)] == value)
        hit = shared.any(1)
        out[left[hit]] = at[hit, shared[hit].argmax(1)]
        further = ~hit & ((middle[left] - outer >= low[left]) | (middle[left] + outer < high[left]))
        left = left[further]
        inner, outer = outer, 2 * outer
        # few intervals are long; a step holds at most some million places
        while len(left) * 2 * (outer - inner) > 1 << 23 and outer - inner > 1:
            outer = inner + (outer - inner) // 2
    return out


def shared_cuts(a: np.ndarray, b: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The places in ``a`` of all ends that are also in ``b``, ascending.  ``a`` and ``b`` are the ascending ends of many
    texts, one after the other; ``first`` holds the place in ``a`` of each text's first token, and the end."""
    low, high = first[:-1], first[1:]
    low, high = low[low < high], high[low < high]
    cuts = [high - 1]
    while len(low):
        middle = (low + high - 2) // 2
        at = _nearest(a, b, middle, low, high - 1)
        cut = at >= 0
        at, low, high = at[cut], low[cut], high[cut]
        cuts.append(at)
        low, high = np.concatenate([low, at + 1]), np.concatenate([at + 1, high])
        long = high - low > 1
        low, high = low[long], high[long]
    return np.sort(np.concatenate(cuts))


@dataclass
class Aligned:
    """The alignment of a run of texts: ids and ends of all tokens, first token of each text, places of the last tokens
    of all groups, and the first group of each text."""

    ids_a: np.ndarray
    ids_b: np.ndarray
    ends: np.ndarray
    first_a: np.ndarray
    first_b: np.ndarray
    last_a: np.ndarray
    last_b: np.ndarray
    first_group: np.ndarray


def align(t: Tokenizers, texts: list[str | None]) -> Aligned:
    pairs = [t.encoded(x or "") for x in texts]
    first_a = np.array([0, *accumulate(len(a) for a, _ in pairs)], np.int64)
    first_b = np.array([0, *accumulate(len(b) for _, b in pairs)], np.int64)
    ids_a = np.fromiter((i for a, _ in pairs for i in a), np.int64, int(first_a[-1]))
    ids_b = np.fromiter((i for _, b in pairs for i in b), np.int64, int(first_b[-1]))
    ends_a, ends_b = np.cumsum(t.size_a[ids_a]), np.cumsum(t.size_b[ids_b])
    last_a = shared_cuts(ends_a, ends_b, first_a)
    last_b = np.searchsorted(ends_b, ends_a[last_a])
    return Aligned(ids_a, ids_b, ends_a, first_a, first_b, last_a, last_b, np.searchsorted(last_a, first_a))


def written(t: Tokenizers, x: Aligned) -> list[str]:
    """The groups of each text as ``a1,a2|b1;a3|b2,b3``."""
    n_a, n_b, entries = len(x.ids_a), len(x.ids_b), len(t.bytes_a)
    end_a, end_b = np.zeros(n_a, np.int64), np.zeros(n_b, np.int64)
    end_a[x.last_a] = end_b[x.last_b] = 1
    group_a, group_b = np.cumsum(end_a) - end_a, np.cumsum(end_b) - end_b
    upto_a, upto_b = np.concatenate([[0], x.last_a + 1]), np.concatenate([[0], x.last_b + 1])
    order = np.empty(n_a + n_b, np.int64)
    order[np.arange(n_a) + upto_b[group_a]] = x.ids_a + entries * end_a
    order[np.arange(n_b) + upto_a[group_b + 1]] = x.ids_b + 2 * entries + t.n_b * end_b
    first = (x.first_a + x.first_b).tolist()
    return ["".join(map(t.written.__getitem__, order[i:j].tolist()))[:-1] for i, j in zip(first[:-1], first[1:])]


@dataclass
class _Block:
    rows: list[dict] = field(default_factory=list)
    links: list[np.ndarray] = field(default_factory=list)
    size: int = 0

    def add(self, t: Tokenizers, keys: list, texts: list[str | None]) -> None:
        x = align(t, texts)
        self.links.append(x.ids_a[x.last_a] * t.n_b + x.ids_b[x.last_b])
        columns = np.diff(x.first_a).tolist(), np.diff(x.first_b).tolist(), np.diff(x.first_group).tolist()
        for key, n_a, n_b, n, groups in zip(keys, *columns, written(t, x)):
            sha = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
            self.rows.append({"key": key, "n_a": n_a, "n_b": n_b, "n_groups": n, "groups_sha256": sha})

    def batch(self, number: int, schema: pa.Schema) -> pa.RecordBatch:
        links = np.concatenate(self.links) if self.links else np.zeros(0, np.int64)
        pairs, at, counts = np.unique(links, return_inverse=True, return_counts=True)
        of = np.repeat(np.arange(len(self.rows)), [r["n_groups"] for r in self.rows])
        own, times = np.unique(of * max(len(pairs), 1) + at, return_counts=True)
        sizes = np.bincount(own // max(len(pairs), 1), minlength=len(self.rows))
        rows = [r | {"n_pairs": int(n)} for r, n in zip(self.rows, sizes)]
        values = [[number], [rows], [(own % max(len(pairs), 1)).astype(np.int32)], [times.astype(np.int32)], [pairs], [counts]]
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, schema)], schema=schema)


def _blocks(files: tuple[bytes, bytes], key: pa.DataType):
    one = pa.struct([("key", key), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups_sha256", pa.string()), ("n_pairs", pa.int64())])
    schema = pa.schema([("block", pa.int64()), ("rows", pa.list_(one)), ("own", pa.list_(pa.int32())), ("times", pa.list_(pa.int32())), ("pairs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizers(files)
        number, block = TaskContext.get().partitionId() << 32, _Block()
        for batch in batches:
            keys, texts, size = [], [], 0
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text")):
                keys.append(key)
                texts.append(text.as_py())
                size += len(texts[-1] or "")
                if size >= RUN:
                    block.add(t, keys, texts)
                    block.size += size
                    keys, texts, size = [], [], 0
                if block.size >= BLOCK:
                    yield block.batch(number, schema)
                    number, block = number + 1, _Block()
            if keys:
                block.add(t, keys, texts)
                block.size += size
        if block.rows:
            yield block.batch(number, schema)

    return blocks


def _summed(key, left: pa.Table, right: pa.Table) -> pa.Table:
    """The rows of a block with their sums over the corpus-wide counts of their pairs."""
    count, best = np.zeros(right.num_rows, np.int64), np.zeros(right.num_rows, np.int64)
    place = right.column("place").to_numpy()
    count[place], best[place] = right.column("count").to_numpy(), right.column("best").to_numpy()
    rows = left.column("rows").combine_chunks().flatten()
    n_pairs = rows.field("n_pairs").to_numpy()
    own, times = (left.column(c).combine_chunks().flatten().to_numpy() for c in ("own", "times"))
    upto = np.concatenate([[0], np.cumsum(n_pairs)])
    sums = [np.concatenate([[0], np.cumsum(times * x[own])]) for x in (best, count)]
    n_best, count_sum = (pa.array(s[upto[1:]] - s[upto[:-1]]) for s in sums)
    n_groups = rows.field("n_groups")
    columns = [rows.field("key"), rows.field("n_a"), rows.field("n_b"), n_groups, n_groups, n_best, count_sum, rows.field("groups_sha256")]
    return pa.table(columns, names=["key", *[f.split(" ")[0] for f in RESULT.split(", ")]])


def link_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", file_a: str = FILE_A, file_b: str = FILE_B) -> DataFrame:
    """One row a document: the (integer) key and the columns of ``RESULT``."""
    files = _read(file_a, file_b)
    n_b = _tokenizers(files).n_b
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    schema = "block long, rows array<struct<key long, n_a long, n_b long, n_groups long, groups_sha256 string, n_pairs long>>, own array<int>, times array<int>, pairs array<long>, counts array<long>"
    blocks = stored(rows.mapInArrow(_blocks(files, pa.int64()), schema), "alignment-blocks")
    in_block = blocks.select("block", F.posexplode(F.arrays_zip("pairs", "counts"))).select(F.col("block").alias("home"), F.col("pos").alias("place"), F.col("col.pairs").alias("pair"), F.col("col.counts").alias("n"))
    counts = stored(in_block.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("b", F.col("pair") % n_b), "alignment-counts")
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    judged = counts.join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).cast("long").alias("best"))
    known = in_block.select("home", "place", "pair").join(judged, "pair").select("home", "place", "count", "best")
    work = blocks.select("block", "rows", "own", "times").groupBy("block").cogroup(known.groupBy("home"))
    return work.applyInArrow(_summed, f"key long, {RESULT}").withColumnRenamed("key", key)


def aligned(docs: DataFrame, text: str = "text", result: str = "_groups", file_a: str = FILE_A, file_b: str = FILE_B) -> DataFrame:
    """``docs`` with an array ``result`` of groups: ids of A, ids of B, and the byte offset (of the text after a space)
    where the group ends."""
    files = _read(file_a, file_b)
    group = row(a=many(INT), b=many(INT), end=LONG)

    @F.arrow_udf(many(group))
    def groups(texts: pa.Array) -> pa.Array:
        t, out = _tokenizers(files), []
        for one in texts:
            x = align(t, [one.as_py()])
            from_a, from_b = [0, *(x.last_a + 1).tolist()], [0, *(x.last_b + 1).tolist()]
            ends = x.ends[x.last_a].tolist()
            out.append([{"a": x.ids_a[i:j].tolist(), "b": x.ids_b[k:m].tolist(), "end": e} for i, j, k, m, e in zip(from_a, from_a[1:], from_b, from_b[1:], ends)])
        return pa.array(out, pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32())), ("end", pa.int64())])))

    columns = [F.col(f"`{c}`") for c in docs.columns if c != result]
    return docs.select(*columns, groups(F.col(f"`{text}`")).alias(result))
