"""Benchmark decontamination with one Aho-Corasick automaton.

Test items are lower-cased (A-Z) and cut into words; every run of 13 words (a shorter item: all of it) is a
pattern.  One automaton over the patterns scans each normalised text once.  Match ends are mapped back to word
numbers and, for the spans, to code points of the original text.

The automaton is held by every worker, so a block of items is bounded (``BLOCK_CHARS`` of pattern text); a larger
benchmark is worked through in blocks, the stated query set against all rows, and hits are merged per document.

Cases: null or empty text has no words and no hits; an item without words has no window; an item id that occurs
twice is one item with the windows of both texts; a null item id counts as the item ``null``; rows that repeat give
repeated results; an empty benchmark hits nothing; extra columns are kept by :func:`scan`.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.types import LONG, STRING, many, row

WINDOW = 13
BLOCK_CHARS = 16_000_000
#: capitals are not separators here, as the original is not lower-cased
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: separators and capitals of ASCII as one byte table
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_built: dict[str, ahocorasick.Automaton | None] = {}


def normalised(text: str | None) -> list[str]:
    """The words of a text; blanks of other alphabets belong to words, so only the ASCII blank cuts."""
    line = text.encode("utf-8").translate(_FOLD).decode("utf-8") if text else ""
    return [w for w in line.split(" ") if w]


def windows(text: str | None, width: int = WINDOW) -> list[str]:
    """Patterns of an item: words between single blanks, with a blank at both ends."""
    words = normalised(text)
    if not words:
        return []
    return [f" {' '.join(words[i : i + width])} " for i in range(max(1, len(words) - width + 1))]


def blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", most: int = BLOCK_CHARS) -> list[list[tuple[str, str]]]:
    """(item, pattern) pairs in blocks of at most ``most`` characters, read through an iterator."""
    out: list[list[tuple[str, str]]] = [[]]
    size = 0
    for item, content in benchmark.select(F.col(item_id).cast("string"), F.col(text)).toLocalIterator():
        for pattern in sorted(set(windows(content))):
            if size + len(pattern) > most and out[-1]:
                out.append([])
                size = 0
            out[-1].append((item or "null", pattern))
            size += len(pattern)
    return out


def automaton(pairs: list[tuple[str, str]]) -> ahocorasick.Automaton | None:
    """An automaton whose values are (word count, items) of each pattern."""
    items: dict[str, set[str]] = {}
    for item, pattern in pairs:
        items.setdefault(pattern, set()).add(item)
    if not items:
        return None
    made = ahocorasick.Automaton()
    for pattern, of in items.items():
        made.add_word(pattern, (pattern.count(" ") - 1, tuple(sorted(of))))
    made.make_automaton()
    return made


def hits(text: str | None, machine: ahocorasick.Automaton | None) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Number of words, hit word runs (start, end), items."""
    words = normalised(text)
    if not words or machine is None:
        return len(words), [], set()
    line = f" {' '.join(words)} "
    runs: list[tuple[int, int]] = []
    items: set[str] = set()
    blanks = None
    for end, (width, of) in machine.iter(line):
        if blanks is None:
            blanks = np.flatnonzero(np.frombuffer(line.encode("utf-32-le"), np.uint32) == 0x20)
        last = int(np.searchsorted(blanks, end))
        items.update(of)
        if runs and last - width <= runs[-1][1] and last >= runs[-1][1]:
            runs[-1] = (min(runs[-1][0], last - width), last)
        else:
            runs.append((last - width, last))
    runs.sort()
    merged: list[tuple[int, int]] = []
    for a, b in runs:
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return len(words), merged, items


def spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word runs as code point spans of the original text."""
    if not runs:
        return []
    at = [m.span() for m in _WORD.finditer(text)]
    return [(at[a][0], at[b - 1][1]) for a, b in runs]


def _scan(pairs: list[tuple[str, str]]):
    key = hashlib.sha256("\n".join(f"{a}\t{b}" for a, b in pairs).encode()).hexdigest()

    @F.arrow_udf(row(n_words=LONG, spans=many(row(start=LONG, end=LONG)), runs=many(row(start=LONG, end=LONG)), items=many(STRING)))
    def scan_texts(texts: pa.Array) -> pa.Array:
        if key not in _built:
            _built.clear()
            _built[key] = automaton(pairs)
        machine = _built[key]
        counts, places, runs, items = [], [], [], []
        for value in texts:
            text = value.as_py()
            n, found, of = hits(text, machine)
            counts.append(n)
            runs.append([{"start": a, "end": b} for a, b in found])
            places.append([{"start": a, "end": b} for a, b in spans(text, found)] if found else [])
            items.append(sorted(of))
        pair = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.StructArray.from_arrays(
            [pa.array(counts, pa.int64()), pa.array(places, pair), pa.array(runs, pair), pa.array(items, pa.list_(pa.string()))], ["n_words", "spans", "runs", "items"]
        )

    return scan_texts


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", result: str = "_scan") -> DataFrame:
    """``docs`` with a struct: n_words, spans (code points of the original), runs (words), items.

    Several blocks are several scans side by side on the same row; their hits are merged in the row.
    """
    parts = blocks(benchmark, item_id, item_text)
    out = docs.withColumn(result, _scan(parts[0])(F.col(text)))
    for more in parts[1:]:
        out = out.withColumn("__more", _scan(more)(F.col(text)))
        both = F.struct(
            F.col(f"{result}.n_words").alias("n_words"),
            F.concat(f"{result}.spans", "__more.spans").alias("spans"),
            F.concat(f"{result}.runs", "__more.runs").alias("runs"),
            F.array_union(f"{result}.items", "__more.items").alias("items"),
        )
        out = out.withColumn(result, both).drop("__more")
    return out


def covered(runs: Column) -> Column:
    """Number of words in the union of word runs."""
    step = F.aggregate(
        F.array_sort(runs),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")),
        lambda acc, r: F.struct((acc["n"] + F.greatest(F.lit(0).cast("long"), r["end"] - F.greatest(r["start"], acc["to"]))).alias("n"), F.greatest(acc["to"], r["end"]).alias("to")),
    )
    return step["n"]


def verdicts(scanned: DataFrame, result: str = "_scan") -> DataFrame:
    """``n_words``, ``n_hit``, ``n_items``, ``items_sha256`` and ``contaminated`` beside the scan."""
    return (
        scanned.withColumn("n_words", F.col(f"{result}.n_words"))
        .withColumn("n_hit", covered(F.col(f"{result}.runs")))
        .withColumn("n_items", F.size(f"{result}.items").cast("long"))
        .withColumn("items_sha256", F.sha2(F.concat_ws(",", F.array_sort(f"{result}.items")).cast("binary"), 256))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    )
