"""Document fingerprints from Lempel-Ziv phrases.

A text's characters are parsed into dictionary phrases (each the shortest run, from where the last one ended, that is not yet
in the dictionary).  The phrases are hashed as a set (CRC-32, then mixed), and the ``SIZE`` least hashes are the fingerprint: 8 hex digits each,
ascending.  The likeness of two fingerprints estimates the overlap (Jaccard) of the phrase sets, which follows how much
better two texts compress together: of the ``SIZE`` least hashes of both, the share found in both.  Two texts of no more
than ``SIZE`` phrases are compared exactly.

:func:`prints` also makes, for each document, a text edited halfway with its neighbour in descending order of the key and
compares with both.  Documents are dealt to key ranges once, between keys drawn from a bounded sample weighted by size;
the row at a range's edge goes to the range before as well, where it only serves as the neighbour.  Inside a range rows
pass by one after the other, two at a time, so a task holds an Arrow batch and one more row.

Cases: null text is empty; an empty text has an empty fingerprint, is like another empty one (1) and unlike any other (0);
null keys come last; rows of the same key are ordered by a hash of the text, and rows that repeat are neighbours; a single
row is its own neighbour; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm import words as w

SIZE = 128
#: keys drawn for each range; ``ranges`` * this many rows reach the driver
DRAWN = 32
#: the most text of a range, about
RANGE_BYTES = 64 << 20
RESULT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


class Phrases:
    """The dictionary of one text's phrases, and the phrase that is still open."""

    def __init__(self) -> None:
        self.seen: set[str] = set()
        self.open = ""

    def parse(self, text: str) -> list[str]:
        """The phrases that end in this piece of a text; goes on from the piece before."""
        seen, phrase, new = self.seen, self.open, []
        for character in text:
            phrase += character
            if phrase not in seen:
                seen.add(phrase)
                new.append(phrase)
                phrase = ""
        self.open = phrase
        return new


def hashed(phrases: list[str]) -> np.ndarray:
    """A 32-bit hash of each phrase."""
    sums = np.fromiter(map(crc32, map(str.encode, phrases)), np.uint64, len(phrases))
    return (w.mix(sums + np.uint64(1)) >> np.uint64(32)).astype(np.uint32)


def least(*hashes: np.ndarray) -> list[int]:
    """The signature of a set of phrases: its least hashes, ascending."""
    return np.unique(np.concatenate(hashes))[:SIZE].tolist()


def likeness(a: list[int], b: list[int]) -> float:
    """The estimated overlap of two phrase sets."""
    if not a or not b:
        return float(len(a) == len(b))
    one, other = set(a), set(b)
    both = sorted(one | other)[:SIZE]
    return sum(x <= both[-1] for x in one & other) / len(both)


def own_print(text: str) -> list[int]:
    return least(hashed(Phrases().parse(text)))


def both_prints(text: str, following: str) -> tuple[str, list[int], list[int]]:
    """The text edited with the one that follows it, and the signatures of the text and of the edited one, which share
    the parse of the first half."""
    cut = (len(text) + 1) // 2
    book = Phrases()
    head = hashed(book.parse(text[:cut]))
    still_open = book.open
    tail = book.parse(text[cut:])
    book.seen.difference_update(tail)
    book.open = still_open
    put_in = following[: len(text) - cut]
    return text[:cut] + put_in, least(head, hashed(tail)), least(head, hashed(book.parse(put_in)))


def hexed(signed: list[int]) -> str:
    return np.array(signed, ">u4").tobytes().hex()


_FIELDS = [pa.field(f.split(" ")[0], {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[f.split(" ")[1]]) for f in RESULT.split(", ")]
_SCHEMA = pa.schema([pa.field("key", pa.int64()), *_FIELDS])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of rows (part, edge, key, text) in order; a range's edges follow its rows."""
    held: tuple | None = None  # part, key and text of a row whose neighbour is still to come
    half: list | None = None  # the result of the row before it, but for the neighbour's likeness
    for batch in batches:
        rows: list[list] = []
        for part, edge, key, text in zip(batch.column("part").to_pylist(), batch.column("edge").to_pylist(), batch.column("key").to_pylist(), batch.column("text")):
            text = text.as_py() or ""
            if held and held[0] == part:
                edited, own, other = both_prints(held[2], text)
                if half:
                    rows.append([*half[0], likeness(half[1], own)])
                result = [held[1], len(held[2]), hashlib.sha256(edited.encode()).hexdigest(), hexed(own), hexed(other), likeness(own, other)]
                half = [result, own]
            if edge and half:
                rows.append([*half[0], likeness(half[1], own_print(text))])
                half = None
            held = None if edge else (part, key, text)
        columns = zip(*rows) if rows else [[] for _ in _SCHEMA]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA)], schema=_SCHEMA)


def _place() -> Column:
    """The order of the rows, greatest first: null keys last, equal keys by a hash of the text."""
    return F.struct(F.col("key").isNotNull().alias("known"), "key", "h")


def _bounds(rows: DataFrame, ranges: int) -> list[tuple]:
    """The first row's place of each range, descending: the whole table's first, then keys at equal shares of the drawn
    bytes.  A range's share is at most about 64 MB."""
    first = rows.agg(F.max(_place())).first()[0]
    if first is None:
        return []
    total = rows.count()
    while True:
        drawn = rows.select(_place().alias("o"), "size").sample(fraction=min(1.0, DRAWN * ranges / total), seed=7).collect()
        wanted = math.ceil(sum(x["size"] for x in drawn) / max(len(drawn), 1) * total / RANGE_BYTES)
        if wanted <= ranges:
            break
        ranges = 2 * wanted
    places = sorted(((tuple(x["o"]), x["size"]) for x in drawn), key=lambda x: (x[0][0], x[0][1] or 0, x[0][2]), reverse=True)
    share, seen, bounds = sum(x[1] for x in places) / ranges, 0, [tuple(first)]
    for place, size in places:
        if seen >= share * len(bounds) and place != bounds[-1]:
            bounds.append(place)
        seen += size
    return bounds


def prints(docs: DataFrame, key: str = "doc_id", text: str = "text", ranges: int | None = None) -> DataFrame:
    """One row a document: the (integer) key and the columns of ``RESULT``."""
    spark = docs.sparkSession
    texts = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = texts.withColumn("h", F.xxhash64("text"))
    bounds = _bounds(rows.select("key", "h", (F.octet_length("text") + 64).alias("size")), ranges or int(spark.conf.get("spark.sql.shuffle.partitions")))
    if not bounds:
        return rows.select("key", *[F.lit(None).cast(f.split(" ")[1]).alias(f.split(" ")[0]) for f in RESULT.split(", ")]).where("false").withColumnRenamed("key", key)
    last = len(bounds) - 1
    listed = F.from_json(F.lit(json.dumps([dict(zip(("known", "key", "h"), b)) for b in bounds[1:]])), "array<struct<known boolean, key long, h long>>")
    step = max(1, math.isqrt(last))
    coarse = F.filter(listed, lambda b, i: (i + 1) % step == 0)
    reached = lambda bs: F.size(F.filter(bs, lambda b: F.col("_o") <= b))
    part = F.when(F.lit(last == 0), 0).otherwise(F.col("_c") * step + reached(F.slice(listed, F.col("_c") * step + 1, step)))
    placed = rows.withColumn("_o", _place()).withColumn("_c", reached(coarse)).withColumn("part", part)
    begins = F.from_json(F.lit(json.dumps([dict(zip(("known", "key", "h"), b)) for b in bounds])), "array<struct<known boolean, key long, h long>>")
    before = F.when(F.col("part") == 0, last).otherwise(F.col("part") - 1)
    own = F.struct(F.col("part"), F.lit(False).alias("edge"))
    also = F.struct(before.alias("part"), F.lit(True).alias("edge"))
    at_edge = F.col("_o") == F.get(begins, F.col("part"))
    dealt = placed.select("key", "h", "text", F.explode(F.when(at_edge, F.array(own, also)).otherwise(F.array(own))).alias("to")).select("to.part", "to.edge", "key", "h", "text")
    ordered = dealt.repartitionById(last + 1, F.col("part")).sortWithinPartitions("part", "edge", F.desc_nulls_last("key"), F.desc("h"))
    return ordered.select("part", "edge", "key", "text").mapInArrow(_compared, f"key long, {RESULT}").withColumnRenamed("key", key)
