"""Exact removal of repeated byte strings over a whole corpus.

Every byte covered by a string of ``length`` bytes that also starts anywhere else is removed.  Two places with equal
strings are brought together by a gram that both must choose: of the 96-byte grams inside a string of ``length``
bytes the one with the least hash (the first of equals) is its anchor.  Neighbouring strings with one anchor are one piece,
so a text gives a piece per 150 bytes or so, of which at first only hashes are shuffled.

* Texts that occur several times are covered as a whole and take part once.
* A piece that occurs in several places is covered as a whole.
* Where different pieces have one anchor, they are gathered, each once, and their Burrows-Wheeler transform tells which
  strings in them occur twice (``bwt``): intervals are expanded breadth first, common prefixes come in increasing
  order, and the expansion stops at ``length``.

Pieces of one anchor need not be bounded (a text with single changes in very many copies).  An anchor with more than
``CROWDED`` pieces is divided: its pieces are cut again by a second anchor (least of another hash), which equal strings
share as well, and pieces that thus become equal are merged before they are gathered.  Of second anchors that are still
crowded nothing is gathered: the hashes of all their strings are counted, so that no group of pieces meets in a task.

Shorter passages, counted in words, can be reported beside what is removed (``words``): a text shares a passage if a run of
so many words stands in another row's text too.  Least hashes of a third as many words are the anchors here.  Texts with
an anchor whose pieces are all equal share one; where that does not tell, the hashes of the anchor's runs are counted.

Cases: null text has no bytes; texts below ``length`` bytes are never changed; rows that repeat are separate documents, so
their texts repeat; rows may share an id or have none (of copies with one id all bodies are read); overlaps count, and all
strings are judged on the input; an empty table gives an empty result; other columns are kept by :func:`cleaned`.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm import words as w
from barloom.llm.bwt import repeated
from barloom.llm.types import BINARY, INT, LONG, STRING, many, row
from barloom.session import stored

LENGTH = 400
#: words of a passage that is reported, removed or not
PASSAGE = 51
GRAM = 96
CROWDED = 2000
#: bytes of pieces whose transform is built at once (one anchor is never split over blocks)
BLOCK = 500_000
_CHUNK = 1 << 20
PIECES = many(row(start=LONG, n=INT, anchor=LONG, hash=LONG))
_PIECE = pa.struct([("start", pa.int64()), ("n", pa.int32()), ("anchor", pa.int64()), ("hash", pa.int64())])
_LOW = np.uint64(_CHUNK - 1)


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """Minima of all windows of ``width`` keys, from running minima of blocks."""
    n = len(keys) - width + 1
    pad = -len(keys) % width
    full = np.concatenate([keys, np.full(pad, np.uint64(0xFFFFFFFFFFFFFFFF))]).reshape(-1, width)
    ahead = np.minimum.accumulate(full, 1).ravel()
    back = np.minimum.accumulate(full[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def pieces(text: bytes, length: int = LENGTH, turn: int = 0) -> list[tuple[int, int, int, int]]:
    """(start, number of strings, anchor hash, content hash) of the pieces of a text; ``turn`` picks the hash."""
    out: list[tuple[int, int, int, int]] = []
    gram = min(GRAM, max(1, length // 4))
    data = np.frombuffer(text, np.uint8)
    for first in range(0, max(0, len(data) - length + 1), _CHUNK - length):
        own = data[first : first + _CHUNK - 1]
        if len(own) < length:
            break
        powers, inverses = w._tables(len(own) + 1)
        sums = np.zeros(len(own) + 1, np.uint64)
        np.cumsum((own.astype(np.uint64) + np.uint64(1)) * powers[: len(own)], out=sums[1:])
        hashes = w.mix(((sums[gram:] - sums[:-gram]) * inverses[: len(sums) - gram]) ^ np.uint64(turn * 0x9E37))
        # the place in the low bits makes the first of equal hashes the least
        keys = (hashes & ~_LOW) | np.arange(len(hashes), dtype=np.uint64)
        least = _least(keys, length - gram + 1)
        begin = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        number = np.diff(np.concatenate([begin, [len(least)]]))
        end = begin + number - 1 + length
        content = w.mix((sums[end] - sums[begin]) * inverses[begin] + number.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        anchor = hashes[(least[begin] & _LOW).astype(np.int64)]
        out += zip((begin + first).tolist(), number.tolist(), anchor.view(np.int64).tolist(), content.view(np.int64).tolist())
    return out


def _runs(data: np.ndarray, at: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every run of ``words`` words inside a text: the text's number, the run's anchor, its hash, and the hash of all
    words of its piece (the neighbouring runs with the same anchor)."""
    starts, ends, first = w.cut(data, at)
    n = len(starts)
    if n < words:
        return (np.zeros(0, np.int64),) * 4
    powers, inverses = w._tables(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(w.word_hashes(data, starts, ends) * powers[:n], out=sums[1:])
    gram = (words + 2) // 3
    anchor = _least(w.mix((sums[gram:] - sums[:-gram]) * inverses[: n - gram + 1]), words - gram + 1)
    text = np.repeat(np.arange(len(at) - 1), np.diff(first))
    start = np.flatnonzero(text[: n - words + 1] == text[words - 1 :])
    text, anchor = text[start], anchor[start]
    string = w.mix((sums[start + words] - sums[start]) * inverses[start])
    begin = np.flatnonzero(_new(text, anchor))
    number = np.diff(np.concatenate([begin, [len(start)]]))
    a, b = start[begin], start[begin + number - 1] + words
    piece = w.mix((sums[b] - sums[a]) * inverses[a] + number.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return text, anchor.view(np.int64), string.view(np.int64), np.repeat(piece.view(np.int64), number)


def _new(*columns: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _lists(counts: list[np.ndarray], values: pa.Array) -> pa.Array:
    ends = np.cumsum(np.concatenate([np.zeros(1, np.int64), *counts]))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def _joined(values: list[np.ndarray]) -> pa.Array:
    return pa.array(np.concatenate([np.zeros(0, np.int64), *values]))


def _anchors(words: int):
    """The (anchor, content hash) of each text's pieces."""

    @F.arrow_udf(many(row(gram=LONG, piece=LONG)))
    def anchors(texts: pa.Array) -> pa.Array:
        counts, grams, contents = [], [], []
        for first, end, data, at in w.texts(texts):
            text, anchor, _, piece = _runs(data, at, words)
            new = _new(text, anchor)
            counts.append(np.bincount(text[new], minlength=end - first))
            grams.append(anchor[new])
            contents.append(piece[new])
        return _lists(counts, pa.StructArray.from_arrays([_joined(grams), _joined(contents)], ["gram", "piece"]))

    return anchors


def _hashed(words: int):
    """The different hashes of the runs of each text whose anchor is one of those given with it.  Whether an anchor is asked
    for does not depend on the text, so the anchors of several texts are looked up together."""

    @F.arrow_udf(many(LONG))
    def hashed(texts: pa.Array, wanted: pa.Array) -> pa.Array:
        counts, values = [], []
        for first, end, data, at in w.texts(texts.cast(pa.large_string())):
            text, anchor, string, _ = _runs(data, at, words)
            own = np.isin(anchor, wanted.slice(first, end - first).flatten().to_numpy(zero_copy_only=False))
            text, string = text[own], string[own]
            order = np.lexsort((string, text))
            text, string = text[order], string[order]
            new = _new(text, string)
            counts.append(np.bincount(text[new], minlength=end - first))
            values.append(string[new])
        return _lists(counts, _joined(values))

    return hashed


def _profile(length: int):
    @F.arrow_udf(row(key=BINARY, n_bytes=LONG, sha=STRING, pieces=PIECES))
    def profile(texts: pa.Array) -> pa.Array:
        keys, sizes, shas, found, ends = [], [], [], [], [0]
        for value in texts.cast(pa.large_binary()):
            text = value.as_py() or b""
            keys.append(hashlib.md5(text).digest())
            sizes.append(len(text))
            shas.append(hashlib.sha256(text).hexdigest())
            found += pieces(text, length)
            ends.append(len(found))
        parts = [pa.array(x, f.type) for x, f in zip(zip(*found) if found else ((),) * 4, _PIECE)]
        found = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(parts, fields=list(_PIECE)))
        return pa.StructArray.from_arrays([pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(shas, pa.string()), found], ["key", "n_bytes", "sha", "pieces"])

    return profile


@F.arrow_udf(many(BINARY))
def _cut(texts: pa.Array, wanted: pa.Array) -> pa.Array:
    """The bytes (start, size) of each text that are wanted."""
    out = []
    for value, places in zip(texts.cast(pa.large_binary()), wanted):
        text = value.as_py()
        out.append([text[p["start"] : p["start"] + p["size"]] for p in places.as_py()])
    return pa.array(out, pa.list_(pa.binary()))


def _divide(length: int):
    """Pieces cut again by a second anchor; (start, n) count from the text as before."""

    def divide(batches):
        for batch in batches:
            rows = []
            for key, start, anchor, body in zip(*(batch.column(c).to_pylist() for c in ("key", "start", "anchor", "body"))):
                for at, n, second, content in pieces(body, length, turn=1):
                    mixed = int(w.mix(np.array([anchor], np.int64).view(np.uint64) * np.uint64(3) + np.array([second], np.int64).view(np.uint64)).view(np.int64)[0])
                    rows.append((key, start + at, n, mixed, content, body[at : at + n - 1 + length]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], ["key", "start", "n", "anchor", "hash", "body"])

    return divide


def _strings(length: int):
    """The hash of every string of ``length`` bytes of the pieces, with its place in the text."""

    def strings(batches):
        for batch in batches:
            for key, start, anchor, body in zip(*(batch.column(c).to_pylist() for c in ("key", "start", "anchor", "body"))):
                data = np.frombuffer(body, np.uint8)
                powers, inverses = w._tables(len(data) + 1)
                sums = np.zeros(len(data) + 1, np.uint64)
                np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=sums[1:])
                hashes = w.mix((sums[length:] - sums[:-length]) * inverses[: len(sums) - length]).view(np.int64)
                n = len(hashes)
                yield pa.RecordBatch.from_arrays([pa.array([key] * n, pa.binary()), pa.array(np.arange(start, start + n)), pa.array([anchor] * n, pa.int64()), pa.array(hashes)], ["key", "start", "anchor", "string"])

    return strings


def _transform(length: int, block: int):
    """The repeated strings of all pieces of a partition that is sorted by anchor."""

    def of(held):
        rows = []
        for (key, start, _), found in zip(held, repeated([b for _, _, b in held], length)):
            if len(found):
                begin = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1] + 1]))
                last = np.concatenate([begin[1:], [len(found)]]) - 1
                rows += [(key, start + int(a), int(b - a) + 1) for a, b in zip(found[begin], found[last])]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else ((), (), ()), (pa.binary(), pa.int64(), pa.int32()))], ["key", "start", "n"])

    def transform(batches):
        held, size, now = [], 0, None
        for batch in batches:
            for key, start, anchor, body in zip(*(batch.column(c).to_pylist() for c in ("key", "start", "anchor", "body"))):
                if anchor != now and size >= block:
                    yield of(held)
                    held, size = [], 0
                now = anchor
                held.append((key, start, body))
                size += len(body)
        if held:
            yield of(held)

    return transform


@F.arrow_udf(row(body=BINARY, n_removed=LONG, n_spans=LONG, sha=STRING))
def _without(texts: pa.Array, covered: pa.Array, length: pa.Array) -> pa.Array:
    """The texts without the bytes that strings (start, number of starts) cover."""
    kept, removed, spans, shas = [], [], [], []
    for value, places, size in zip(texts.cast(pa.large_binary()), covered, length):
        text, size = value.as_py(), size.as_py()
        edges = np.zeros(len(text) + 1, np.int64)
        for p in places.as_py():
            edges[p["start"]] += 1
            edges[p["start"] + p["n"] - 1 + size] -= 1
        gone = np.cumsum(edges[:-1]) > 0
        rest = np.frombuffer(text, np.uint8)[~gone].tobytes()
        kept.append(rest)
        removed.append(int(gone.sum()))
        spans.append(int((gone[1:] & ~gone[:-1]).sum() + gone[0]))
        shas.append(hashlib.sha256(rest).hexdigest())
    return pa.StructArray.from_arrays([pa.array(kept, pa.binary()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(shas)], ["body", "n_removed", "n_spans", "sha"])


def _content(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def _in_several(table: DataFrame, what: str, *more: Column) -> DataFrame:
    """The values of ``what`` that different texts (``_of``) have."""
    return table.groupBy(what).agg(F.min("_of").alias("_a"), F.max("_of").alias("_b"), *more).where("_a != _b").drop("_a", "_b")


def _anchored(rows: DataFrame) -> DataFrame:
    """The anchors that texts (``_of``) share, and whether there is one piece of the anchor (``one``).  Texts that have such a
    piece share a passage.  The others must be compared: ``asked`` are the anchors of different pieces that one of them has."""
    held = rows.groupBy("key").agg(F.first("grams").alias("grams")).select(F.xxhash64("key").alias("_of"), F.inline("grams"))
    both = _in_several(held, "gram", (F.min("piece") == F.max("piece")).alias("one"))
    shared = stored(held.join(both, "gram").groupBy("_of").agg(F.max("one").alias("shares"), F.collect_set(F.when(~F.col("one"), F.col("gram"))).alias("grams")), "bwt-shared")
    asked = shared.where("not shares").select(F.explode("grams").alias("gram")).distinct()
    asked = shared.select("_of", F.explode("grams").alias("gram")).join(asked, "gram").groupBy("_of").agg(F.collect_list("gram").alias("_asked"))
    return stored(shared.select("_of", "shares").join(asked, "_of", "left"), "bwt-asked")


def cleaned(docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text", crowded: int = CROWDED, block: int = BLOCK, words: int = 0) -> tuple[DataFrame, DataFrame]:
    """Two tables.  The first has ``doc_id``, ``key`` (of the text), ``n_bytes``, ``n_removed``, ``n_spans`` and
    ``sha`` (of what is kept) per row, and with ``words`` also ``shares_passage`` (another row's text has a run of so many
    words of it); the second has ``key`` and the kept bytes ``body`` of the texts that are changed in part."""
    grams = _anchors(words)(_content(text)) if words else F.array()
    rows = stored(docs.select(F.col(doc_id).alias("doc_id"), _profile(length)(_content(text)).alias("_p"), grams.alias("grams")).select("doc_id", "_p.*", "grams"), "bwt-pieces")
    copies = rows.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("_first"))
    places = rows.select("key", F.explode("pieces").alias("p")).select("key", F.col("p.start").alias("start"), F.col("p.n").alias("n"), F.col("p.anchor").alias("anchor"), F.col("p.hash").alias("hash")).distinct()
    kinds = stored(places.groupBy("anchor", "hash", "n").agg(F.count(F.lit(1)).alias("_times"), F.min(F.struct("key", "start")).alias("_at")), "bwt-kinds")
    shared = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("_kinds")).where("_kinds > 1")
    # one place of each piece whose anchor other pieces have
    gathered = kinds.join(shared, "anchor").select("anchor", "hash", "n", F.col("_at.key").alias("key"), F.col("_at.start").alias("start"), (F.col("_kinds") > crowded).alias("crowded"), (F.col("_times") > 1).alias("_whole"))
    gathered = stored(gathered, "bwt-gathered")
    whole = stored(places.join(kinds.where("_times > 1").select("anchor", "hash", "n"), ["anchor", "hash", "n"]).select("key", "start", "n"), "bwt-whole")

    # the texts that anything is taken from or removed from, each from its row of the least id
    needed = gathered.select("key").unionByName(whole.select("key"))
    if words:
        anchored = _anchored(rows)
        asked = anchored.where("_asked is not null").select("_of", "_asked")
        needed = needed.unionByName(copies.select("key", F.xxhash64("key").alias("_of")).join(asked, "_of", "left_semi").select("key"))
    needed = needed.distinct().join(copies, "key")
    content = _content(text).cast("binary")
    bodies = docs.select(F.col(doc_id).alias("_id"), F.unhex(F.md5(content)).alias("key"), content.alias("body")).alias("d")
    one = (F.col("d.key") == F.col("n.key")) & F.col("d._id").eqNullSafe(F.col("n._first"))
    bodies = stored(bodies.join(needed.alias("n"), one).select("d.key", "d.body", "n.copies"), "bwt-texts")
    wanted = gathered.groupBy("key").agg(F.collect_list(F.struct("start", (F.col("n") - 1 + length).cast("long").alias("size"), "n", "anchor", "hash", "crowded")).alias("_w"))
    cut = bodies.join(wanted, "key").withColumn("_b", _cut("body", "_w")).select("key", F.explode(F.arrays_zip("_w", "_b")).alias("x"))
    cut = cut.select("key", F.col("x._w.start").alias("start"), F.col("x._w.n").alias("n"), F.col("x._w.anchor").alias("anchor"), F.col("x._w.hash").alias("hash"), F.col("x._w.crowded").alias("crowded"), F.col("x._b").alias("body"))
    schema = "key binary, start long, n int, anchor long, hash long, body binary"
    plain = cut.where("not crowded").drop("crowded")
    found = plain.repartition("anchor").sortWithinPartitions("anchor").select("key", "start", "anchor", "body").mapInArrow(_transform(length, block), "key binary, start long, n int")
    covered = whole.unionByName(found)
    if not gathered.where("crowded").isEmpty():
        again = stored(cut.where("crowded").drop("crowded").select(*[x.split()[0] for x in schema.split(", ")]).mapInArrow(_divide(length), schema), "bwt-divided")
        small = again.groupBy("anchor", "hash", "n").agg(F.count(F.lit(1)).alias("_times"), F.min(F.struct("key", "start", "body")).alias("_at"))
        small = stored(small, "bwt-divided-kinds")
        kinds_of = small.groupBy("anchor").agg(F.count(F.lit(1)).alias("_kinds"))
        sized = small.join(kinds_of, "anchor").select("anchor", "_at.*", "_kinds")
        merged = sized.where(F.col("_kinds").between(2, crowded))
        strings = stored(sized.where(F.col("_kinds") > crowded).select("key", "start", "anchor", "body").mapInArrow(_strings(length), "key binary, start long, anchor long, string long"), "bwt-strings")
        equal = strings.groupBy("anchor", "string").agg(F.count(F.lit(1)).alias("_times")).where("_times > 1").drop("_times")
        counted = strings.join(equal, ["anchor", "string"]).select("key", "start", F.lit(1).alias("n"))
        twice = again.join(small.where("_times > 1").select("anchor", "hash", "n"), ["anchor", "hash", "n"]).select("key", "start", "n")
        parts = merged.repartition("anchor").sortWithinPartitions("anchor").select("key", "start", "anchor", "body").mapInArrow(_transform(length, block), "key binary, start long, n int")
        covered = covered.unionByName(twice).unionByName(parts).unionByName(counted)
    by_text = covered.groupBy("key").agg(F.collect_list(F.struct("start", "n")).alias("_c"))
    # copies are removed as a whole
    changed = stored(bodies.where("copies = 1").join(by_text, "key").select("key", _without("body", "_c", F.lit(length)).alias("_x")).select("key", "_x.*"), "bwt-changed")
    entire = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    none = F.sha2(F.lit("").cast("binary"), 256)
    result = rows.select("doc_id", "key", "n_bytes", F.col("sha").alias("_own"), (F.size("grams") > 0).alias("_long")).join(copies.drop("_first"), "key").join(changed.drop("body"), "key", "left")
    verdict = []
    if words:
        runs = bodies.withColumn("_of", F.xxhash64("key")).join(asked, "_of").select("_of", F.explode(_hashed(words)("body", "_asked")).alias("string"))
        runs = stored(runs, "bwt-runs")
        sharing = runs.join(_in_several(runs, "string"), "string").select("_of").unionByName(anchored.where("shares").select("_of")).distinct()
        result = result.withColumn("_of", F.xxhash64("key")).join(sharing.withColumn("_shares", F.lit(True)), "_of", "left")
        verdict = [(F.coalesce("_shares", F.lit(False)) | ((F.col("copies") > 1) & F.col("_long"))).alias("shares_passage")]
    result = result.select(
        "doc_id",
        "key",
        "n_bytes",
        F.when(entire, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(entire, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", F.lit(0))).alias("n_spans"),
        F.when(entire, none).otherwise(F.coalesce("sha", "_own")).alias("sha"),
        *verdict,
    )
    return result, changed.select("key", "body")


def deduplicated(docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the repeated bytes taken out of ``text`` (bytes that no longer form a character are replaced)."""
    result, bodies = cleaned(docs, length, doc_id, text)
    state = result.select("key", (F.col("n_removed") > 0).alias("_changed"), (F.col("n_removed") == F.col("n_bytes")).alias("_gone")).dropDuplicates(["key"])
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = docs.select(whole, F.unhex(F.md5(_content(text).cast("binary"))).alias("key")).join(state, "key").join(bodies, "key", "left")
    own = F.col(f"_row.`{text}`")
    new = F.when(~F.col("_changed"), own).when(F.col("_gone"), F.lit("")).otherwise(F.make_valid_utf8(F.col("body").cast("string")))
    return rows.select(*[(new if c == text else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])
