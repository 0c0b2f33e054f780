"""Line dedup by winnowing over line hashes.

The lines of a text that hold a word are a sequence of hashes.  From every window of ``WIDTH`` lines the one with the
smallest hash (the last of equals) is selected as a fingerprint, so two equal windows select the same line: any
run of ``WIDTH`` repeated lines is sure to share a fingerprint.  Fingerprints that occur once in the corpus are
dropped.  Around the others the match is extended both ways: every window that holds the fingerprint is compared, by
its hash, with the first place in the corpus where it occurs.  Windows that occur earlier are repeated; the union of
their lines, which grows over neighbouring fingerprints into whole runs, is deleted.  Positions meet at their
first occurrence and not in pairs, so a line in a third of all texts costs one row per occurrence.

A text of fewer lines is one window.  A run of fewer lines with ``LONG_LINE`` or more words is a window as well, if it
has fewer without its first or its last line: these cover every repeated run of so many words, however it is cut into
lines and however many lines its text has.  Shorter runs of one or two lines are compared only as whole texts.
Places are ordered by (document id, line); the earliest one stays.

Cases: null text has no lines; lines without a word are no part of a run and stay; rows that repeat (same id and
text) are told apart by their place in the stored table, and the later is deleted; a null id comes last; an empty table gives an
empty result; other columns are kept by :func:`deduplicated`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm import words as w
from barloom.llm.types import INT, LONG, STRING, many, row
from barloom.session import stored

WIDTH = 3
LONG_LINE = 50
_NEWLINE = np.zeros(256, bool)
_NEWLINE[0x0A] = True
MARKS = many(row(line=INT, finger=LONG, windows=many(row(start=INT, n=INT, hash=LONG))))


def _lines(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and word counts of the lines with a word; number of the first one of each text."""
    starts, ends, _ = w.cut(data, at, _NEWLINE)
    words, _, _ = w.cut(data, at)
    n = np.searchsorted(words, ends) - np.searchsorted(words, starts)
    starts, ends, n = starts[n > 0], ends[n > 0], n[n > 0]
    return starts, ends, n, np.searchsorted(starts, at)


def fingerprints(hashes: np.ndarray, n_words: np.ndarray, width: int = WIDTH, long: int = LONG_LINE) -> list[dict]:
    """The fingerprints of one text, each with all windows that hold it."""
    n = len(hashes)
    if not n:
        return []
    size = min(width, n)
    out: dict[int, dict] = {}
    words = np.concatenate([[0], np.cumsum(n_words)])
    acc = np.zeros(n, np.uint64)
    for k in range(1, size + 1):
        starts = np.arange(n - k + 1)
        acc = hashes[: n - k + 1].copy() if k == 1 else acc[: n - k + 1] * np.uint64(0xD6E8FEB86659FD93) + hashes[k - 1 :]
        if k < size:
            # enough words, but no longer so without the first line or without the last one
            inner = np.minimum(words[k:] - words[1 : n - k + 2], words[k - 1 : n] - words[: n - k + 1])
            starts = np.flatnonzero((words[k:] - words[: n - k + 1] >= long) & (inner < long))
        if not len(starts):
            continue
        spans = np.lib.stride_tricks.sliding_window_view(hashes, k)[starts]
        # the last of equal minima
        at = k - 1 - np.argmin(spans[:, ::-1], 1) + starts
        own = w.mix(acc[starts] + np.uint64(k)).astype(np.int64)
        for start, line, h in zip(starts.tolist(), at.tolist(), own.tolist()):
            mark = out.setdefault(line, {"line": line, "finger": int(hashes[line].astype(np.int64)), "windows": []})
            mark["windows"].append({"start": start, "n": k, "hash": h})
    return list(out.values())


@F.arrow_udf(MARKS)
def marks(texts: pa.Array) -> pa.Array:
    """The fingerprints of each text."""
    out: list[list[dict]] = []
    for first, end, data, at in w.texts(texts):
        starts, ends, n_words, first_line = _lines(data, at)
        hashes = w.word_hashes(data, starts, ends)
        out += [fingerprints(hashes[a:b], n_words[a:b]) for a, b in zip(first_line[:-1], first_line[1:])]
    window = pa.struct([("start", pa.int32()), ("n", pa.int32()), ("hash", pa.int64())])
    return pa.array(out, pa.list_(pa.struct([("line", pa.int32()), ("finger", pa.int64()), ("windows", pa.list_(window))])))


@F.arrow_udf(row(text=STRING, n_lines=INT, n_removed=INT, n_runs=INT))
def _without(texts: pa.Array, repeated: pa.Array) -> pa.Array:
    """The texts without the lines that the windows (start, n) cover."""
    kept, lines, removed, runs = [], [], [], []
    for value, windows in zip(texts, repeated):
        text = value.as_py()
        parts = (text or "").split("\n")
        own = [i for i, x in enumerate(parts) if x.strip(" \t\n\r\x0b\x0c")]
        drop = np.zeros(len(own) + 1, bool)
        for x in windows.as_py() or ():
            drop[x["start"] : x["start"] + x["n"]] = True
        gone = {own[i] for i in np.flatnonzero(drop).tolist()}
        kept.append(None if text is None else "\n".join(x for i, x in enumerate(parts) if i not in gone))
        lines.append(len(own))
        removed.append(len(gone))
        runs.append(int((drop[1:] & ~drop[:-1]).sum() + drop[0]))
    return pa.StructArray.from_arrays([pa.array(kept, pa.string()), *[pa.array(x, pa.int32()) for x in (lines, removed, runs)]], ["text", "n_lines", "n_removed", "n_runs"])


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", result: str = "_lines") -> DataFrame:
    """``docs`` with a struct ``result``: the text without later repeated runs, lines, removed lines and runs."""
    # the stored table gives every row a place that does not change when a task is run again
    columns = [F.col(f"`{c}`") for c in docs.columns if c != result]
    rows = stored(docs.select(F.struct(*columns).alias("_all"), F.col(doc_id).alias("_doc"), marks(F.col(text)).alias("_marks")), "line-marks")
    rows = rows.withColumn("_row", F.concat("_metadata.file_name", F.lit(":"), "_metadata.row_index"))
    found = rows.select("_doc", "_row", F.explode("_marks").alias("_m")).select("_doc", "_row", F.col("_m.finger").alias("_finger"), F.col("_m.windows").alias("_windows"))
    repeated = found.groupBy("_finger").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_finger")
    windows = found.join(repeated, "_finger").select("_doc", "_row", F.explode("_windows").alias("_w")).select("_doc", "_row", F.col("_w.start").alias("start"), F.col("_w.n").alias("n"), F.col("_w.hash").alias("hash"))
    place = F.struct(F.col("_doc").isNull().alias("last"), F.col("_doc"), F.col("_row"), F.col("start"))
    first = windows.groupBy("hash").agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    later = windows.join(first, "hash").where(place > F.col("_first"))
    covered = later.groupBy("_row").agg(F.collect_list(F.struct("start", "n")).alias("_cover"))
    return rows.join(covered, "_row", "left").select("_all.*", _without(F.col(f"_all.`{text}`"), F.col("_cover")).alias(result))
