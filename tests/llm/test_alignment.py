"""Token alignment, phrase fingerprints and the filter audit beside brute force, on odd rows, nothing, and long texts."""

import bisect
import collections
import hashlib
import itertools
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import filter_audit as fa
from barloom.llm import lz_prints as lz
from barloom.llm import near_dedup, pii, secrets
from barloom.llm import token_alignment as ta
from barloom.llm.oracles import OP13

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def tokens():
    return ta.Tokenizers(*ta._read(ta.FILE_A, ta.FILE_B))


# -- alignment ------------------------------------------------------------------------------------------------------


def ends(ids, sizes):
    return dict(zip(itertools.accumulate(int(sizes[i]) for i in ids), ids))


def brute_groups(t, text):
    """Groups of (ids of A, ids of B) between all offsets where both end, from sets of offsets."""
    a, b = t.encoded(text or "")
    at_a, at_b = ends(a, t.size_a), ends(b, t.size_b)
    cuts = sorted(set(at_a) & set(at_b))
    of = lambda at: [list(ids) for _, ids in itertools.groupby(at, lambda e: bisect.bisect_left(cuts, e))]
    return [([at_a[e] for e in x], [at_b[e] for e in y]) for x, y in zip(of(at_a), of(at_b))]


def brute_links(t, rows):
    groups = [(key, brute_groups(t, text)) for key, text in rows]
    counts = collections.Counter((a[-1], b[-1]) for _, of in groups for a, b in of)
    best = collections.defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = []
    for key, of in groups:
        links = [(a[-1], b[-1]) for a, b in of]
        listed = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in of)
        sha = hashlib.sha256(listed.encode()).hexdigest() if of else ""
        out.append((key, sum(len(a) for a, _ in of), sum(len(b) for _, b in of), len(of), len(of), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), sha))
    return out


def test_vocabulary_file_gives_the_tokenizer_s_own_ids(tokens):
    tokenizers = pytest.importorskip("tokenizers")
    own = tokenizers.Tokenizer.from_file(ta.FILE_A)
    own.encode_special_tokens = True
    texts = [" " + "".join(map(chr, range(c, c + 64))) + f" x{chr(c)}y" for c in range(1, 0xD000, 64)]
    texts += [" it's <|endoftext|> we'LL 12a\n\n  b", " " + "😀é漢" * 50, " " * 300, " a" + "\n" * 200 + "b"]
    assert [tokens.a.encode_ordinary(x) for x in texts] == [x.ids for x in own.encode_batch(texts, add_special_tokens=False)]


def test_alignment_of_odd_texts(tokens):
    texts = [None, "", "x", "a▁b", "é😀" * 30, "x" * 300, "  two  blanks ", "\x00\t\n", "漢字テスト" * 20, "<s></s><unk><|endoftext|>", "the quick brown fox " * 20]
    x = ta.align(tokens, texts)
    want = [";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in brute_groups(tokens, t)) for t in texts]
    assert ta.written(tokens, x) == want
    assert want[3] == "" and want[9] != ""


def test_cuts_equal_common_ends():
    rng = np.random.default_rng(4)
    for share in (0.02, 0.3, 0.95):
        a, b, first, base = [], [], [0], 0
        for _ in range(30):
            n = int(rng.integers(0, 400))
            if n:
                one, other = np.flatnonzero(rng.random(n) < share) + 1, np.flatnonzero(rng.random(n) < share) + 1
                a += [base + x for x in sorted({*one.tolist(), n})]
                b += [base + x for x in sorted({*other.tolist(), n})]
            base += n
            first.append(len(a))
        a, b = np.array(a), np.array(b)
        assert ta.shared_cuts(a, b, np.array(first)).tolist() == np.flatnonzero(np.isin(a, b)).tolist()


@pytest.mark.parametrize("table", ["odd", "small"])
def test_link_counts_beside_brute_force(request, monkeypatch, tokens, table):
    monkeypatch.setattr(ta, "BLOCK", 40_000)
    docs = request.getfixturevalue(table)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = [tuple(r) for r in ta.link_counts(docs).collect()]
    order = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(got, key=order) == sorted(brute_links(tokens, rows), key=order)


def test_alignment_of_nothing(nothing):
    assert ta.link_counts(nothing).count() == 0
    assert ta.aligned(nothing).count() == 0


def test_aligned_keeps_columns_and_rebuilds_the_text(odd, tokens):
    rows = ta.aligned(odd.withColumn("_groups", F.lit("own"))).collect()
    assert len(rows) == odd.count() and set(odd.columns) < set(rows[0].asDict())
    for r in rows:
        raw = b"".join(tokens.bytes_a[i] for g in r["_groups"] for i in g["a"])
        assert raw == b"".join(tokens.bytes_b[i] for g in r["_groups"] for i in g["b"])
        assert raw in (b"", (" " + (r["text"] or "")).encode())


def test_alignment_of_a_long_text_ends(tokens):
    start = time.time()
    x = ta.align(tokens, ["x" * 500_000 + "é" * 100_000 + " word" * 50_000])
    assert len(x.last_a) > 50_000 and time.time() - start < 30


# -- fingerprints ---------------------------------------------------------------------------------------------------


def brute_phrases(text):
    seen, at = set(), 0
    for i in range(1, len(text) + 1):
        if text[at:i] not in seen:
            seen.add(text[at:i])
            at = i
    return seen


def brute_print(text):
    mask = (1 << 64) - 1

    def spread(h):
        h ^= h >> 30
        h = h * 0xBF58476D1CE4E5B9 & mask
        h ^= h >> 27
        h = h * 0x94D049BB133111EB & mask
        return h ^ h >> 31

    return sorted({spread(zlib.crc32(p.encode()) + 1) >> 32 for p in brute_phrases(text)})[: lz.SIZE]


def brute_likeness(a, b):
    if not a or not b:
        return float(a == b)
    both = sorted({*a, *b})[: lz.SIZE]
    return sum(x in a and x in b for x in both) / len(both)


@pytest.mark.parametrize("ranges", [1, 7])
@pytest.mark.parametrize("table", ["odd", "small"])
def test_prints_beside_brute_force(request, table, ranges):
    docs = request.getfixturevalue(table)
    got = collections.defaultdict(list)
    for r in lz.prints(docs, ranges=ranges).collect():
        got[r["doc_id"]].append(r)
    hashes = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()
    rows = sorted(hashes, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["h"]), reverse=True)
    assert sum(map(len, got.values())) == len(rows)
    texts = [r["text"] for r in rows]
    for r, text, after in zip(rows, texts, [*texts[1:], texts[0]]):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        prints = [brute_print(x) for x in (text, edited, after)]
        want = (len(text), hashlib.sha256(edited.encode()).hexdigest(), "".join(f"{x:08x}" for x in prints[0]), "".join(f"{x:08x}" for x in prints[1]), brute_likeness(prints[0], prints[1]), brute_likeness(prints[0], prints[2]))
        assert want in [tuple(x)[1:] for x in got[r["doc_id"]]]


def test_prints_of_nothing_and_of_one(spark, nothing):
    assert lz.prints(nothing).count() == 0
    assert lz.prints(nothing).columns[0] == "doc_id"
    one = lz.prints(spark.createDataFrame([(5, "abab")], "doc_id long, text string")).collect()
    assert [(r["doc_id"], r["n_chars"], r["near_edited"], r["near_next"]) for r in one] == [(5, 4, 1.0, 1.0)]


def test_likeness_follows_the_share_of_common_text(spark):
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdefghij"), rng.integers(3, 9))) for _ in range(2000)]
    say = lambda n: " ".join(rng.choice(words, n))
    base = say(1500)
    shares = []
    for share in (1.0, 0.9, 0.5, 0.1):
        cut = int(len(base) * share)
        shares.append(lz.likeness(lz.own_print(base), lz.own_print(base[:cut] + say(1500)[: len(base) - cut])))
    assert shares[0] == 1.0 and shares == sorted(shares, reverse=True) and shares[1] > shares[3] + 0.2


# -- filter audit ---------------------------------------------------------------------------------------------------


def brute_masks(rows):
    """Failed filters of each row (doc_id, text)."""
    least = {}
    for i, text in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    out = []
    for i, text in rows:
        text = text or ""
        w = WORD.findall(text)
        mask = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), bool(re.search("[#$%&*|]", text)), i is not None and i > least[text]]
        out.append("".join(x for x, m in zip("ABCDE", mask) if m))
    return out


def brute_audit(rows, good, toxic):
    """(part, order, step) to the counts, by walking every row through every order."""
    masks = brute_masks([(r["doc_id"], r["text"]) for r in rows])
    parts = [r["source"] or "" for r in rows]
    out = {}
    orders = ["".join(o) for o in itertools.permutations("ABCDE")]
    for part in set(parts):
        own = [(m, r["doc_id"] in good, r["doc_id"] in toxic) for m, p, r in zip(masks, parts, rows) if p == part]
        shapley = collections.Counter(next((x for x in o if x in m), "") for o in orders for m, _, _ in own)
        for o in orders:
            for step, letter in enumerate(o, 1):
                here = [(m, g, t) for m, g, t in own if letter in m and not set(o[: step - 1]) & set(m)]
                kept = sum(not set(o[:step]) & set(m) for m, _, _ in own)
                redundant = sum(letter in m for m, _, _ in own) - len(here)
                out[part, o, step] = (kept, len(here), redundant, sum(m == letter for m, _, _ in own), sum(g for _, g, _ in here), sum(t for _, _, t in here), shapley[letter])
    return out


COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


@pytest.mark.parametrize("table,batches", [("odd", 1), ("odd", 5), ("small", 3)])
def test_audit_beside_brute_force(request, spark, tmp_path, monkeypatch, table, batches):
    monkeypatch.setattr(fa, "TEXTS_PER_KEY", 4)
    docs = request.getfixturevalue(table)
    path = str(tmp_path / "documents.parquet")
    # descending ids: every batch holds smaller ids than the ones before, so earlier masks are retracted
    rows = sorted(docs.collect(), key=lambda r: -(r["doc_id"] if r["doc_id"] is not None else -1))
    size = -(-len(rows) // 5)
    for i in range(0, len(rows), size):
        spark.createDataFrame(rows[i : i + size], docs.schema).coalesce(1).write.mode("append").parquet(path)
    labels = spark.createDataFrame([(0, 1, 0), (3, 1, 1), (3, 0, 0), (12, 0, 1), (9_999, 1, 1), (None, 1, 1), (14, None, None)], "doc_id long, quality int, toxic int")
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in COUNTS) for r in fa.audit(fa.counters(spark, path, labels, batches)).collect()}
    assert got == brute_audit(rows, {0, 3}, {3, 12})


def test_audit_of_nothing(spark, tmp_path, nothing):
    nothing.write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert fa.audit(fa.counters(spark, str(tmp_path / "documents.parquet"), labels)).count() == 0


def test_a_retried_batch_counts_once(spark):
    import pandas as pd

    class State:
        exists, value = False, None

        def update(self, value):
            self.exists, self.value = True, value

        @property
        def get(self):
            return self.value

    def rows(*ids):
        return pd.DataFrame({"key": ["t"] * len(ids), "id": ids, "part": "p", "mask": 1, "good": 0, "toxic": 0, "n": 1})

    def counts(state, *ids):
        out = pd.concat(fa._advance((0,), iter([rows(*ids)]), state))
        return dict(zip(out["mask"], out["n"]))

    state = State()
    assert counts(state, 7, 9) == {1: 1, 17: 1}
    before = state.value
    first = counts(state, 3, 8)
    state.update(before)
    assert counts(state, 3, 8) == first == {17: 2}
    assert counts(state, 3) == {1: 1}


def test_audit_sql_is_registered():
    assert "shapley" in OP13


# -- long and odd texts of earlier operators ------------------------------------------------------------------------


def test_pii_of_long_marks(spark):
    texts = ["x@" + "a." * 300_000 + "com", "a." * 500_000, "1 " * 500_000, "Mrs " * 250_000, "mail jo@ex-am.ple.org. Bye"]
    out = {r["doc_id"]: r for r in pii.replaced(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").collect()}
    assert len(out) == len(texts) and "jo@ex-am.ple.org" not in str(out[4])


def test_secret_spans_of_many_matches(spark):
    line = "token=abcdefgh1 "
    n = 20_000
    start = time.time()
    found = {r["doc_id"]: r["spans"] for r in secrets.scan(spark.createDataFrame([(1, line * n), (2, line)], "doc_id long, text string"), secrets.BASE).collect()}
    assert len(found[1]) == n and time.time() - start < 60
    assert [(s["start"], s["end"]) for s in found[1]] == [(i * len(line), i * len(line) + 15) for i in range(n)]
    assert [(s["start"], s["end"]) for s in found[2]] == [(0, 15)]


def test_one_of_each_with_null_ids(spark):
    base = " ".join(f"w{i}" for i in range(120))
    texts = [(None, base), (None, base + " more"), (None, " ".join(f"v{i}" for i in range(50))), (4, base), (5, "")]
    kept = near_dedup.one_of_each(spark.createDataFrame(texts, "doc_id long, text string"), 5, 80).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"][:2]) for r in kept) == [(False, 4, "w0"), (False, 5, ""), (True, 0, "v0")]
