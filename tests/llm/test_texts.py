"""Text operators beside brute force: words, decontamination, quality, byte and line dedup, near-duplicates."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from barloom.llm import bwt_dedup, decontaminate, line_dedup, near_dedup, quality, queries
from barloom.llm import words as w

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_word_cuts_equal_the_pattern():
    texts = ["a b", None, "", " \n", "Ünï\x00 c\x0bd", "z" * 3_000_000 + " y", "tail "]
    found = []
    for _, _, data, at in w.texts(pa.array(texts), 1000):
        starts, ends, first = w.cut(data, at)
        raw = data.tobytes()
        for i in range(len(at) - 1):
            found.append([raw[a:b].decode() for a, b in zip(starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]])])
    assert found == [WORD.findall(t or "") for t in texts]


def test_word_hashes_depend_on_the_word_alone():
    data = np.frombuffer(b"one two one \x00 \x00\x00 two", np.uint8)
    starts, ends, _ = w.cut(data, np.array([0, len(data)]))
    h = w.word_hashes(data, starts, ends)
    assert h[0] == h[2] and h[1] == h[5] and len(set(h.tolist())) == 4


def items(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(text))
    return [tuple(words[i : i + 13]) for i in range(max(1, len(words) - 12))] if words else []


def brute_hits(text, benchmark):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(text))
    hit, of = set(), set()
    for item, content in benchmark:
        for window in items(content):
            for i in range(len(words) - len(window) + 1):
                if tuple(words[i : i + len(window)]) == window:
                    hit.update(range(i, i + len(window)))
                    of.add(str(item))
    return len(words), len(hit), len(of), hashlib.sha256(",".join(sorted(of)).encode()).hexdigest()


def test_decontaminate_odd_rows(spark, odd, nothing):
    bench = [(1, "line b"), (2, None), (3, "..."), (4, odd.where("doc_id = 9").first()["text"][:400]), (5, "two, WORDS"), (5, "one")]
    table = spark.createDataFrame(bench, "item_id long, text string")
    rows = decontaminate.verdicts(decontaminate.scan(odd, table)).collect()
    assert len(rows) == odd.count() and any(r["contaminated"] for r in rows)
    for r in rows:
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) == brute_hits(r["text"], [b for b in bench if b[1]])
    assert decontaminate.verdicts(decontaminate.scan(nothing, table)).count() == 0
    assert decontaminate.verdicts(decontaminate.scan(odd, table.limit(0))).where("contaminated").count() == 0


def test_decontaminate_blocks_and_spans(spark, odd, monkeypatch):
    text = "Über-1, one TWO three! 4 five six seven eight nine ten eleven twelve 13 fourteen."
    docs = spark.createDataFrame([(1, "Lead. " + text + " tail"), (2, "nothing")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, text), (2, "lead Über")], "item_id long, text string")
    r = decontaminate.verdicts(decontaminate.scan(docs, bench)).where("doc_id = 1").first()
    start, end = r["_scan"]["spans"][0]["start"], r["_scan"]["spans"][0]["end"]
    assert r["text"][start:end].startswith("Lead") and r["text"][start:end].endswith("fourteen")
    monkeypatch.setattr(decontaminate.blocks, "__defaults__", ("item_id", "text", 90))
    again = decontaminate.verdicts(decontaminate.scan(docs, bench)).where("doc_id = 1").first()
    assert len(decontaminate.blocks(bench)) > 1
    assert [again[c] for c in ("n_words", "n_hit", "n_items", "items_sha256")] == [r[c] for c in ("n_words", "n_hit", "n_items", "items_sha256")]


def brute_quality(text):
    text = text or ""
    words = WORD.findall(text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    again = {j for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(again)


def distance(p, q):
    p, q = np.array(p, float), np.array(q, float)
    p, q = p / p.sum(), q / q.sum()
    part = lambda a, m: sum(x * math.log2(x / y) for x, y in zip(a, m) if x > 0)
    m = (p + q) / 2
    return math.sqrt(max(0, (part(p, m) + part(q, m)) / 2))


CLASS = [r"[a-z]", r"[A-Z]", r"[^\x00-\x7f]", r"[0-9]", r"[\x20\x09-\x0D]", r"[.,;:!?'\"()-]", r"[#*$%&|<>]"]


def char_counts(text):
    known = [len(re.findall(p, text)) for p in CLASS]
    return [*known, len(text) - sum(known)]


@pytest.mark.parametrize("table", ["odd", "small"])
def test_quality_beside_brute_force(request, table):
    docs = request.getfixturevalue(table)
    rows = quality.judged(docs).collect()
    assert len(rows) == docs.count()
    by_lang = collections.defaultdict(lambda: [np.zeros(8), collections.Counter()])
    for r in rows:
        for lang in {r["lang"], "*"}:
            by_lang[lang][0] += char_counts(r["text"] or "")
            by_lang[lang][1].update(WORD.findall(r["text"] or ""))
    for r in rows:
        q, text = r["_quality"], r["text"] or ""
        assert (q["n_words"], q["word_chars"], q["n_symbols"], q["n_dup_lines"], q["n_repeat_words"]) == brute_quality(text)
        failed = q["n_words"] < 20 or 100 * q["n_repeat_words"] > 30 * q["n_words"]
        lang = r["lang"] if r["lang"] is not None else "*"
        chars, counts = by_lang[lang]
        if len(text) >= quality.LEAST_CHARS:
            assert q["char_distance"] == pytest.approx(distance(char_counts(text), chars), abs=1e-6)
        if q["n_words"] >= quality.LEAST_WORDS:
            top = sorted(counts, key=lambda x: (-counts[x], x.encode()))[: quality.COMMON]
            own = collections.Counter(WORD.findall(text))
            mine = [own[x] for x in top]
            theirs = [counts[x] for x in top]
            assert q["word_distance"] == pytest.approx(distance([*mine, q["n_words"] - sum(mine)], [*theirs, sum(counts.values()) - sum(theirs)]), abs=1e-6)
        assert q["base_failed"] == failed
        assert q["kept"] == (not failed and q["char_distance"] <= quality.MOST_CHAR_DISTANCE and q["word_distance"] <= quality.MOST_WORD_DISTANCE)


def test_quality_of_nothing(nothing):
    assert quality.judged(nothing).count() == 0


def test_quality_keeps_prose_and_rejects_junk(spark, small):
    rows = quality.judged(small).join(spark.read.parquet("/root/testdata/sf0.001/labels.parquet"), "doc_id").select("quality", "_quality.kept", "_quality.base_failed").collect()
    good = [r["kept"] or r["base_failed"] for r in rows if r["quality"] == 1]
    bad = [r["kept"] for r in rows if r["quality"] == 0]
    assert all(good) and sum(bad) <= 0.1 * len(bad)


def brute_bytes(texts, length):
    raw = [(t or "").encode() for t in texts]
    count = collections.Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("table,length,crowded,block", [("odd", 400, 2000, 2_000_000), ("odd", 50, 1, 3000), ("small", 400, 2000, 2_000_000), ("small", 400, 2, 20_000), ("small", 100, 2000, 50_000)])
def test_bytes_beside_brute_force(request, table, length, crowded, block):
    docs = request.getfixturevalue(table)
    texts = [r[0] for r in docs.select("text").collect()]
    result, _ = bwt_dedup.cleaned(docs, length, crowded=crowded, block=block)
    found = sorted((r["n_bytes"], r["n_removed"], r["n_spans"], r["sha"]) for r in result.collect())
    assert found == brute_bytes(texts, length)


@pytest.fixture(scope="session")
def forms(spark):
    """Forms with a number of their own in the middle, every anchor of which stays crowded; copies, some with one id."""
    rng = random.Random(9)
    say = lambda n: " ".join("".join(rng.choice("abcdef") for _ in range(rng.randint(2, 7))) for _ in range(n))
    before, after = say(90), say(110)
    rows = [(i, f"{before} {rng.randrange(10**8)} {after} {rng.randrange(10**6) if i % 3 else ''}") for i in range(60)]
    rows += [(100 + i, rows[7][1]) for i in range(5)] + [(200, rows[8][1]), (200, rows[8][1]), (None, rows[9][1]), (None, rows[9][1]), (None, say(150)), (300, say(200))]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


@pytest.mark.parametrize("length,crowded", [(400, 8), (400, 2000), (120, 3)])
def test_bytes_of_crowded_anchors_and_copies(forms, length, crowded):
    result, bodies = bwt_dedup.cleaned(forms, length, crowded=crowded)
    found = sorted((r["n_bytes"], r["n_removed"], r["n_spans"], r["sha"]) for r in result.collect())
    assert found == brute_bytes([r[0] for r in forms.select("text").collect()], length)
    assert bodies.groupBy("key").count().where("count > 1").isEmpty()


def brute_passages(rows, words):
    """For each row whether another row's text has a run of ``words`` of its words."""
    runs = [{tuple(x[i : i + words]) for i in range(len(x) - words + 1)} for x in (WORD.findall(t or "") for t in rows)]
    count = collections.Counter(r for own in runs for r in own)
    return [any(count[r] > 1 for r in own) for own in runs]


@pytest.mark.parametrize("table,words", [("odd", 51), ("odd", 3), ("odd", 1), ("small", 51), ("small", 8), ("forms", 51), ("forms", 90), ("forms", 111)])
def test_passages_beside_brute_force(request, table, words):
    docs = request.getfixturevalue(table)
    texts = [r[0] for r in docs.select("text").collect()]
    result, _ = bwt_dedup.cleaned(docs, words=words)
    found = collections.Counter((r["key"], r["shares_passage"]) for r in result.collect())
    assert found == collections.Counter((hashlib.md5((t or "").encode()).digest(), s) for t, s in zip(texts, brute_passages(texts, words)))


def test_query_reports_passages_below_400_bytes(spark, tmp_path):
    """A passage of 51 words that documents share, too short to be removed; one of 50 words; one that repeats in its own text."""
    rng = random.Random(4)
    say = lambda n: " ".join("".join(rng.choice("abcdef") for _ in range(5)) for _ in range(n))
    long, short, own, copied = say(51), say(50), say(60), say(55)
    texts = [f"{say(30)} {long} {say(40)}", f"{say(9)}\n{long.replace(' ', '  ', 1)}", f"{say(30)} {short} {say(40)}", f"{short} {say(20)}", f"{own} {say(5)} {own}", say(300), copied, copied, short, None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = sorted(queries.QUERIES["op4_suffix_dedup"](spark, str(tmp_path)).collect(), key=lambda r: r["doc_id"])
    assert [r["shares_passage"] for r in rows] == [True, True, False, False, False, False, True, True, False, False, False]
    assert [r["n_removed"] for r in rows] == [0] * 11


def test_bytes_operator_texts(odd, nothing):
    out = bwt_dedup.deduplicated(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert bwt_dedup.deduplicated(nothing).count() == 0


def brute_lines(rows):
    """Texts in order of (id, place) with later repeated windows taken out; repeated rows in any order."""
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        parts = (text or "").split("\n")
        own = [j for j, x in enumerate(parts) if WORD.search(x)]
        n = min(line_dedup.WIDTH, len(own))
        drop = set()
        windows = [(s, n) for s in range(len(own) - n + 1)] if own else []
        if n > 1:
            windows += [(s, 1) for s in range(len(own)) if len(WORD.findall(parts[own[s]])) >= line_dedup.LONG_LINE]
        for s, k in sorted(windows):
            content = tuple(parts[j] for j in own[s : s + k])
            if content in seen:
                drop.update(own[s : s + k])
            seen.add(content)
        out.append((i, len(own), len(drop), None if text is None else "\n".join(x for j, x in enumerate(parts) if j not in drop)))
    return sorted(out, key=str)


@pytest.mark.parametrize("table", ["odd", "small"])
def test_lines_beside_brute_force(request, table):
    docs = request.getfixturevalue(table)
    found = line_dedup.deduplicated(docs)
    assert found.columns == [*docs.columns, "_lines"]
    rows = [(r["doc_id"], r["_lines"]["n_lines"], r["_lines"]["n_removed"], r["_lines"]["text"]) for r in found.collect()]
    assert sorted(rows, key=str) == brute_lines([(r[0], r[1]) for r in docs.select("doc_id", "text").collect()])


def test_lines_of_nothing(nothing):
    assert line_dedup.deduplicated(nothing).count() == 0


def brute_near(rows, k, percent):
    sets = []
    for i, text in rows:
        words = [x for x in WORD.findall(fold(text))]
        grams = {tuple(words[j : j + k]) for j in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())
        sets.append((i, grams))
    root = list(range(len(sets)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                root[top(a)] = top(b)
    least = {}
    for j, (i, _) in enumerate(sets):
        if i is not None:
            least[top(j)] = min(least.get(top(j), i), i)
    return sorted(((i, len(g), least.get(top(j), i)) for j, (i, g) in enumerate(sets)), key=str)


@pytest.mark.parametrize("table,k,percent", [("odd", 3, 85), ("small", 3, 85), ("small", 5, 80), ("small", 3, 50)])
def test_near_duplicates_beside_brute_force(request, table, k, percent):
    docs = request.getfixturevalue(table)
    rows = [(r[0], r[1]) for r in docs.select("doc_id", "text").collect()]
    found = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs, k, percent).collect()]
    assert sorted(found, key=str) == brute_near(rows, k, percent)


def dense_rows(n=240, seed=3):
    """One text with 0 to 14 words changed, added or left out: a crowd of near copies of which some reach the threshold."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(400)}" for _ in range(150)]
    rows = []
    for i in range(n):
        words = list(base)
        for _ in range(rng.randrange(15)):
            at = rng.randrange(len(words))
            words[at : at + rng.choice([1, 1, 1, 0, 2])] = [f"x{rng.randrange(30)}"] * rng.choice([1, 1, 1, 0])
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_dense_group_beside_brute_force(spark, k, percent):
    rows = dense_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs, k, percent).collect()]
    assert sorted(found, key=str) == brute_near(rows, k, percent)


@pytest.mark.parametrize("percent", [85, 60])
def test_rare_pairs_lose_no_link(spark, percent):
    texts = [t for _, t in dense_rows(160, 8)]
    data = b"".join(t.encode() for t in texts)
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    found = near_dedup.sets(np.frombuffer(data, np.uint8), at, 3)
    rows = [(bytes([i]), bytes([i // 2]), len(s), s.view(np.int64).tolist()) for i, s in enumerate(found)]
    members = spark.createDataFrame(rows, "cls binary, root binary, n long, shingles array<long>")
    pairs = {frozenset((r["a"][0], r["b"][0])) for r in near_dedup.rare_pairs(members, percent).collect()}
    both = {(i, j): len(np.intersect1d(found[i], found[j])) for i in range(160) for j in range(i)}
    linked = {frozenset(p) for p, n in both.items() if p[0] // 2 != p[1] // 2 and 100 * n >= percent * (len(found[p[0]]) + len(found[p[1]]) - n)}
    assert linked and linked <= pairs
    assert all(a // 2 != b // 2 for a, b in pairs)


def test_one_of_each(odd, nothing):
    out = near_dedup.one_of_each(odd)
    assert out.columns == odd.columns
    found = brute_near([(r[0], r[1]) for r in odd.select("doc_id", "text").collect()], 5, 80)
    assert {r["doc_id"] for r in out.collect() if r["doc_id"] is not None} == {c for _, _, c in found if c is not None}
    assert near_dedup.one_of_each(nothing).count() == 0


def test_least_matches():
    t = near_dedup.least_matches(0.85)
    below = lambda t: sum(math.comb(32, i) * 0.85**i * 0.15 ** (32 - i) for i in range(t))
    assert below(t) <= 1e-5 < below(t + 1)
