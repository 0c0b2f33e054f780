"""MinHash near-duplicates by an inverted join over signature coordinates.

A document's set is its distinct shingles of ``k`` words.  Documents with equal sets are one class; the join works on
classes.  A class is posted under its (coordinate, value) pairs.  Two sets with a similarity of ``threshold`` agree in
at least ``matches`` of the ``COORDINATES`` pairs, but for a chance of ``MISS``.  So they share one among the
``COORDINATES - matches + 1`` pairs of each that are rarest in the corpus: only these are posted, pairs that occur
once are dropped, and the frequent rest is skipped in the merge and only looked at when collisions are counted.

Candidates come in two steps, so that a group of copies is not spread out into all its pairs.  First each class
is compared with two ends of every list that it is in: the least class id, and the hub, the member whose values are
the most frequent ones (in a group of near copies, one with few edits of its own).  Their confirmed links give
components.  What is left to compare are pairs of *different* components among the inner members of a list; pairs
inside one component could not change it.  A dense list, with members near each other but not linked, has a number of
such pairs that grows with its square, nearly all below the threshold.  So these members are merged by what is rare in
them: sets at the threshold overlap so much that they share one of the rarest shingles of each (a prefix as long as
the sizes of both allow), and postings that only one member or one component has are skipped.  A member's own edits
fill its prefix, so the common part of the list is never paired.  No link between components is left out.

In both steps collisions are counted: candidates below the number of matches, or whose set sizes alone exclude the
threshold, are dropped; the others are confirmed on the full sets of both texts.  The second step counts inside its
join, on the low byte of each coordinate: that many coordinates agree at least, so no link is lost, and pairs that the
count excludes are never written or shuffled.

Cases: null text, or text without words, has an empty set and is linked with nothing; fewer than ``k`` words are one
shingle; rows that repeat and equal texts are one class; a null id is never the least of its component; an empty
table gives an empty result; only id and text are read.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm import words as w
from barloom.llm.components import components
from barloom.llm.types import BINARY, INT, LONG, many, row
from barloom.session import batches_by_bytes, stored

COORDINATES = 32
#: chance that a pair right at the threshold has too few matches
MISS = 1e-5
#: ratio of the sizes of sets posted together in the second step
SIZES = 1.05
SKETCH = row(n_shingles=LONG, cls=BINARY, sig=many(INT))
_rng = np.random.default_rng(20)
_MULTIPLY = _rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)


def least_matches(threshold: float, n: int = COORDINATES, miss: float = MISS) -> int:
    """The largest t with P(Binomial(n, threshold) < t) <= miss."""
    below = 0.0
    for t in range(n + 1):
        below += math.comb(n, t) * threshold**t * (1 - threshold) ** (n - t)
        if below > miss:
            return max(1, t)
    return n


def sets(data: np.ndarray, at: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    starts, ends, first = w.cut(w.LOWER[data], at)
    hashes = w.word_hashes(w.LOWER[data], starts, ends)
    runs, doc, _ = w.shingles(hashes, first, k)
    bounds = np.searchsorted(doc, np.arange(len(at)))
    out = []
    for i in range(len(at) - 1):
        n = int(first[i + 1] - first[i])
        if n >= k:
            out.append(np.unique(runs[bounds[i] : bounds[i + 1]]))
        elif n:
            acc = hashes[first[i] : first[i] + 1]
            for j in range(1, n):
                acc = acc * np.uint64(0xD6E8FEB86659FD93) + hashes[first[i] + j : first[i] + j + 1]
            out.append(w.mix(acc + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(values: np.ndarray) -> np.ndarray:
    """The least of each of the hash functions over a set, as 32-bit numbers."""
    least = np.full(COORDINATES, np.uint64(0xFFFFFFFFFFFFFFFF))
    for i in range(0, len(values), 4096):
        np.minimum(least, (values[i : i + 4096, None] * _MULTIPLY + _ADD).min(0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _sketch(k: int):
    @F.arrow_udf(SKETCH)
    def sketch(texts: pa.Array) -> pa.Array:
        sizes, classes, sigs = [], [], []
        for _, _, data, at in w.texts(texts):
            for values in sets(data, at, k):
                sizes.append(len(values))
                ids = np.array([w.mix(values ^ np.uint64(1)).sum(dtype=np.uint64), w.mix(values ^ np.uint64(2)).sum(dtype=np.uint64)])
                classes.append(ids.tobytes() if len(values) else None)
                sigs.append(signature(values) if len(values) else None)
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()), pa.array(sigs, pa.list_(pa.int32()))], ["n_shingles", "cls", "sig"])

    return sketch


def _hashes(k: int):
    @F.arrow_udf(many(LONG))
    def hashes(texts: pa.Array) -> pa.Array:
        """The distinct shingle hashes of each text."""
        return pa.array([values.view(np.int64) for _, _, data, at in w.texts(texts) for values in sets(data, at, k)], pa.list_(pa.int64()))

    return hashes


def _shared(k: int):
    @F.arrow_udf(row(inter=LONG, either=LONG))
    def shared(left: pa.Array, right: pa.Array) -> pa.Array:
        """Sizes of the intersection and the union of the full sets of two texts."""
        inter, either = [], []
        for (first, end, data, at), one in ((x, right.slice(x[0], x[1] - x[0])) for x in w.texts(left)):
            theirs = [s for _, _, d, a in w.texts(one) for s in sets(d, a, k)]
            for a, b in zip(sets(data, at, k), theirs):
                both = len(np.intersect1d(a, b, assume_unique=True))
                inter.append(both)
                either.append(len(a) + len(b) - both)
        return pa.StructArray.from_arrays([pa.array(inter, pa.int64()), pa.array(either, pa.int64())], ["inter", "either"])

    return shared


def postings(classes: DataFrame, matches: int) -> DataFrame:
    """``token``, ``cls``, ``n``, ``sig`` of the pairs under which each class must be posted, and the class's ``score``:
    how often its values occur, all together."""
    tokens = classes.select("cls", F.posexplode("sig").alias("_at", "_value")).select("cls", (F.col("_at").cast("long") * F.lit(1 << 32) + F.col("_value").cast("long") + F.lit(1 << 31)).alias("token"))
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    # tokens that occur once come first in the order by rarity; they fill the prefix but need no posting
    ranked = tokens.join(shared, "token").groupBy("cls").agg(F.array_sort(F.collect_list(F.struct("_n", "token"))).alias("_t"))
    room = F.col("_prefix") - (F.lit(COORDINATES) - F.size("_t"))
    prefix = ranked.withColumn("_prefix", F.lit(COORDINATES - matches + 1)).where(room > 0)
    prefix = prefix.select("cls", F.slice("_t", F.lit(1), room).alias("_t"), F.aggregate("_t", F.lit(0).cast("long"), lambda acc, x: acc + x["_n"]).alias("score"))
    return prefix.join(classes, "cls").select(F.explode("_t.token").alias("token"), "cls", F.col("n_shingles").alias("n"), "sig", "score")


def _likely(pairs: DataFrame, matches: int, percent: int) -> DataFrame:
    """Pairs (a, b) that agree in enough coordinates and whose sizes allow the threshold."""
    sizes = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    agree = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda acc, x: acc + x)
    return pairs.where((F.col("a") != F.col("b")) & sizes).where(agree >= matches).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def low_bytes(sig: Column) -> Column:
    """The low byte of every coordinate of a signature, eight to a number."""
    word = lambda j: reduce(lambda x, y: x.bitwiseOR(y), [F.shiftleft(F.get(sig, j + i).cast("long").bitwiseAND(F.lit(255)), 8 * i) for i in range(8)])
    return F.array(*[word(j) for j in range(0, COORDINATES, 8)])


def bytes_agreeing(x: Column, y: Column) -> Column:
    """How many of the bytes of two arrays of :func:`low_bytes` are equal."""

    def differ(one: Column, two: Column) -> Column:
        bits = one.bitwiseXOR(two)
        for step in (4, 2, 1):
            bits = bits.bitwiseOR(F.shiftrightunsigned(bits, step))
        return F.bit_count(bits.bitwiseAND(F.lit(0x0101010101010101)))

    return F.lit(COORDINATES) - reduce(lambda n, d: n + d, [differ(F.get(x, j), F.get(y, j)) for j in range(COORDINATES // 8)])


def _texts(needed: DataFrame, docs: DataFrame, reps: DataFrame, k: int, doc_id: str, text: str) -> DataFrame:
    """``cls`` and one text of each class in ``needed``."""
    ids = needed.join(reps, "cls").select(F.col("cls").alias("_cls"), "_rep")
    rows = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")).alias("_rep"), F.col(text).alias("text")).join(ids, "_rep")
    # an id that occurs with several texts: only the class's own one
    return rows.withColumn("_own", _sketch(k)("text")["cls"]).where("_own = _cls").select(F.col("_cls").alias("cls"), "text").dropDuplicates(["cls"])


def _confirmed(pairs: DataFrame, docs: DataFrame, reps: DataFrame, k: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """Pairs with ``linked``, judged on the full sets of one text of each class."""
    needed = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
    rows = _texts(needed, docs, reps, k, doc_id, text)
    left = rows.select(F.col("cls").alias("a"), F.col("text").alias("ta"))
    right = rows.select(F.col("cls").alias("b"), F.col("text").alias("tb"))
    both = pairs.join(left, "a").join(right, "b").withColumn("_s", _shared(k)("ta", "tb"))
    return both.select("a", "b", (100 * F.col("_s.inter") >= percent * F.col("_s.either")).alias("linked"))


def _overlap(one, two, percent: int):
    """The least intersection of sets of these sizes that reaches the threshold."""
    return F.ceil((one + two) * percent / F.lit(float(100 + percent)) - F.lit(1e-9))


def rare_pairs(members: DataFrame, percent: int, matches: int = 0) -> DataFrame:
    """Pairs (a, b), a < b, of ``members`` (cls, n, root, shingles) with different roots that share a shingle in the
    rarest-first prefixes which their sizes leave; with ``matches``, only those that agree in the low bytes (column
    ``low``) of so many coordinates.

    The smaller set (by size, then class) is posted under its size bin; the larger one looks into the bins down to
    the least size allowed.  Shingles of one member only come first in the order and need no posting."""
    if not matches:
        members = members.withColumn("low", F.lit(None).cast("array<long>"))
    tokens = members.select("cls", F.explode("shingles").alias("shingle"))
    shared = tokens.groupBy("shingle").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    ranked = tokens.join(shared, "shingle").groupBy("cls").agg(F.array_sort(F.collect_list(F.struct("_n", "shingle"))).alias("_t"))
    n = F.col("n")
    span = lambda size: F.floor(F.log(size.cast("double")) / F.lit(math.log(SIZES))).cast("int")
    least = F.ceil(n * percent / F.lit(100.0) - F.lit(1e-9))
    sized = ranked.join(members.select("cls", "n", "root", "low"), "cls").withColumn("_own", n - F.size("_t"))
    bins = F.explode(F.sequence(span(least), span(n))).alias("bin")
    probes = sized.select("cls", "n", "root", "low", "_own", "_t", bins)
    smallest = F.greatest(least, F.floor(F.pow(F.lit(SIZES), "bin")))
    posted = lambda rows, length: rows.withColumn("_p", (length - F.col("_own")).cast("int")).where("_p > 0").select("cls", "n", "root", "low", "_own", "bin", F.posexplode(F.slice("_t", F.lit(1), F.col("_p"))).alias("_at", "_e")).select("cls", "n", "root", "low", "bin", (F.col("_own") + F.col("_at")).alias("at"), F.col("_e.shingle").alias("shingle"))
    index = posted(sized.withColumn("bin", span(n)), n - _overlap(n, n, percent) + 1).withColumn("probe", F.lit(0))
    probe = posted(probes, n - _overlap(n, smallest, percent) + 1).withColumn("probe", F.lit(1))
    posts = stored(index.unionByName(probe), "near-rare")
    # skip postings without an index entry or with one root only
    open_keys = posts.groupBy("shingle", "bin").agg(F.min("root").alias("_low"), F.max("root").alias("_high"), F.min("probe").alias("_kind")).where("_low != _high and _kind = 0").select("shingle", "bin")
    posts = posts.join(open_keys, ["shingle", "bin"])
    small = posts.where("probe = 0").select("shingle", "bin", F.col("cls").alias("a"), F.col("n").alias("na"), F.col("root").alias("ra"), F.col("at").alias("pa"), F.col("low").alias("la"))
    large = posts.where("probe = 1").select("shingle", "bin", F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("root").alias("rb"), F.col("at").alias("pb"), F.col("low").alias("lb"))
    need = _overlap(F.col("na"), F.col("nb"), percent)
    fits = (F.col("ra") != F.col("rb")) & (F.struct("na", "a") < F.struct("nb", "b")) & (F.col("pa") <= F.col("na") - need) & (F.col("pb") <= F.col("nb") - need)
    fits = fits & (100 * F.col("na") >= percent * F.col("nb"))
    if matches:
        fits = fits & (bytes_agreeing(F.col("la"), F.col("lb")) >= matches)
    both = small.join(large, ["shingle", "bin"]).where(fits)
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, k: int = 3, percent: int = 85, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles``, ``cls`` (equal sets), ``root`` (a class that names the component, null without
    shingles), ``component_id`` (least id of the component) of every row."""
    batches_by_bytes(docs.sparkSession)
    matches = least_matches(percent / 100)
    rows = stored(docs.select(F.col(doc_id).alias("doc_id"), _sketch(k)(F.col(text)).alias("_s")).select("doc_id", "_s.*"), "near-sketches")
    with_set = rows.where("cls is not null")
    reps = with_set.groupBy("cls").agg(F.min("doc_id").alias("least"))
    named = reps.select("cls", F.coalesce(F.col("least").cast("string"), F.lit("null")).alias("_rep"))
    classes = with_set.dropDuplicates(["cls"]).select("cls", "n_shingles", "sig")
    posts = stored(postings(classes, matches), "near-postings")

    # first step: the ends of every list
    ends = posts.groupBy("token").agg(F.min(F.struct("cls", "n", "sig")).alias("low"), F.max(F.struct("score", "cls", "n", "sig")).alias("hub"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    ends = ends.select("token", F.explode(F.array("low", F.struct("hub.cls", "hub.n", "hub.sig"))).alias("e"))
    ends = ends.select("token", F.col("e.cls").alias("b"), F.col("e.n").alias("nb"), F.col("e.sig").alias("sb"))
    left = posts.select("token", F.col("cls").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
    first = stored(_likely(left.join(ends, "token"), matches, percent), "near-candidates")
    judged = stored(_confirmed(first, docs, named, k, percent, doc_id, text), "near-judged")
    roots = components(judged.where("linked").select("a", "b"))

    # second step: pairs of different components among the inner members of a list
    labelled = posts.select("token", "cls").join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    ends_of = posts.groupBy("token").agg(F.min("cls").alias("_low"), F.max(F.struct("score", "cls"))["cls"].alias("_hub"))
    inner = labelled.join(ends_of, "token").where("cls != _low and cls != _hub").select("token", "cls", "root")
    open_lists = inner.groupBy("token").agg(F.min("root").alias("_low"), F.max("root").alias("_high")).where("_low != _high").select("token")
    members = stored(inner.join(open_lists, "token").select("cls", "root").distinct(), "near-open")
    whole = _texts(members.select("cls"), docs, named, k, doc_id, text).select("cls", _hashes(k)("text").alias("shingles"))
    sketched = members.join(classes.select("cls", low_bytes(F.col("sig")).alias("low")), "cls")
    whole = stored(sketched.join(whole, "cls").select("cls", "root", F.size("shingles").cast("long").alias("n"), "shingles", "low"), "near-sets")
    second = stored(rare_pairs(whole, percent, matches).join(judged.select("a", "b"), ["a", "b"], "left_anti"), "near-candidates")
    more = stored(_confirmed(second, docs, named, k, percent, doc_id, text).where("linked").select("a", "b"), "near-judged")
    if not more.isEmpty():
        roots = components(judged.where("linked").select("a", "b").unionByName(more))

    found = reps.join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = found.groupBy("root").agg(F.min("least").alias("component_id"))
    by_class = stored(found.join(least, "root").select("cls", "root", "component_id"), "near-components")
    linked = rows.join(by_class, "cls", "left")
    return linked.select("doc_id", "n_shingles", "cls", "root", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of every group: the one with the least id (null ids after all others; of rows that repeat,
    one).  A row without shingles is no group's."""
    found = near_duplicates(docs, k, percent, doc_id, text)
    as_text = F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("_id")
    least = found.where("cls is not null").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "cls")).alias("m"))
    keep = least.select("m.doc_id", "m.cls").unionByName(found.where("cls is null").select("doc_id", "cls")).select(as_text, F.coalesce("cls", F.lit(b"")).alias("_cls")).distinct()
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = docs.select(whole, F.coalesce(F.col(doc_id).cast("string"), F.lit("null")).alias("_id"), F.coalesce(_sketch(k)(F.col(text))["cls"], F.lit(b"")).alias("_cls"))
    # an id may occur with several texts: one row for each that stays
    return rows.join(keep, ["_id", "_cls"]).dropDuplicates(["_id", "_cls"]).select("_row.*")
