"""Secret scan with a trigram inverted index.

From the regular expression of each rule a Boolean query over trigrams is derived: a text that matches must hold,
for every clause, all trigrams of at least one alternative.  The index lists the documents of each trigram that
some rule asks for (of lower-cased text).  The postings of a document are intersected along each rule's query;
only documents that pass are read again, and the rule's expression is run on them.  A rule whose expression has no
mandatory trigrams is run on all texts.

Everything on Spark is DataFrame functions; the derivation works on the rules alone.

Cases: null text is empty; a null id or rows that repeat are matched by (id, checksum), so each row gets its own
result and equal rows equal ones; an empty table gives an empty index and result; only id and text are read.
"""

from __future__ import annotations

import re
from itertools import product
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.session import stored

_parser = re._parser
_c = re._constants
#: most strings that are multiplied out, and most characters of a set that is
_MOST, _MOST_SET = 64, 4


class Rule(NamedTuple):
    """``pattern`` in the common part of Java and Python syntax; ``least`` characters of ``group``."""

    name: str
    pattern: str
    group: int
    least: int


#: the base rules (fixed by their contract) and the ones added
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)
ADDED = (
    Rule("repository", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    Rule("cloud", r"AIza[A-Za-z0-9_-]{35}", 0, 39),
    Rule("payment", r"[rs]k_live_[A-Za-z0-9]{16,}", 0, 24),
    Rule("signed", r"eyJ[A-Za-z0-9_-]{8,}[.]eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}", 0, 30),
    Rule("private", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 27),
    Rule("address", r"://[^\x20\x09-\x0D/:@]{1,64}:[^\x20\x09-\x0D/:@]{1,64}@", 0, 6),
)


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """Clauses of alternatives of trigrams (lower-cased); no clause if nothing is mandatory."""
    clauses: list[list[frozenset[str]]] = []

    def close(strings: set[str]) -> None:
        grams = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
        if grams and frozenset() not in grams:
            clauses.append(sorted((g for g in grams if not any(o < g for o in grams)), key=sorted))

    def strings_of(item) -> set[str] | None:
        """All strings of a part if they are few, else None."""
        op, value = item
        if op is _c.LITERAL:
            return {chr(value).lower()}
        if op is _c.IN:
            chars: set[str] = set()
            for kind, x in value:
                if kind is _c.LITERAL:
                    chars.add(chr(x).lower())
                elif kind is _c.RANGE and x[1] - x[0] < 2 * _MOST_SET:
                    chars |= {chr(y).lower() for y in range(x[0], x[1] + 1)}
                else:
                    return None
                if len(chars) > _MOST_SET + 2:
                    return None
            return chars
        if op is _c.SUBPATTERN:
            return whole(value[-1])
        if op is _c.BRANCH:
            parts = [whole(b) for b in value[1]]
            return None if None in parts else set().union(*parts)
        if op in (_c.MAX_REPEAT, _c.MIN_REPEAT) and value[1] <= 2:
            part = whole(value[2])
            return None if part is None else {"".join(x) for n in range(value[0], value[1] + 1) for x in product(part, repeat=n)}
        return {""} if op is _c.AT else None

    def whole(parsed) -> set[str] | None:
        out = {""}
        for item in parsed:
            part = strings_of(item)
            if part is None or len(part) * len(out) > _MOST:
                return None
            out = {a + b for a in out for b in part}
        return out

    run = {""}
    for item in _parser.parse(pattern):
        part = strings_of(item)
        if part is None or len(part) * len(run) > _MOST:
            close(run)
            run = {""} if part is None else part
        else:
            run = {a + b for a in run for b in part}
    close(run)
    return clauses


def _key(doc_id: str, text: Column) -> list[Column]:
    return [F.coalesce(F.col(doc_id).cast("string"), F.lit("null")).alias("_id"), F.crc32(text.cast("binary")).alias("_crc")]


def index(docs: DataFrame, rules: tuple[Rule, ...], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Postings ``gram``, ``_id``, ``_crc`` of the trigrams that the rules ask for."""
    grams = sorted({g for r in rules for clause in trigram_query(r.pattern) for a in clause for g in a})
    content = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(*_key(doc_id, content), F.lower(content).alias("_low"))
    held = F.array_compact(F.array(*[F.when(F.contains("_low", F.lit(g)), F.lit(g)) for g in grams])) if grams else F.array().cast("array<string>")
    return rows.select("_id", "_crc", F.explode(held).alias("gram"))


def candidates(postings: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``_id``, ``_crc`` and the names of the ``rules`` whose query the document's postings satisfy."""
    own = postings.groupBy("_id", "_crc").agg(F.collect_set("gram").alias("_grams"))
    passed = []
    for rule in rules:
        query = trigram_query(rule.pattern)
        if not query:
            continue
        all_of = F.lit(True)
        for clause in query:
            any_of = F.lit(False)
            for alternative in clause:
                any_of |= F.size(F.array_intersect("_grams", F.array(*[F.lit(g) for g in sorted(alternative)]))) == len(alternative)
            all_of &= any_of
        passed.append(F.when(all_of, F.lit(rule.name)))
    names = F.array_compact(F.array(*passed)) if passed else F.array().cast("array<string>")
    return own.select("_id", "_crc", names.alias("_rules")).where(F.size("_rules") > 0)


def matches(text: Column, rule: Rule) -> Column:
    """Spans (start, end, kind) of the leftmost matches that do not overlap and are long enough."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    between = F.split(text, rule.pattern, -1)
    long_enough = lambda m: F.length(F.regexp_extract(m, rule.pattern, rule.group) if rule.group else m) >= rule.least
    empty = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    end_of = lambda at, x: at + F.length(x["gap"]) + F.coalesce(F.length(x["hit"]), F.lit(0))

    def walk(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        span = F.struct(start.alias("start"), (start + F.length(x["hit"])).alias("end"), F.lit(rule.name).alias("kind"))
        kept = F.when(x["hit"].isNotNull() & long_enough(x["hit"]), F.concat(acc["out"], F.array(span))).otherwise(acc["out"])
        return F.struct(end_of(acc["at"], x).alias("at"), kept.alias("out"))

    def spans(pieces: Column) -> Column:
        # an accumulator is copied at every step, so the pieces are walked in chunks, each from its own start
        chunks = F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / CHUNK).cast("int"))
        chunk = lambda i: F.slice(pieces, i * CHUNK + 1, F.lit(CHUNK))
        lengths = F.transform(chunks, lambda i: F.aggregate(chunk(i), F.lit(0), end_of))
        starts = lambda sizes: F.transform(sizes, lambda _, i: F.aggregate(F.slice(sizes, F.lit(1), i), F.lit(0), lambda a, n: a + n))
        walked = lambda at: F.transform(at, lambda start, i: F.aggregate(chunk(i), F.struct(start.alias("at"), empty.alias("out")), walk)["out"])
        return F.flatten(_with(_with(lengths, starts), walked))

    pieces = F.arrays_zip(between.alias("gap"), found.alias("hit"))
    return F.when(text.rlike(quick(rule)), _with(pieces, spans)).otherwise(empty)


#: pieces of a text that are walked with one accumulator
CHUNK = 256


def _with(value: Column, made) -> Column:
    """``made(value)`` with the value worked out once."""
    return F.transform(F.array(value), made)[0]


def quick(rule: Rule) -> str:
    """An expression that every text with a kept match satisfies."""
    return re.sub(r"\+$", f"{{{rule.least},}}", rule.pattern) if rule.group == 0 and re.fullmatch(r"\[[^]]*\]\+", rule.pattern) else rule.pattern


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + ADDED, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``spans`` (array of start, end, kind; code points) of every row of ``docs``."""
    content = F.coalesce(F.col(text), F.lit(""))
    indexed = tuple(r for r in rules if trigram_query(r.pattern))
    plain = [r for r in rules if r not in indexed]
    postings = index(docs, indexed, doc_id, text)
    passed = stored(candidates(postings, indexed), "secret-candidates")
    again = docs.select(*_key(doc_id, content), content.alias("_text")).join(passed, ["_id", "_crc"])
    none = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    found = F.concat(none, *[F.when(F.array_contains("_rules", r.name), matches(F.col("_text"), r)).otherwise(none) for r in indexed])
    verified = again.select("_id", "_crc", found.alias("_found")).where(F.size("_found") > 0).dropDuplicates(["_id", "_crc"])
    whole = docs.select(F.col(doc_id).alias("doc_id"), *_key(doc_id, content), F.concat(none, *[matches(content, r) for r in plain]).alias("_plain"))
    return whole.join(verified, ["_id", "_crc"], "left").select("doc_id", F.concat("_plain", F.coalesce("_found", none)).alias("spans"))


def listed(spans: Column, rules: tuple[Rule, ...]) -> Column:
    """Spans as ``kind:start:end`` by start, then by the order of the rules, joined by commas."""
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.name), F.lit(i))])
    names = [r.name for r in rules]
    own = F.filter(spans, lambda s: s["kind"].isin(names))
    ordered = F.array_sort(F.transform(own, lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("place"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.concat_ws(",", F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
