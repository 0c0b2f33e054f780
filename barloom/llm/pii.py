"""Personal data replaced by keyed surrogates.

Entities are found with one expression of ordered alternatives.  A surrogate follows from a secret key, the entity's
type and its canonical form, so an entity gets the same one wherever it is named, in whatever notation.  It has the
entity's type and format: digits for digits, letters of the same script and case for letters, separators as they were;
payment numbers stay valid if they were; names get names of the gender that their title tells.  The distinct
entities of the whole corpus are one table; two entities with one surrogate, or a surrogate that is itself an
entity, are tried again until all differ.  From the fourth failure on, names get a syllable and phone and social numbers
a digit more at each attempt, mailboxes a suffix, and addresses a larger range, so the loop ends however many there are.

All plans are DataFrame functions.  The table of entities is stored, and each attempt is a step over it.

Cases: null text stays null; a text without entities stays as it is; rows that repeat stay, with equal results; an empty
table gives an empty result; other columns are kept by :func:`replaced`; many entities in a text cost in proportion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.session import stored

#: fixed patterns, most specific first; one match is of the first kind that its text satisfies.  A repeated group is
#: bounded, as the engine keeps a frame for each repeat: a domain has at most 127 labels
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+){0,125}\.[A-Za-z]{2,}(?![A-Za-z0-9])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
ADDRESS = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)"
SOCIAL = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
CARD = r"(?<!\d)\d(?:[\x20-]?\d){12,18}(?!\d)"
PHONE = r"(?<![\w+])(?:\+\d{1,3}[\x20.-]?(?:\(\d{1,4}\)[\x20.-]?)?\d{2,4}(?:[\x20.-]\d{2,4}){1,4}|\+\d{8,14}|\(\d{3}\)\x20?\d{3}[\x20.-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\d])"
MALE = r"(?:Mr|Herrn?|Monsieur|Señor|Sr|Mister)"
FEMALE = r"(?:Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra)"
PERSON = rf"(?<![\p{{L}}])(?:{MALE}|{FEMALE})\.?\x20\p{{Lu}}[\p{{L}}'-]+(?:\x20\p{{Lu}}[\p{{L}}'-]+)?"
FOUND = "|".join(f"(?:{p})" for p in (EMAIL, IBAN, SOCIAL, PHONE, CARD, ADDRESS, PERSON))
KINDS = ("email", "iban", "social", "phone", "card", "ip", "male", "female", "surname")
#: letters of surrogates by script: lower-case vowels, lower-case consonants
SCRIPTS = {
    "latin": ("aeiou", "bdfghklmnprstvz"),
    "cyrillic": ("аеиоу", "бвгдзклмнпрст"),
    "greek": ("αεηιο", "βγδζκλμνπρστ"),
}


def _whole(pattern: str) -> str:
    return f"^(?:{pattern})$"


def kind_of(match: Column) -> Column:
    """The kind of a whole match; persons are told apart by their titles."""
    return (
        F.when(F.contains(match, F.lit("@")), F.lit("email"))
        .when(match.rlike(rf"^{FEMALE}\.?\x20"), F.lit("female"))
        .when(match.rlike(rf"^{MALE}\.?\x20"), F.lit("male"))
        .when(match.rlike(r"^[A-Z]{2}\d{2}"), F.lit("iban"))
        .when(match.rlike(r"^\d{3}-\d{2}-\d{4}$"), F.lit("social"))
        .when(match.rlike(r"^(?:\d{1,3}\.){3}\d{1,3}$"), F.lit("ip"))
        .when(match.rlike(r"^(?:\+|\()") | match.rlike(r"^\d{3}[.-]\d{3}[.-]\d{4}$"), F.lit("phone"))
        .otherwise(F.lit("card"))
    )


def canonical(raw: Column, kind: Column) -> Column:
    """The form that all notations of one entity share."""
    return (
        F.when(kind.isin("phone", "card", "social"), F.regexp_replace(raw, r"\D", ""))
        .when(kind == "iban", F.regexp_replace(raw, r"\x20", ""))
        .when(kind == "ip", raw)
        .otherwise(F.lower(raw))
    )


def parts(match: Column) -> Column:
    """A match as parts (kind, raw, lead): a person has its title as the lead of the first name, others are one."""
    kind = kind_of(match)
    words = F.split(match, r"\x20")
    one = F.array(F.struct(kind.alias("kind"), match.alias("raw"), F.lit("").alias("lead")))
    title = F.concat(words[0], F.lit(" "))
    full = F.array(
        F.struct(kind.alias("kind"), words[1].alias("raw"), title.alias("lead")),
        F.struct(F.lit("surname").alias("kind"), F.try_element_at(words, F.lit(3)).alias("raw"), F.lit(" ").alias("lead")),
    )
    short = F.array(F.struct(F.lit("surname").alias("kind"), words[1].alias("raw"), title.alias("lead")))
    return F.when(kind.isin("male", "female"), F.when(F.size(words) > 2, full).otherwise(short)).otherwise(one)


def _byte(hexes: Column, place: Column, ahead: int = 0) -> Column:
    """A keyed number at a place of the entity, 0 to 65535."""
    return F.conv(F.substr(hexes, F.pmod(place, F.lit(48)) * 4 + 1 + ahead, F.lit(4)), 16, 10).cast("int")


def _pick(letters: str, n: Column) -> Column:
    return F.substr(F.lit(letters), F.pmod(n, F.lit(len(letters))) + 1, F.lit(1))


def script_of(text: Column) -> Column:
    return F.when(text.rlike(r"\p{IsCyrillic}"), F.lit("cyrillic")).when(text.rlike(r"\p{IsGreek}"), F.lit("greek")).otherwise(F.lit("latin"))


def _luhn(digits: Column) -> Column:
    """Luhn sum of an array of digits, modulo 10; 0 is valid."""
    n = F.size(digits)
    doubled = F.transform(digits, lambda d, i: F.when((n - i) % 2 == 0, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10


def surrogate(kind: Column, form: Column, attempt: Column, key: str) -> Column:
    """The canonical surrogate of an entity in its canonical form."""
    seed = F.concat_ws("|", F.lit(key), kind, attempt.cast("string"), form)
    hexes = F.concat(F.sha2(seed.cast("binary"), 512), F.sha2(F.concat(F.lit("2|"), seed).cast("binary"), 256), F.sha2(F.concat(F.lit("3|"), seed).cast("binary"), 256))
    chars = F.regexp_extract_all(form, F.lit("(?s)."), F.lit(0))
    script = script_of(form)
    # after failed attempts the kinds with few surrogates get longer ones, so that there are always free ones
    more = F.greatest(attempt - 3, F.lit(0))

    def letter(i: Column) -> Column:
        out = None
        for name, (vowels, consonants) in SCRIPTS.items():
            one = F.when(i % 2 == 0, _pick(consonants, _byte(hexes, i))).otherwise(_pick(vowels, _byte(hexes, i)))
            out = one if out is None else F.when(script == name, one).otherwise(out)
        return out

    # names: letters in turn, as long as the name (at least four), with an ending of the gender; a syllable more each
    length = F.greatest(F.length(form), F.lit(4)) + 2 * more
    core = F.array_join(F.transform(F.sequence(F.lit(0), length - 2), lambda i: letter(i)), "")
    ending = F.when(kind == "female", F.when(script == "latin", F.lit("a")).when(script == "cyrillic", F.lit("а")).otherwise(F.lit("α"))).otherwise(
        F.when(script == "latin", _pick("nrsl", _byte(hexes, length))).when(script == "cyrillic", _pick("нрсл", _byte(hexes, length))).otherwise(_pick("ςνρς", _byte(hexes, length)))
    )
    name = F.concat(core, ending)
    digit = lambda i: F.pmod(_byte(hexes, i), F.lit(10))
    added = F.when(more > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(more, F.lit(1))), lambda i: digit(F.size(chars) + i).cast("string")), "")).otherwise(F.lit(""))
    # phone: the first digit (the country or the area's first) stays
    number = F.array_join(F.transform(chars, lambda c, i: F.when(i == 0, c).when(i < 3, (F.pmod(_byte(hexes, i), F.lit(8)) + 2).cast("string")).otherwise(digit(i).cast("string"))), "")
    social = F.array_join(F.transform(chars, lambda c, i: F.when(i == 0, F.lit("9")).otherwise(digit(i).cast("string"))), "")
    # payment number: the first digit (its scheme) stays, the last keeps the checksum's validity
    given = F.transform(chars, lambda c: c.try_cast("int"))
    drawn = F.transform(given, lambda c, i: F.when(i == 0, c).when(i == F.size(given) - 1, F.lit(0)).otherwise(digit(i)))
    check = F.pmod(_luhn(given) - _luhn(drawn), F.lit(10))
    card = F.concat(F.array_join(F.transform(F.slice(drawn, 1, F.size(drawn) - 1), lambda d: d.cast("string")), ""), check.cast("string"))
    iban = F.array_join(F.transform(chars, lambda c, i: F.when(i < 2, c).when(c.rlike("[0-9]"), digit(i).cast("string")).otherwise(_pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", _byte(hexes, i)))), "")
    octet = lambda i, base: (F.pmod(_byte(hexes, F.lit(i)), F.lit(254 - base)) + base).cast("string")
    ip = F.concat_ws(".", F.lit("10"), octet(1, 0), octet(2, 0), octet(3, 1))
    # then reserved addresses, then numbers that are none
    reserved = F.concat_ws(".", (F.pmod(_byte(hexes, F.lit(0)), F.lit(16)) + 240).cast("string"), octet(1, 0), octet(2, 0), octet(3, 1))
    beyond = F.concat_ws(".", *[(F.pmod(_byte(hexes, F.lit(i)), F.lit(744)) + 256).cast("string") for i in range(4)])
    ip = F.when(attempt > 6, beyond).when(attempt > 3, reserved).otherwise(ip)
    local = F.split_part(form, F.lit("@"), F.lit(1))
    mailbox = F.array_join(
        F.transform(F.regexp_extract_all(local, F.lit("(?s)."), F.lit(0)), lambda c, i: F.when(c.rlike("[0-9]"), digit(i).cast("string")).when(c.rlike("[a-z]"), letter(i)).otherwise(c)), ""
    )
    # short mailboxes are lengthened after failed attempts, so that there are always free ones
    longer = F.when(attempt > 3, F.concat(F.lit("."), F.substring(hexes, 1, 8))).otherwise(F.lit(""))
    email = F.concat(mailbox, longer, F.lit("@example."), F.element_at(F.array(*[F.lit(x) for x in ("com", "net", "org")]), F.pmod(_byte(hexes, F.lit(47)), F.lit(3)) + 1))
    return (
        F.when(kind == "email", email)
        .when(kind.isin("male", "female", "surname"), name)
        .when(kind == "phone", F.concat(number, added))
        .when(kind == "social", F.concat(social, added))
        .when(kind == "iban", iban)
        .when(kind == "ip", ip)
        .otherwise(card)
    )


def dressed(raw: Column, kind: Column, form: Column) -> Column:
    """The canonical surrogate ``form`` in the notation of ``raw``."""
    # separators of the raw text stay where they are; digits and letters are taken in turn
    chars = F.regexp_extract_all(raw, F.lit("(?s)."), F.lit(0))
    taken = F.aggregate(
        chars,
        F.struct(F.lit(1).alias("i"), F.lit("").alias("out")),
        lambda acc, c: F.struct(
            F.when(c.rlike("[0-9A-Za-z]"), acc["i"] + 1).otherwise(acc["i"]).alias("i"),
            F.concat(acc["out"], F.when(c.rlike("[0-9A-Za-z]"), F.substr(form, acc["i"], F.lit(1))).otherwise(c)).alias("out"),
        ),
    )
    # what a longer surrogate has besides comes last
    filled = F.concat(taken["out"], F.substr(form, taken["i"]))
    upper = (raw == F.upper(raw)) & (F.length(raw) > 1)
    named = F.when(upper, F.upper(form)).otherwise(F.initcap(form))
    return F.when(kind.isin("phone", "card", "social", "iban"), filled).when(kind.isin("male", "female", "surname"), named).when((kind == "email") & upper, F.upper(form)).otherwise(form)


def entities(mentions: DataFrame, key: str) -> DataFrame:
    """``kind``, ``form``, ``attempt``, ``surrogate`` of the distinct entities of ``mentions`` (kind, form)."""
    table = stored(mentions.select("kind", "form").distinct().withColumn("attempt", F.lit(0)), "pii-entities")
    while True:
        made = table.withColumn("surrogate", surrogate(F.col("kind"), F.col("form"), F.col("attempt"), key))
        made = stored(made, "pii-surrogates")
        taken = F.row_number().over(Window.partitionBy("kind", "surrogate").orderBy("attempt", "form")) > 1
        real = made.select("kind", F.col("form").alias("surrogate"), F.lit(True).alias("_real"))
        judged = made.withColumn("_taken", taken).join(real, ["kind", "surrogate"], "left").withColumn("_again", F.col("_taken") | F.col("_real").isNotNull())
        clash = stored(judged.where("_again").select("kind", "form"), "pii-clashes")
        if clash.isEmpty():
            return made
        again = clash.withColumn("_again", F.lit(1))
        table = stored(made.drop("surrogate").join(again, ["kind", "form"], "left").select("kind", "form", (F.col("attempt") + F.coalesce("_again", F.lit(0))).alias("attempt")), "pii-entities")


def replaced(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with surrogates in ``text`` and the columns ``n_entities`` and one count per kind (``n_email`` ...);
    columns of ``docs`` with these names are replaced."""
    counts = [f"n_{k}" for k in KINDS]
    docs = docs.drop("n_entities", *counts)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    with_any = F.coalesce(F.col(text).rlike(FOUND), F.lit(False))
    plain = docs.where(~with_any).select(*columns, F.lit(0).alias("n_entities"), *[F.lit(0).alias(c) for c in counts])
    gaps, hits = F.split(F.col(text), FOUND, -1), F.regexp_extract_all(F.col(text), F.lit(FOUND), F.lit(0))
    held = stored(docs.where(with_any).select(F.struct(*columns).alias("_row"), gaps.alias("_gaps"), hits.alias("_hits")), "pii-texts")
    # every part carries the text before it, so that a text is put together in one pass
    lead = lambda h, i: F.transform(parts(h), lambda p, j: F.struct(p["kind"].alias("kind"), p["raw"].alias("raw"), F.when(j == 0, F.concat(F.get("_gaps", i), p["lead"])).otherwise(p["lead"]).alias("lead")))
    held = held.select(
        "_row",
        F.concat("_metadata.file_name", F.lit(":"), "_metadata.row_index").alias("_id"),
        F.flatten(F.transform("_hits", lead)).alias("_parts"),
        F.element_at("_gaps", -1).alias("_tail"),
    )
    mentions = held.select("_id", F.posexplode(F.transform("_parts", lambda p: F.struct(p["kind"].alias("kind"), p["raw"].alias("raw")))).alias("_at", "_p"))
    mentions = mentions.select("_id", "_at", F.col("_p.kind").alias("kind"), F.col("_p.raw").alias("raw"))
    mentions = mentions.withColumn("form", canonical(F.col("raw"), F.col("kind")))
    table = entities(mentions, key).select("kind", "form", "surrogate")
    new = dressed(F.col("raw"), F.col("kind"), F.col("surrogate"))
    by_doc = mentions.join(table, ["kind", "form"]).groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("_at", new.alias("new")))).alias("_new"))
    joined = held.join(by_doc, "_id")
    body = F.concat(F.array_join(F.zip_with("_parts", "_new", lambda p, m: F.concat(p["lead"], m["new"])), ""), "_tail")
    kinds = F.transform("_parts", lambda p: p["kind"])

    def count(kind: str) -> Column:
        return F.size(F.filter(kinds, lambda x: x == kind))

    done = joined.select(
        *[(body if c == text else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns],
        F.size("_new").alias("n_entities"),
        *[count(k).alias(f"n_{k}") for k in KINDS],
    )
    return plain.unionByName(done)
