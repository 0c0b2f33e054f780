"""Cases in which an operator once did less than the whole job."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from barloom.llm import html_paths, line_dedup, pii, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def repeated_lines(rows, words=50):
    """(id, removed lines) where the lines of every run of ``words`` words or three lines that occurs earlier are removed."""
    places, out = {}, []
    for i, text in sorted(rows):
        lines = [x for x in text.split("\n") if WORD.search(x)]
        gone = set()
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                if b - a >= 3 or b - a == len(lines) or sum(len(WORD.findall(x)) for x in lines[a:b]) >= words:
                    if places.setdefault(tuple(lines[a:b]), (i, a)) < (i, a):
                        gone.update(range(a, b))
        out.append((i, len(gone)))
    return out


def test_line_dedup_finds_passages_by_words(spark):
    rng = random.Random(11)
    say = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    first, second, last, short = say(43), say(49), say(60), say(12)
    rows = [
        (1, "\n".join([say(9), first, second, say(5), last, short, say(7)])),
        (2, "\n".join([say(8), say(3), first, second, say(4)])),
        (3, first + "\n" + second),
        (4, "\n".join([say(6), last, short])),
        (5, last),
        (6, short),
        (7, "\n".join([say(6), first, say(3), second])),
    ]
    pool = [say(n) for n in (4, 20, 26, 30, 49, 50, 51)]
    rows += [(10 + i, "\n".join(rng.choice(pool) if rng.random() < 0.7 else say(3) for _ in range(rng.randrange(1, 7)))) for i in range(60)]
    found = line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).select("doc_id", "_lines.n_removed").collect()
    assert dict(found)[2] == 2 and dict(found)[3] == 2 and dict(found)[4] == 2 and dict(found)[7] == 0
    assert sorted((r[0], r[1]) for r in found) == repeated_lines(rows)


def test_quality_keeps_clean_texts_of_rare_and_null_languages(spark):
    rng = random.Random(4)

    def say(letters, n):
        words = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(400)]
        return " ".join(rng.choice(words[:20] if rng.random() < 0.4 else words) for _ in range(n))

    latin, cyrillic, greek = "abcdefghijklm", "абвгдежзиклмн", "αβγδεζηθικλμν"
    rows = [(i, say(latin, 4000), "en") for i in range(1000)]
    rows += [(2000 + i, say(cyrillic, 150), "ru") for i in range(20)] + [(3000, say(greek, 150), "el"), (3001, say(cyrillic, 150), None)]
    rows += [(3002, "#*$% 0123 " * 3 + " ".join(f"#{rng.randrange(10**6)}" for _ in range(80)), "ru"), (3003, "слово " * 10, "ru"), (3004, "λέξη", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    kept = {r[0]: r[1] for r in quality.judged(docs).where("doc_id >= 2000").select("doc_id", "_quality.kept").collect()}
    assert all(kept[2000 + i] for i in range(20)) and kept[3000] and kept[3001]
    assert not kept[3002] and not kept[3003] and not kept[3004]


LONG = "Clause after clause, the paragraph goes on; it has marks, many words, and ends late. " * 7
BODY = [
    ("header", "<h1>{}</h1>", "Title"),
    ("p", "<p>{}</p>", LONG.strip()),
    ("ul", "<ul><li>{}</li></ul>", "short item"),
    ("links", "<ul class='refs'><li><a href='/x'>{}</a></li></ul>", "linked item"),
    ("table", "<table><tr><td>{}</td></tr></table>", "cell"),
    ("p2", "<p>{}</p>", LONG.strip() + " More."),
    ("dl", "<dl><dt>term</dt><dd>{}</dd></dl>", "meaning"),
    ("quote", "<blockquote>{}</blockquote>", "Said so"),
    ("figure", "<figure><figcaption>{}</figcaption></figure>", "a caption"),
]


@pytest.mark.parametrize("tag", ["article", "main", "div class='story'"])
def test_main_text_keeps_short_blocks_beside_long_paragraphs(tag):
    inner = "".join(form.format(text) for _, form, text in BODY)
    page = f"<html><body><nav><a href='/'>Home</a></nav><div class='x'><{tag}>{inner}</{tag.split()[0]}></div><div class='y'><a href='/o'>Other</a></div></body></html>"
    assert html_paths.main_text(page) == " ".join(("term " if name == "dl" else "") + text for name, _, text in BODY)


SIDE = "<div class='sidebar'><p>Side text, with marks, that is here.</p></div><div class='site-footer'><p>All rights, reserved.</p></div>"


@pytest.mark.parametrize(
    "around", ["class='content with-sidebar'", "class='layout-no-sidebar'", "class='post comments-open'", "class='has-banner'", "id='form-page'", "title='the hidden valley'", "class='widget'", "data-x=hidden"]
)
@pytest.mark.parametrize("tag", ["article", "div"])
def test_main_text_is_not_lost_by_a_name(around, tag):
    page = f"<body title='a hidden one'><div {around}><{tag}><div class='article-header'><h1>Title</h1></div><p>{LONG}</p><p>End, it is.</p></{tag}></div>{SIDE}</body>"
    assert html_paths.main_text(page) == f"Title {LONG.strip()} End, it is."


def test_main_text_beside_a_teaser_and_hidden_parts():
    page = f"<body><article class='teaser'><p>Read this, too.</p></article><div class='story'><p>{LONG}</p><p hidden>No, never.</p><p>{LONG}</p></div>{SIDE}</body>"
    text = html_paths.main_text(page)
    assert text.count(LONG.strip()) == 2 and "never" not in text and "Side" not in text and "rights" not in text
    talk = "<section class='comments'><p>" + LONG * 5 + "</p></section>"
    assert html_paths.main_text(f"<body><article><p>{LONG}</p></article>{talk}</body>") == LONG.strip()


PARTS = (
    "comments", "user-comments", "commentList", "comment-thread", "post-comments", "reader_comments", "disqus_thread", "reply-form", "discussion", "article-ads", "ad-slot", "advert-top", "adsense", "sponsored-content",
    "promo-box", "cookie-message", "cookieBanner", "gdpr-info", "consent-layer", "newsletter-signup", "social-media", "share-buttons", "related-posts", "relatedArticles", "recommended-reading", "top-stories",
    "more-news", "most-read", "breadcrumbs", "sidebar", "trending-now", "popup-overlay",
)
STAYS = (
    "content", "post-body", "entry", "article-text", "with-sidebar", "has-ads", "no-comments", "comments-open", "ad-free", "without-banner", "story", "text", "prose", "section-1", "chapter", "lead", "intro", "body-copy",
    "page", "layout-main", "columns", "header-image-text", "download", "shadow", "address", "loading-done", "radio", "badge", "gradient", "cover-story",
)


@pytest.mark.parametrize("tag", ["article", "div class='story'"])
def test_main_text_by_usual_names(tag):
    close = tag.split()[0]
    for name in PARTS:
        inside = f"<{tag}><h1>Title</h1><p>{LONG}</p><div class='{name}'><p>Great post, thanks, I agree!</p></div><p>End, it is.</p></{close}>"
        after = f"<{tag}><h1>Title</h1><p>{LONG}</p><p>End, it is.</p></{close}><div id='{name}'><p>Great post, thanks, I agree!</p></div>"
        for page in (inside, after):
            assert html_paths.main_text(f"<body>{page}</body>") == f"Title {LONG.strip()} End, it is.", name
    for name in STAYS:
        page = f"<{tag}><h1>Title</h1><div class='{name}'><p>A short one, to keep.</p></div><p>{LONG}</p></{close}>"
        assert html_paths.main_text(f"<body>{page}</body>") == f"Title A short one, to keep. {LONG.strip()}", name


def test_main_text_in_a_form_and_in_elements_with_content():
    inner = f"<nav><a href='/'>Home</a></nav><div><h1>Title</h1><p>{LONG}</p><p>Energy <math><mi>E</mi></math> is <object>in</object> <canvas>units</canvas>.</p></div><input name='q'><select><option>One</option></select>"
    for page in (f"<body><form id='aspnetForm'>{inner}</form></body>", f"<body>{inner}<form><p>Your mail, please.</p></form></body>"):
        assert html_paths.main_text(page) == f"Title {LONG.strip()} Energy E is in units."
    for tag in ("noscript", "iframe", "textarea", "xmp", "title", "svg"):
        assert html_paths.main_text(f"<body><article><p>{LONG}</p><div><{tag}></div><p>End, it is.</p></article></body>").endswith("End, it is."), tag


def test_main_text_of_very_long_and_deep_pages():
    import time

    begin, n = time.time(), 100_000
    for page in ("<p " * n, '<a "' * n, "<a '>'" * n + '"', "<title>" * n, "<!--" * n, "</div>" * n, "<tr><td>x" * (n // 4), "&#" + "9" * n + ";", "<p><x><li>" + "<ul>" * (n // 4)):
        html_paths.main_text(page)
    assert html_paths.main_text("<div>" * n + "deep, text.") == "deep, text."
    assert html_paths.main_text("<div class='ad'>" * (n // 4) + "deep, text.") == "deep, text."
    assert html_paths.main_text("<div class='x'>" + f"<p>{LONG}</p>" * 2000 + "</div>").count("Clause") == 14_000
    assert time.time() - begin < 60


def test_main_text_of_given_pages_without_the_article_tag():
    import duckdb

    for (page,) in duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall():
        assert html_paths.main_text(page.replace("<article", "<div").replace("</article", "</div")) == html_paths.main_text(page)


def test_more_entities_than_short_surrogates(spark, monkeypatch):
    made, calls = pii.surrogate, []

    def counted(*args):
        calls.append(1)
        assert len(calls) <= 12, "no end of attempts"
        return made(*args)

    monkeypatch.setattr(pii, "surrogate", counted)
    names = ["".join(x) for x in itertools.product("abdehikmnorst", repeat=4)]
    forms = [("female", x) for x in names[::20]] + [("surname", x) for x in names[::5]] + [("phone", f"1{i:04d}") for i in range(10_000)]
    rows = pii.entities(spark.createDataFrame(forms, "kind string, form string"), "k").collect()
    found = {(r["kind"], r["surrogate"]) for r in rows}
    assert len(rows) == len(found) == len(forms) and not found & set(forms)
    assert all(r["surrogate"][0] == "1" and r["surrogate"].isdigit() for r in rows if r["kind"] == "phone")


def test_longer_and_wider_surrogates(spark):
    tries = spark.createDataFrame([(kind, form, a) for kind, form in [("ip", "8.8.8.8"), ("social", "123456789"), ("male", "bo")] for a in (0, 5, 9)], "kind string, form string, a int")
    got = {(r[0], r[1]): r[2] for r in tries.select("kind", "a", pii.surrogate(F.col("kind"), F.col("form"), F.col("a"), "k")).collect()}
    assert got["ip", 0].startswith("10.") and 240 <= int(got["ip", 5].split(".")[0]) <= 255 and all(256 <= int(x) <= 999 for x in got["ip", 9].split("."))
    assert [len(got["social", a]) for a in (0, 5, 9)] == [9, 11, 15] and [len(got["male", a]) for a in (0, 5, 9)] == [4, 8, 16]
    row = spark.range(1).select(pii.dressed(F.lit("+1 22-33"), F.lit("phone"), F.lit("1456789")), pii.dressed(F.lit("+1 22-33"), F.lit("phone"), F.lit("14567"))).first()
    assert list(row) == ["+1 45-6789", "+1 45-67"]
