import random

import pytest

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, copies int, _size int, n_email string"


@pytest.fixture(scope="session", autouse=True)
def folder(spark, tmp_path_factory):
    spark.conf.set("spark.barloom.workdir", str(tmp_path_factory.mktemp("llm")))


def odd_rows():
    """Nulls, empty and long texts, ties, repeated rows, extra columns with names that operators use inside."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghijk") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    shared, long = say(120), "\n".join(say(25) for _ in range(800))
    texts = [None, "", "   \n\t ", "one", "two words", "x" * 900, "x" * 401, "ab" * 700, long, long, long[:5000] + " changed " + long[5000:]]
    texts += [say(60) + "\n" + shared + "\n" + say(40) for _ in range(6)] + ["Ünïcode " * 100, "día " + say(200), "día " + say(10)]
    base = say(150).split(" ")
    for i in range(8):
        near = list(base)
        near[i * 17] = "CHANGED"
        texts.append(" ".join(near))
    texts += ["line a\nline b\nline c\nline d", "line z\nline b\nline c\nline d\nline e", "line b\nline c\nline d", "line q\n\nline b\n"]
    rows = [(i, t, [None, "en", "de"][i % 3], ["s1", "s2", None][i % 3], len(t or ""), "k", 1, 2, "n") for i, t in enumerate(texts)]
    rows += [rows[12], rows[12], rows[3], (None, "no id here", "en", "s1", None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")
