import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label int, score double, h string, n int, x double, root string, fp long, key int, b int"
EXTRA = (1, 0.5, "h", 2, 3.0, "r", 4, 5, 6)


def prose(seed: int, words: int, alphabet: str = "abcdefgh") -> str:
    r = random.Random(seed)
    out = []
    for i in range(words):
        w = "".join(r.choice(alphabet) for _ in range(r.randint(2, 7)))
        out.append(w + (r.choice([".\n", ",", "", "", ""])))
    return " ".join(out)


def make_docs(spark, rows):
    """Documents from (doc_id, text, lang, source), with columns whose names clash with those inside operators."""
    return spark.createDataFrame([(i, t, k, s, None if t is None else len(t), *EXTRA) for i, t, k, s in rows], SCHEMA)


#: nulls everywhere, empty and blank texts, no letters, repeats, one very long text, marks beyond ASCII
EDGE = [
    (1, "one two three four five six seven eight nine ten.", "en", "a"),
    (2, None, "en", "a"),
    (3, "", None, None),
    (4, " \t\n ", "de", "a"),
    (None, "a text without an id and some words", "en", "b"),
    (6, "12345 !!! ###", None, "b"),
    (7, "one two three four five six seven eight nine ten.", "en", "a"),
    (7, "one two three four five six seven eight nine ten.", "en", "a"),
    (8, prose(1, 30_000), "en", "c"),
    (9, "x" * 50_000, "en", "c"),
    (10, "straße ñandú 汉字 \U0001f600 ünïcode", "de", None),
    (None, None, None, None),
]


@pytest.fixture(scope="session")
def edge_docs(spark):
    return make_docs(spark, EDGE).repartition(3)


@pytest.fixture(scope="session")
def empty_docs(spark):
    return make_docs(spark, []).limit(0)


@pytest.fixture(scope="session")
def edge_labels(spark):
    rows = [(1, 1, 0), (1, 1, 0), (2, 0, 1), (None, 1, 1), (4, None, None), (6, 0, 0), (7, 1, 0), (8, 1, 1), (99, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
