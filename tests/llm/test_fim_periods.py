"""Fill-in-the-middle and runs: round trips, brute force, linear work, and the defined results."""

import hashlib
import random
import re
import zlib

import duckdb
import pytest
from tests.llm.conftest import EDGE, make_docs, prose
from pyspark.sql import functions as F

from weftline.llm import fim, periods

GRAMMARS = {
    "lines": r"[^\n]*\n|[^\n]+",
    "words": r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+",
    "words_first": r"[^\x20\x09-\x0D]*[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+",
    "runs": r"[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+",
    "code_points": r"[\s\S]",
}
TEXTS = ["", "\n", "\n\n", "a", "a\nb", "a\n\nb\n", " a  b ", "\r\na\r\n", "x\ty\x0bz\n", "\U0001f600\U0001f601 é\n汉字", "ab. Cd! e? f", "<P\n>x", "<<S\n>", " a\u0085b\n"]


@pytest.mark.parametrize("unit", GRAMMARS)
def test_boundaries_equal_the_grammar(spark, unit):
    r = random.Random(1)
    texts = TEXTS + ["".join(r.choice("ab \n\t\r\U0001f600é.") for _ in range(r.randint(0, 30))) for _ in range(200)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", fim.units(F.col("text"), unit).alias("u")).collect()
    for x in rows:
        assert x.u == re.findall(GRAMMARS[unit], x.text), repr(x.text)


@pytest.mark.parametrize("unit", fim.UNITS)
def test_round_trip_in_any_unit(spark, unit):
    docs = make_docs(spark, [(i, t, "en", "a") for i, t in enumerate(TEXTS + [prose(i, 60) for i in range(40)])])
    rows = fim.transform(docs, unit).select("doc_id", "text", "fim.*", fim.restore(F.col("fim.output"), F.col("fim.form")).alias("back")).collect()
    assert len(rows) == len(TEXTS) + 40
    for x in rows:
        assert x.back == x.text
        assert len(x.output) == len(x.text) + (0 if x.form == "plain" else 9)
    assert {x.form for x in rows} == {"plain", "psm", "spm"}


def test_sentinels_nulls_and_shares(spark):
    docs = make_docs(spark, [(i, f"line {i}\n" * 5, "en", "a") for i in range(400)] + [(1001, "a <S> b", "en", "a"), (1002, None, "en", "a"), (1003, "", "en", "a"), (None, "x\ny", None, None)])
    rows = {x.doc_id: x.fim for x in fim.transform(docs, rate=50, spm=20).collect()}
    assert [rows[i].form for i in (1001, 1002, 1003)] == ["plain"] * 3 and rows[1002].output == "" and rows[1002].n == 0 and rows[1001].prefix_chars is None
    forms = [rows[i].form for i in range(400)]
    assert 150 < forms.count("plain") < 250 and 20 < forms.count("spm") < 70
    assert set(fim.transform(docs).columns) == {*docs.columns, "fim"}


def test_fim_sql_on_edges(spark, edge_docs, empty_docs):
    c = duckdb.connect()
    documents = edge_docs.select("doc_id", "text").toArrow()  # noqa: F841
    ran = c.execute(fim.ORACLE)
    names = [d[0] for d in ran.description]
    got = fim.digests(edge_docs.withColumn("fim", F.lit(1)).withColumn("__fim", F.lit(2)))
    assert sorted(map(str, ran.fetchall())) == sorted(str(tuple(r[n] for n in names)) for r in got.collect())
    assert fim.digests(empty_docs).collect() == []


def plain_runs(a, count=2, least=2):
    """All runs by trying all periods; of equal stretches the smallest period."""
    out = {}
    for p in range(1, len(a) // 2 + 1):
        i = 0
        while i + p < len(a):
            if a[i] != a[i + p]:
                i += 1
                continue
            start = i
            while i + p < len(a) and a[i] == a[i + p]:
                i += 1
            if i + p - start >= 2 * p:
                out.setdefault((start, i + p - start), p)
    return sorted(((s, n, p) for (s, n), p in out.items() if n >= max(least, count * p)), key=lambda r: (r[0], r[2]))


def plain_lyndon(a):
    ends = [tuple(a[i:]) for i in range(len(a) + 1)]
    after = [next((j for j in range(i + 1, len(a) + 1) if ends[j] < ends[i]), len(a)) for i in range(len(a))]
    agree = [next((k for k in range(len(a)) if j + k >= len(a) or a[i + k] != a[j + k]), 0) for i, j in enumerate(after)]
    return after, agree


def periodic_lists(seed, n, longest=40):
    r = random.Random(seed)
    for _ in range(n):
        a = [r.randrange(r.choice([1, 2, 2, 3, 4])) for _ in range(r.randint(0, longest))]
        if len(a) > 3 and r.random() < 0.6:
            p, start = r.randint(1, len(a) // 3), r.randrange(len(a))
            for i in range(start + p, len(a)):
                a[i] = a[i - p]
            a[r.randrange(len(a))] = r.randrange(3)
        yield a


def test_lyndon_arrays_and_runs_by_brute_force():
    for a in periodic_lists(5, 3000):
        for x in (a, [-v for v in a]):
            assert periods.lyndon(x) == plain_lyndon(x)
        assert periods.runs(a) == plain_runs(a)
        words = [b"%d" % x for x in a]
        assert periods.text_runs(words) == plain_runs(a, 4, 6) and periods.text_runs(words, 2, 2) == plain_runs(a)


class Counted(int):
    """A symbol that counts its comparisons."""

    compared = 0

    def __eq__(self, other):
        Counted.compared += 1
        return int(self) == int(other)

    def __lt__(self, other):
        Counted.compared += 1
        return int(self) < int(other)

    __hash__ = int.__hash__


def test_comparisons_are_linear():
    n = 20_000
    fib, g = [0], [0, 1]
    while len(g) < n:
        fib, g = g, g + fib
    r = random.Random(2)
    kinds = [[0] * n, [0, 1] * (n // 2), ([0] * 99 + [1]) * (n // 100), g, [bin(i).count("1") % 2 for i in range(n)], ([0, 1] * 50 + [2]) * (n // 101), [r.randrange(2) for _ in range(n)], [r.randrange(9) for _ in range(500)] * (n // 500)]
    for a in kinds:
        for sign in (1, -1):
            Counted.compared = 0
            periods.lyndon([Counted(sign * x) for x in a])
            assert Counted.compared < 8 * len(a)


def test_deeply_nested_rare_words_stay_exact():
    a = [x for k in range(60) for x in (*[k] * 3, k + 1, *[k] * 5)]
    was = periods.ROUNDS
    try:
        for periods.ROUNDS in (0, 1, was):
            assert periods.text_runs([b"%d" % x for x in a]) == plain_runs(a, 4, 6)
    finally:
        periods.ROUNDS = was


def plain_digest(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words, 4, 6)
    most = max(found, key=lambda r: (r[1], -r[0], -r[2])) if found else (None,) * 3
    gone = {i for s, k, p in found for i in range(s + p, s + k)}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    lines = "".join(f"{s},{k},{p}\n" for s, k, p in found)
    return (doc_id, len(found), *most, 1000 * most[1] // most[2] if found else None, sha(lines.encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_against_brute_force(spark, edge_docs, empty_docs):
    rows = [(i, prose(i, 40 + i % 90, "ab") if i % 3 else "so it is " * (i % 40), "en", "a") for i in range(600)]
    rows += [x for x in EDGE if len(x[1] or "") < 60_000] + [(10**17 + i, "one two three four five six seven\n" * 4, None, None) for i in range(60)]
    docs = make_docs(spark, rows).withColumn("__words", F.lit(1)).withColumn("__plan", F.lit(2)).withColumn("periodic", F.lit(3))
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = periods.digests(docs)
    assert got.columns == names
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(str(plain_digest(i, t)) for i, t, *_ in rows)
    assert periods.digests(empty_docs).collect() == []


def test_collapse_keeps_columns_and_texts(spark):
    docs = make_docs(spark, [(1, "a b a b a b a b c", "en", "a"), (2, None, None, None), (3, "", None, None), (4, "x " * 9, None, None)])
    rows = {x.doc_id: x for x in periods.collapse(docs).collect()}
    assert rows[1].periodic.kept == "a b c" and [tuple(r) for r in rows[1].periodic.runs] == [(0, 8, 2)] and rows[1].h == "h"
    assert rows[4].periodic.kept == "x" and rows[2].periodic.kept == rows[3].periodic.kept == "" and rows[2].periodic.runs == []


def test_periods_sql_by_brute_force():
    rows = [(i, prose(i, 40 + i % 90, "ab") if i % 3 else "so it is " * (i % 40)) for i in range(200)] + [(i, t) for i, t, *_ in EDGE if len(t or "") < 60_000]
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert sorted(map(str, c.execute(periods.ORACLE).fetchall())) == sorted(str(plain_digest(i, t)) for i, t in rows)
