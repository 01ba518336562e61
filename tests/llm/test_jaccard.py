"""The n-gram Jaccard join against trying all pairs, its trees against plain overlaps, and the defined results."""

import random

import duckdb
import numpy as np
from tests.llm.conftest import EDGE, make_docs, prose
from pyspark.sql import functions as F

from weftline.llm import jaccard


def plain_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def plain_join(rows):
    sets = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(((doc, len(sets[i]), least.get(find(i))) for i, (doc, _) in enumerate(rows)), key=str)


def near_copies(seed, n=300):
    """Texts of many lengths with copies at all distances about the bar, chains, shared passages and short ones."""
    r = random.Random(seed)
    passage = prose(99, 60)
    texts = []
    for i in range(n):
        kind = r.random()
        if texts and kind < 0.6:
            words = r.choice(texts[-40:]).split()
            for _ in range(r.choice([0, 1, 1, 2, 3])):
                if words:
                    words[r.randrange(len(words))] = f"w{r.randrange(10**6)}"
            texts.append(" ".join(words[r.choice([0, 0, 1, 3]) :]))
        elif kind < 0.75:
            texts.append(prose(i, r.randint(1, 40)) + " " + passage + " " + prose(-i, r.randint(1, 40)))
        else:
            texts.append(prose(i, r.choice([1, 2, 4, 5, 6, 12, 40, 90, 200])))
    return [(1000 - i, t) for i, t in enumerate(texts)]


def run(spark, rows):
    docs = make_docs(spark, [(i, t, None, None) for i, t in rows]).withColumns({"row": F.lit(1), "s": F.lit(2), "n": F.lit(3)}).repartition(4)
    return sorted((tuple(x) for x in jaccard.join(docs).collect()), key=str)


def test_each_round_alone_and_split_groups(spark, monkeypatch):
    """Whatever the first rounds find or leave, and however groups are split, the links are the same."""
    rows = near_copies(3, 200)
    want = plain_join(rows)
    assert 50 < len({c for *_, c in want}) < 180
    monkeypatch.setattr(jaccard, "TOGETHER", 3)
    monkeypatch.setattr(jaccard, "BLOCK", 300)
    monkeypatch.setattr(jaccard, "LEAST_COMMON", 4)
    assert run(spark, rows) == want
    monkeypatch.setattr(jaccard, "PATIENCE", 0)
    monkeypatch.setattr(jaccard, "MOST_BROADCAST", 5)
    assert run(spark, rows) == want


def test_edges(spark, empty_docs):
    rows = [(i, t) for i, t, *_ in EDGE] + [(20, "a b"), (21, "A  b"), (22, "b a"), (None, "a B"), (30, "q w e r t"), (31, "Q W E R T"), (32, "É é x"), (33, "é É x"), (None, "only a text without an id")]
    assert run(spark, rows) == plain_join(rows)
    assert jaccard.join(empty_docs).collect() == []
    assert jaccard.join(empty_docs).columns == ["doc_id", "n_shingles", "component_id"]


def test_a_third_in_one_group(spark):
    base = prose(5, 120).split()
    r = random.Random(4)
    rows = [(i, prose(1000 + i, 50)) for i in range(400)]
    for i in range(400, 600):
        w = list(base)
        w[r.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(w)))
    rows += [(i, " ".join(base)) for i in range(600, 900)]
    got = run(spark, rows)
    assert got == plain_join(rows)
    assert sum(c == 400 for *_, c in got) == 500


def test_sql_agrees(spark):
    rows = near_copies(6, 120) + [(None, None), (7, ""), (8, "a b")]
    documents = spark.createDataFrame(rows, "doc_id long, text string").toArrow()  # noqa: F841
    got = duckdb.connect().execute(jaccard.ORACLE).fetchall()
    assert sorted(got, key=str) == plain_join(rows)


def test_common_shingles_are_the_commonest(spark):
    rows = [(i, prose(i, 30) + " " + " ".join(f"c{k}" for k in range(20))) for i in range(50)]
    docs = make_docs(spark, [(i, t, None, None) for i, t in rows]).coalesce(1)
    shared = set(jaccard.shingles(" ".join(f"c{k}" for k in range(20))).tolist())
    assert shared <= set(jaccard.common_shingles(docs).tolist())
    assert len(jaccard.common_shingles(docs, most=10)) <= 10


def test_tree_finds_what_links():
    r = np.random.default_rng(1)
    for _ in range(60):
        base = np.unique(r.integers(0, 60 if _ % 2 else 4000, r.integers(1, 400)))
        sets = []
        for _ in range(25):
            keep = base[r.random(len(base)) > r.choice([0, 0.02, 0.1, 0.3])]
            s = np.unique(np.concatenate([keep, r.integers(0, 5000, r.integers(0, 1 + len(base) // 8))]))
            if len(s):
                sets.append(s)
        near = lambda a, b: 100 * (o := len(np.intersect1d(a, b))) >= 80 * (len(a) + len(b) - o)
        tree = jaccard.PrefixTree(sets)
        for s in sets:
            assert sorted(tree.linked(s)) == [j for j, t in enumerate(sets) if near(s, t)]
        gone = range(0, len(sets), 3)
        for j in gone:
            tree.drop(j)
        for s in sets:
            assert sorted(tree.linked(s)) == [j for j, t in enumerate(sets) if j not in gone and near(s, t)]


def test_forest_spans_without_all_pairs():
    r = np.random.default_rng(2)
    base = np.unique(r.integers(0, 10**6, 300))
    sets = [np.delete(base, r.integers(0, len(base))) for _ in range(200)]
    found = jaccard.forest(sets, list(range(200)))
    assert len(found) == 199
    assert jaccard.forest(sets, [0] * 200) == []


def test_sift_passes_all_that_link():
    r = np.random.default_rng(3)
    passed = total = 0
    for _ in range(40):
        base = np.unique(r.integers(0, 2**61, r.integers(1, 700)))
        sets = []
        for _ in range(20):
            cut = base[r.random(len(base)) > r.choice([0, 0.05, 0.12, 0.3, 0.6])]
            s = np.unique(np.concatenate([cut, r.integers(0, 2**61, r.integers(0, 1 + len(base) // 6))]))
            if len(s):
                sets.append(s)
        sets.sort(key=len)
        comp = r.integers(0, 8, len(sets))
        near = lambda a, b: 100 * (o := len(np.intersect1d(a, b))) >= 80 * (len(a) + len(b) - o)
        keep = jaccard.sift(np.array([len(s) for s in sets]), comp, [np.frombuffer(jaccard.parities(s), np.uint64) for s in sets])
        want = [any(comp[i] != comp[j] and near(s, t) for j, t in enumerate(sets) if i != j) for i, s in enumerate(sets)]
        assert not (np.array(want) & ~keep).any()
        passed, total = passed + int(keep.sum()) - sum(want), total + len(sets)
    assert passed < total / 4
