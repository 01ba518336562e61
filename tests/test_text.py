"""Min-hashes of names, latent vectors of texts and their cache, keys found level by level, hot keys in counts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.test_predictor import task_on

from weftline import models, text
from weftline.catalog import Edge, Rel
from weftline.incontext import AttentionBackbone
from weftline.operators import algebra, counts
from weftline.plans import predictor
from weftline.plans.predictor import Settings
from weftline.session import scratch_path


def test_min_hash_agrees_as_often_as_grams_do(spark):
    pairs = [("Karlsruhe", "karlsruhe"), ("international business", "internationl business"), ("abc", "xyz"), ("", ""), (None, "a")]
    df = spark.createDataFrame(pairs, "a string, b string")
    rows = df.select("a", "b", F.array(*text.min_hash(F.col("a"), 64)).alias("x"), F.array(*text.min_hash(F.col("b"), 64)).alias("y")).collect()
    grams = lambda s: {f"^{s.lower()}$"[i : i + 3] for i in range(max(1, len(s)))}
    for r in rows:
        if r.a is None:
            assert r.x == [None] * 64
            continue
        want = len(grams(r.a) & grams(r.b)) / len(grams(r.a) | grams(r.b))
        assert abs(np.mean(np.array(r.x) == np.array(r.y)) - want) < 0.2
        assert all(0 < v < 1 for v in r.x)


def test_similar_names_alone_tell_the_label(spark):
    """Every name occurs once, so no level helps; names of one label are variants of one stem."""
    r = random.Random(3)
    made = [("train" if i % 4 else "test", i % 2) for i in range(400)]
    stems = ("quarterly statement", "holiday photograph")
    name = lambda y: "".join(c for c in stems[y] if r.random() > 0.06) + " " + "".join(r.choice("xyz") for _ in range(4))
    rows = [(i, i, name(y)) for i, (_, y) in enumerate(made)]
    notes = Rel("notes", spark.createDataFrame(rows, "nid long, entity_id long, name string"), ("nid",))
    task = task_on(spark, {"notes": notes}, (Edge("notes", "entity_id", "entities", "entity_id"),), made)
    right = lambda s: predictor.predict(task, s, AttentionBackbone(bandwidth=1.0)).agg(F.avg((F.col("y_pred") == F.col("label")).cast("int"))).first()[0]
    assert right(Settings(min_hashes=8, dim=32)) > 0.9
    assert right(Settings(min_hashes=0, dim=32)) < 0.75


def test_few_levels_need_no_min_hashes(spark):
    df = spark.createDataFrame([(f"n{i}", "ab"[i % 2], float(i)) for i in range(30)], "many string, few string, x double")
    names = models.Vectorizer(levels=4, min_hashes=2).fit(df).transform(df).columns
    assert [c for c in names if "__mh_" in c] == ["many__mh_0", "many__mh_1"]


def test_latent_vectors_span_the_exact_space(spark):
    r = random.Random(4)
    topics = [[f"w{k}_{i}" for i in range(30)] for k in range(4)]
    texts = sorted({" ".join(r.choices(topics[i % 4], k=25) + [f"rare{i}"]) for i in range(200)})
    df = spark.createDataFrame([(t,) for t in [*texts, *texts[:50]]] + [(None,), ("",)], "t string")
    got = {x.text: x.vector for x in text.TextVectors(4).vectors(df, "t").collect()}
    assert got.keys() == {*texts, ""} and got[""] == [0.0] * 4
    words = sorted({w for t in texts for w in t.split()})
    tf = np.array([[t.split().count(w) for w in words] for t in texts], float)
    a = tf * (np.log((len(texts) + 1) / (tf > 0).sum(0)) + 1)
    u, s, _ = np.linalg.svd(a, full_matrices=False)
    exact = u[:, :4] * s[:4]
    found = np.array([got[t] for t in texts])
    np.testing.assert_allclose(found @ found.T, exact @ exact.T, atol=2e-2 * s[0] ** 2 / len(texts) * 4)
    cosines = np.linalg.svd(np.linalg.qr(found)[0].T @ u[:, :4], compute_uv=False)
    assert cosines.min() > 0.999


def test_vectors_are_kept_from_run_to_run(spark):
    folder = scratch_path(spark, "vectors")
    df = spark.createDataFrame([("a b c",), ("b c d",), ("a d",), ("a b c",)], "t string")
    first = text.TextVectors(2, folder=folder)
    one = sorted(first.transform(df, "t").collect(), key=str)
    again = text.TextVectors(2, folder=folder)
    two = sorted(again.transform(df, "t").collect(), key=str)
    assert (first.computed, again.computed) == (3, 0) and one == two
    more = spark.createDataFrame([("a b c",), ("d c b",), ("zzz",), (None,)], "t string")
    later = text.TextVectors(2, folder=folder)
    three = {x.t: x for x in later.transform(more, "t").collect()}
    assert later.computed == 2 and three["a b c"] in one and tuple(three["zzz"])[1:] == (0, 0) and three[None].t__svd_0 is None
    same = next(x for x in one if x.t == "b c d")
    np.testing.assert_allclose([three["d c b"].t__svd_0, three["d c b"].t__svd_1], [same.t__svd_0, same.t__svd_1], atol=1e-6)


def test_more_dimensions_than_texts(spark):
    df = spark.createDataFrame([("a b",), ("b c",)], "t string")
    got = [x.vector for x in text.TextVectors(5).vectors(df, "t").collect()]
    assert all(len(v) == 5 and np.allclose(v[2:], 0) for v in got)
    assert text.TextVectors(5).vectors(df.limit(0), "t").collect() == []


def test_keys_level_by_level(spark):
    rows = [(i, i % 10, i // 10, i % 3, None if i % 2 else i) for i in range(200)] + [(None, None, None, None, None)]
    df = spark.createDataFrame(rows, "id long, a long, b long, c long, half long")
    assert sorted(map(tuple, algebra.discover_keys(df, df.columns, 3).collect())) == [("a,b", 200), ("half", 100), ("id", 200)]
    assert sorted(map(tuple, algebra.discover_keys(df, ["a", "c"], 2).collect())) == []
    both = spark.createDataFrame([(i % 4, i // 4 % 4, i // 16) for i in range(64)], "a int, b int, c int")
    assert [tuple(x) for x in algebra.discover_keys(both, ["a", "b", "c"], 3).collect()] == [("a,b,c", 64)]


@pytest.mark.parametrize("most", [3, 10**6])
def test_hot_keys_are_counted_apart(spark, most):
    r = random.Random(5)
    one = spark.createDataFrame([(i, r.choice([1, 1, 2, 3, None]), f"2020-01-{r.randint(1, 28):02d}") for i in range(60)] + [(99, 1, None)], "i long, k long, t string").withColumn("t", F.to_timestamp_ntz("t"))
    many = spark.createDataFrame([(r.choice([1, 1, 1, 2, None]), f"2020-01-{r.randint(1, 28):02d}") for _ in range(80)] + [(3, "2020-01-01"), (1, None)], "k long, t string").withColumn("t", F.to_timestamp_ntz("t"))
    got = {x.i: (x.n, x.n__7d) for x in counts.counts_as_of(one, "k", F.col("t"), many, "k", F.col("t"), "n", (7,), most).collect()}
    hits = [(x.k, x.t) for x in many.collect()]
    for x in one.collect():
        ages = [(x.t - t).days for k, t in hits if None not in (k, t, x.t) and k == x.k and t <= x.t]
        assert got[x.i] == (len(ages), sum(a < 7 for a in ages))
