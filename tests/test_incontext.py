"""Attention over context blocks, batches with samples of their own, sets of rows, estimators side by side, settings of a run."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tests.test_predictor import chain_task, signal_task, task_on

from weftline import incontext
from weftline.catalog import Edge, Rel
from weftline.incontext import AttentionBackbone
from weftline.models import BayesBackbone, extract, reduce_estimators
from weftline.operators import sampling
from weftline.operators.pooling import interleave, merge_estimators, sign_matrix
from weftline.plans import predictor
from weftline.plans.predictor import Settings


def dense(x, y, q, bandwidth):
    """All scores at once."""
    mean, sd = np.nanmean(x, 0), np.nanstd(x, 0)
    z = lambda a: np.nan_to_num((a - mean) / sd)
    score = -((z(q)[:, None] - z(x)[None]) ** 2).sum(2) / 2 / bandwidth**2
    w = np.exp(score - score.max(1, keepdims=True))
    w /= w.sum(1, keepdims=True)
    return w @ y


@pytest.mark.parametrize("rows", [(7, 5), (4096, 16_384)])
def test_attention_by_blocks_equals_all_at_once(spark, rows):
    r = np.random.default_rng(1)
    x, q = r.normal(0, 3, (60, 3)), r.normal(0, 3, (33, 3)) * 40  # some far from all context
    x[3, 1] = q[5, 2] = np.nan
    y = r.integers(0, 3, 60)
    frame = lambda a, t: spark.createDataFrame([(i, *map(float, v), None if k is None else int(k)) for i, (v, k) in enumerate(zip(a, t))], "i long, a double, b double, c double, y long")
    train = frame(x, y).withColumn("same", F.lit(2.0)).unionByName(frame([[9.0, 9, 9]], [None]).withColumn("same", F.lit(2.0)))
    test = frame(q, [None] * 33).withColumn("same", F.lit(2.0))
    names = ["a", "b", "c", "same"]
    got = AttentionBackbone(block_rows=rows[0], portion_rows=rows[1]).predict(train, test, names, "y").orderBy("i").collect()
    want = dense(x, np.eye(3)[y], q, 0.5)
    np.testing.assert_allclose([g.proba for g in got], want, atol=1e-9)
    assert [g.y_pred for g in got] == want.argmax(1).tolist()
    got = AttentionBackbone(True, 2.0, *rows).predict(train, test, names, "y").orderBy("i").collect()
    np.testing.assert_allclose([g.y_pred for g in got], dense(x, y, q, 2.0), atol=1e-9)


def test_attention_within_batches_and_without_context(spark):
    train = spark.createDataFrame([(0, 1.0, 0), (0, 2.0, 1), (1, 1.0, 1), (2, 5.0, None)], "b int, x double, y int")
    test = spark.createDataFrame([(0, 1.0), (1, 1.0), (2, 1.0), (None, 1.0)], "b int, x double")
    got = {g.b: g for g in AttentionBackbone(bandwidth=0.1).predict(train, test, ["x"], "y", batch="b").collect()}
    assert (got[0].y_pred, got[1].y_pred, got[2].proba, got[None].y_pred) == (0, 1, None, None)
    none = AttentionBackbone().predict(train.limit(0), test, ["x"], "y").collect()
    assert len(none) == 4 and all(g.proba is None and g.y_pred is None for g in none)
    assert AttentionBackbone().predict(train, test.limit(0), ["x"], "y").collect() == []


class Counted(AttentionBackbone):
    """Keeps how many keys, queries and points meet."""

    def meet(self, keys, queries, points, sums):
        self.met = keys.count(), queries.count(), len(points)
        return super().meet(keys, queries, points, sums)


def test_equal_rows_meet_once(spark):
    train = spark.range(4000).select((F.col("id") % 5).cast("double").alias("a"), F.when(F.col("id") % 2 == 0, 1.5).alias("b"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    test = spark.range(3000).select("id", (F.col("id") % 3).cast("double").alias("a"), F.lit(1.5).alias("b"))
    backbone = Counted(block_rows=1, portion_rows=2)
    out = backbone.predict(train, test, ["a"], "y")
    assert backbone.met == (5, 3, 1)
    got = out.orderBy("id").collect()
    assert [g.id for g in got] == list(range(3000))
    a = np.arange(4000)
    np.testing.assert_allclose([g.proba for g in got], dense(a[:, None] % 5.0, np.eye(2)[(a % 3 == 0).astype(int)], np.arange(3000)[:, None] % 3.0, 0.5), atol=1e-9)


@pytest.mark.parametrize("regression, bandwidth, far, whole, cut", [(False, 0.5, 40, 1, 1), (True, 0.5, 1, 1, 1), (True, 4.0, 2, 0, 2)])
def test_attention_through_a_lattice_equals_all_at_once(spark, regression, bandwidth, far, whole, cut):
    """One or two features without equal values, beside one of three values; rows to predict lie far from all context too."""
    r = np.random.default_rng(3)
    x, q = r.normal(0, 3, (3000, 3)), r.normal(0, 3, (2000, 3))
    x[:, 2], q[:, 2] = r.integers(0, 3, 3000), r.integers(0, 4, 2000)
    x[:, 1] = r.integers(0, 2, 3000) if whole else x[:, 1]
    q[:, 1] = r.integers(0, 2, 2000) if whole else q[:, 1]
    x[7], q[:5, 0] = [30, 1, 9], [3 * far, -4 * far, 5 * far, np.nan, 30]
    y = r.normal(0, 5, 3000) if regression else r.integers(0, 3, 3000) + 5
    kind = "double" if regression else "long"
    train = spark.createDataFrame([(*map(float, v), float(k) if regression else int(k)) for v, k in zip(x, y)], f"a double, b double, c double, y {kind}")
    test = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(q)], "id long, a double, b double, c double")
    backbone = Counted(regression, bandwidth, block_rows=3, portion_rows=500, direct=0)
    got = backbone.predict(train, test, ["a", "b", "c"], "y").orderBy("id").collect()
    keys, queries, points = backbone.met
    assert points > 20**cut and keys * queries * points < len(x) * len(q) / 4
    mean, sd = x.mean(0), x.std(0)
    q = np.where(np.isnan(q), mean, q)
    want = dense(x, y if regression else np.eye(3)[y - 5], q, bandwidth)
    np.testing.assert_allclose([g.y_pred if regression else g.proba for g in got], want, rtol=1e-9, atol=1e-11)
    if not regression:
        assert [g.y_pred for g in got] == (want.argmax(1) + 5).tolist()


@pytest.mark.parametrize("scores", [1, 12, 1000])
def test_runs_of_keys_are_one_sum_however_they_are_cut(monkeypatch, scores):
    monkeypatch.setattr(incontext, "SCORES", scores)
    r = np.random.default_rng(8)
    names, d, l, v = ["a"] * 9 + [None] * 8, np.repeat([1.0, 2, 2], [4, 8, 5])[:, None], r.normal(0, 30, (17, 1)), r.random((17, 2))
    t = pa.record_batch({"batch": pa.array(names, pa.string()), "d": incontext.arrays(d), "l": incontext.arrays(l), "v": incontext.arrays(v)})
    points = np.linspace(-40, 40, 6)[:, None]
    got = pa.Table.from_batches(incontext.summed_at_points(iter([t.slice(0, 6), t.slice(6, 0), t.slice(6)]), points, 0.5))
    assert got.column("batch").to_pylist() == ["a", "a", None] and incontext.matrix(got, "d").ravel().tolist() == [1, 2, 2]
    for i, run in enumerate((slice(0, 4), slice(4, 9), slice(9, 17))):
        score = -((l[run] - points.T) ** 2) / 0.25
        np.testing.assert_allclose(incontext.matrix(got, "top")[i], score.max(0))
        np.testing.assert_allclose(incontext.matrix(got, "v")[i].reshape(6, 2), np.exp(score - score.max(0)).T @ v[run])


def test_a_lattice_lies_where_rows_are():
    """Every pair finds the points that its weight needs, and an outlier adds few."""
    r = np.random.default_rng(6)
    k, q = (np.append(r.normal(0, 3, 40), far) for far in ([900.0], [-50.0, 899.0]))
    side = incontext.lattice_side(*([int(i) for i in np.unique(np.floor(x / 0.4))] for x in (k, q))) * 0.4
    assert len(side) < 300 < 950 / 2 / 0.4
    score = np.add.outer(np.subtract.outer(k, side) ** 2, np.zeros(len(q))).transpose(0, 2, 1) + np.subtract.outer(q, side) ** 2
    own = np.subtract.outer(k, q) ** 2 / 2
    sums = np.exp(own[..., None] - score).sum(2)  # with a bandwidth of 1: the same for all pairs
    np.testing.assert_allclose(sums, np.sqrt(np.pi / 2) / 0.4, rtol=1e-9)


def test_batches_through_a_lattice(spark):
    """A batch's rows attend to its own context; one without context, or none, gets nulls; many rows agree in all but what is cut."""
    rows = lambda n, of: spark.range(n).select(of.alias("b"), F.sin(F.col("id") * 1.7).alias("a"), (F.col("id") % 7 % 2).cast("int").alias("y"), "id")
    train, test = rows(6000, (F.col("id") % 2).cast("int")), rows(4000, F.when(F.col("id") % 4 < 3, (F.col("id") % 4).cast("int")))
    one, all_ = Counted(direct=0), Counted()
    made = [{g.id: g.proba for g in x.predict(train, test.drop("y"), ["a"], "y", batch="b").collect()} for x in (one, all_)]
    assert one.met[2] > 1 == all_.met[2] and len(made[0]) == 4000
    for i, p in made[1].items():
        assert (p is None) == (made[0][i] is None) == (i % 4 > 1)
        if p:
            np.testing.assert_allclose(made[0][i], p, rtol=1e-9)


def accuracy(out):
    return out.agg(F.avg((F.col("y_pred") == F.col("label")).cast("int"))).first()[0]


def test_depth_is_solved_in_context(spark):
    """A label three references away, by attention."""
    assert accuracy(predictor.predict(chain_task(spark), Settings(), AttentionBackbone())) > 0.95


def test_batches_and_estimators_solve_what_one_does(spark):
    task = signal_task(spark, "signed")
    s = Settings(estimators=3, dim=8, batch_rows=60, train_rows=200)
    assert accuracy(predictor.predict(task, s, AttentionBackbone(bandwidth=1.0))) > 0.8
    assert accuracy(predictor.predict(task, Settings(estimators=2, dim=8, reduce="gaussian_random_projection", reduce_apart=True, batch_rows=100), BayesBackbone())) > 0.8


def test_one_batch_at_a_time_equals_all_at_once(spark):
    task = chain_task(spark)
    s = Settings(batch_rows=40, train_rows=150)

    class Plain(AttentionBackbone):
        def predict(self, train, test, features, target):
            return super().predict(train, test, features, target)

    key = lambda out: {r["__task_id"]: round(r.proba[1], 9) for r in out.collect()}
    one, all_ = key(predictor.predict(task, s, Plain())), key(predictor.predict(task, s, AttentionBackbone()))
    assert len(one) == 150 and one.keys() == all_.keys()
    # standardised by each batch's sample or by all samples together: near, not equal
    assert np.mean([(one[k] > 0.5) == (all_[k] > 0.5) for k in one]) > 0.95


@pytest.mark.parametrize("size, fraction, restrict, inner", [(40, 0.3, True, False), (40, 0.3, True, True), (12, 0.9, True, True), (40, 0.0, True, True), (40, 0.3, False, False), (900, 0.2, True, True), (4, 1.0, True, False)])
def test_batch_samples_equal_separate_ones(spark, size, fraction, restrict, inner):
    r = np.random.default_rng(4)
    train = spark.createDataFrame([(i, None if i % 50 == 0 else int(r.integers(0, 30)), float(r.integers(0, 400))) for i in range(400)], "id long, k long, score double")
    test = spark.createDataFrame([(i, i // 20, None if i % 17 == 0 else int(r.integers(0, 34))) for i in range(60)], "id long, b long, k long")
    got: dict = {}
    for x in sampling.batch_samples(train, test, "b", "k", "id", "score", size, fraction, restrict, inner).collect():
        got.setdefault(x.b, []).append(x.id)
    for b in range(3):
        want = sampling.train_sample(train, test.where(F.col("b") == b), "k", "id", "score", size, fraction, restrict, inner)
        assert sorted(got.get(b, [])) == sorted(x.id for x in want.collect()), b


def test_top_per_group_by_ranges(spark):
    r = np.random.default_rng(5)
    rows = [(i, "ab"[i % 2] if i % 9 else None, float(r.integers(0, 40))) for i in range(700)]
    df = spark.createDataFrame(rows, "id long, g string, s double")
    k = F.when(F.col("g") == "a", 17).otherwise(300)
    got: dict = {}
    for x in sampling.top_per_group(df, "g", "s", k, "id", bins=8).collect():
        got.setdefault(x.g, set()).add(x.id)
    for g in ("a", "b", None):
        want = sorted((x for x in rows if x[1] == g), key=lambda x: (-x[2], x[0]))[: 17 if g == "a" else 300]
        assert got[g] == {x[0] for x in want}


def test_sets_of_rows_count_once(spark):
    links = [("a", "1", i) for i in (1, 2, 3)] + [("b", "x", i) for i in (3, 2, 1, 1)] + [("a", "2", i) for i in (4, 5, 6, 7)] + [("b", "y", i) for i in (1, 2)] + [("c", None, i) for i in (4, 5, 6, 7)]
    df = spark.createDataFrame(links, "e string, k string, row long")
    assert sorted(tuple(x) for x in sampling.row_sets(df, ["e", "k"], "row").collect()) == [("a", "1"), ("a", "2"), ("b", "y")]
    got = sampling.context_sample(df, ["e", "k"], "row", F.col("row"), 6).collect()
    assert sorted(x.row for x in got) == [1, 2, 4, 5]  # three sets, two rows each
    assert sampling.context_sample(df, ["e", "k"], "row", F.col("row"), 7).count() == 7


def test_estimators_lie_side_by_side(spark):
    df = spark.createDataFrame([(i, float(i), float(i * i % 7)) for i in range(20)], "i long, a double, b double")
    both = {x.i: x.emb for x in extract(df, ["a", "b"], 3, ["i"], estimators=2).collect()}
    one, two = ({x.i: x.emb for x in extract(df, ["a", "b"], 3, ["i"], seed).collect()} for seed in (1, 2))
    assert all(both[i] == one[i] + two[i] for i in both) and sign_matrix(3, 2, 1) != sign_matrix(3, 2, 2)
    rows = spark.createDataFrame([(i, e, v) for i in both for e, v in ((0, one[i]), (1, two[i]))], "i long, e int, x array<double>")
    merged = {x.i: x.emb for x in merge_estimators(rows, "i", "e", "x").collect()}
    wide = spark.createDataFrame([(i, v) for i, v in both.items()], "i long, emb array<double>")
    assert {x.i: x.m for x in wide.select("i", interleave(F.col("emb"), 2, 3).alias("m")).collect()} == merged
    apart = {x.i: x.emb for x in reduce_estimators(wide, "emb", 2, 3, "first_k", 2, apart=True).collect()}
    assert all(apart[i] == one[i][:2] + two[i][:2] for i in apart)
    joint = {x.i: x.emb for x in reduce_estimators(wide, "emb", 2, 3, "first_k", 3).collect()}
    assert all(joint[i] == merged[i][:3] for i in joint)


def test_logarithms_of_targets(spark):
    made = [("train" if i % 3 else "test", 0) for i in range(300)]
    size = Rel("size", spark.createDataFrame([(i, i, float(i % 10)) for i in range(300)], "sid long, entity_id long, x double"), ("sid",))
    task = task_on(spark, {"size": size}, (Edge("size", "entity_id", "entities", "entity_id"),), made)
    rel = task.db.tables[task.table]
    rows = rel.df.withColumn("label", F.expm1(F.lit(0.5) * (F.col("entity_id") % 10)))
    task = type(task)(task.db.replace(rel.with_df(rows)), task.table, task.entity_col, task.time_col, task.target_col, "regression")
    error = lambda s: predictor.predict(task, s).agg(F.max(F.abs(F.col("y_pred") - F.col("label")) / (1 + F.col("label")))).first()[0]
    assert error(Settings(log_target=True, activation=None)) < 0.2 < error(Settings(activation=None))


def test_shortest_paths_alone(spark):
    """A reference between two tables as far from the task pools nothing if only shortest paths do."""
    made = [("train" if i % 3 else "test", i % 2) for i in range(60)]
    a = Rel("a", spark.createDataFrame([(i, i) for i in range(60)], "aid long, entity_id long"), ("aid",))
    b = Rel("b", spark.createDataFrame([(i, i, i) for i in range(60)], "bid long, entity_id long, aid long"), ("bid",))
    task = task_on(spark, {"a": a, "b": b}, (Edge("a", "entity_id", "entities", "entity_id"), Edge("b", "entity_id", "entities", "entity_id"), Edge("b", "aid", "a", "aid")), made)
    from weftline.plans.graph import inference_dag

    assert len(inference_dag(task.db, task.table)) == len(inference_dag(task.db, task.table, True)) + 1
    assert predictor.predict(task, Settings(shortest_paths=True), BayesBackbone()).count() == 20
