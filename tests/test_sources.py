"""Older formats, studies, plans and rewrites as one call, and helpers without a query."""

import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline import models
from weftline.catalog import Database, Edge, Rel
from weftline.functions.scalar import log_target
from weftline.operators import algebra, metrics, sampling, studies
from weftline.plans import rewrite
from weftline.session import scratch_path
from weftline.sources import files


def test_flow_lines(spark):
    path = scratch_path(spark, "yaml")
    lines = [
        "{name: rel-f1, id: 'a ''b'', c', event: prediction, key: 3, y_true: 1.0, y_pred: 0.5, proba: [0.25, 0.75], ok: true}",
        '{name: "x, y: z", id: null, event: prediction, key: -4, y_true: 1e-3, y_pred: .nan, proba: [1.0, 0.0]}',
        "  {event: other}  ",
        "",
    ]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    got = files.read_flow_lines(spark, path, "name string, id string, event string, key bigint, y_true double, y_pred double, proba array<double>, ok boolean").collect()
    assert [tuple(x)[:5] for x in got] == [("rel-f1", "a 'b', c", "prediction", 3, 1.0), ("x, y: z", None, "prediction", -4, 1e-3), (None, None, "other", None, None)]
    assert got[0].proba == [0.25, 0.75] and got[0].ok and np.isnan(got[1].y_pred) and got[2].proba is None
    with pytest.raises(ValueError):
        files.read_legacy_predictions(spark, path)
    again = scratch_path(spark, "yaml")
    rows = spark.createDataFrame([("n", 1, 0.5)], "name string, key long, y double")
    files.write_flow_lines(rows, again)
    assert files.read_flow_lines(spark, again, "name string, key bigint, y double").collect() == rows.collect()


def test_studies_in_sqlite(spark, tmp_path):
    paths = []
    for k in range(2):
        paths.append(f"{tmp_path}/study{k}.db")
        with sqlite3.connect(paths[-1]) as db:
            db.execute("CREATE TABLE studies (study_id INTEGER, study_name TEXT)")
            db.execute("CREATE TABLE trials (trial_id INTEGER, number INTEGER, study_id INTEGER, state TEXT, datetime_start TEXT, datetime_complete TEXT)")
            db.execute("CREATE TABLE trial_values (trial_id INTEGER, objective INTEGER, value REAL)")
            db.executemany("INSERT INTO studies VALUES (?, ?)", [(1, "a'b"), (2, "other")])
            db.executemany("INSERT INTO trials VALUES (?, ?, ?, ?, ?, ?)", [(10, 0, 1, "COMPLETE", "2024-01-01 00:00:00.5", "2024-01-01 00:01:00"), (11, 1, 1, "RUNNING", "2024-01-01 00:00:00", None), (12, 0, 2, "COMPLETE", None, None)])
            db.executemany("INSERT INTO trial_values VALUES (?, ?, ?)", [(10, 0, 0.25 + k), (12, 0, 9.0)])
        db.close()
    got = sorted((x.path, x.number, x.state, x.duration_s, x.value) for x in files.read_trials(spark, paths, "a'b").collect())
    assert got == [(p, n, *r) for k, p in enumerate(paths) for n, r in ((0, ("COMPLETE", 59.5, 0.25 + k)), (1, ("RUNNING", None, None)))]


def test_older_rewrite_as_one_call(spark):
    task = Rel("task", spark.createDataFrame([(0, 1), (1, 2)], "id long, user long"))
    users = Rel("users", spark.createDataFrame([(1, 7), (2, 7)], "uid long, city long"))
    cities = Rel("cities", spark.createDataFrame([(7, "x"), (8, "y")], "cid long, name string"))
    profile = Rel("profile", spark.createDataFrame([(1, "p"), (2, "q")], "puser long, bio string"))
    badge = Rel("badge", spark.createDataFrame([(1, "s"), (2, "t")], "buser long, kind string"))
    edges = (Edge("task", "user", "users", "uid"), Edge("users", "city", "cities", "cid"), Edge("profile", "puser", "users", "uid"), Edge("badge", "buser", "users", "uid"))
    db = rewrite.simplify_by_paths(Database({r.name: r for r in (task, users, cities, profile, badge)}, edges), "task")
    # along references first, the city that nobody lives in too; then profile and badge, whose keys point to the same users, with the task
    assert sum("task" in t for t in db.tables) == 1 and all(e.source != e.target for e in db.edges)
    (name,) = (t for t in db.tables if "task" in t)
    assert name.startswith("task+users+cities") and db.tables[name].df.count() == 3
    rows = {x["task__id"]: x for x in db.tables[name].df.collect()}
    assert rows[0]["cities__name"] == "x"
    assert len(db.tables) == 1 and rows[1]["profile__bio"] == "q" and rows[1]["badge__kind"] == "t"


def test_plan_as_a_graph(spark):
    a = spark.range(5).withColumnRenamed("id", "a")
    rel = Rel("both", a.join(spark.range(3), F.col("a") == F.col("id")).where("a > 1"))
    nodes, edges = rewrite.plan_graph(rel)
    names = [n for _, n, _ in nodes]
    assert names[0] == "Filter" and "Join" in names
    join = names.index("Join")
    assert sorted(side for _, to, side in edges if to == join) == ["left", "right"]
    assert len(edges) == len(nodes) - 1 and rewrite.plan_dot(rel).startswith('digraph "both" {')


def test_small_helpers(spark):
    rel = files.in_memory(spark, "t", [(1, 2.0)], "k long, x double", ("k",))
    assert rel.keys == ("k",) and rel.df.count() == 1
    studies.check_numeric(rel.df)
    with pytest.raises(TypeError):
        studies.check_numeric(rel.df.withColumn("d", F.current_date()))
    df = spark.createDataFrame([(1, "a", None, 5), (2, "a", None, 5)], "i long, s string, n int, k int")
    assert algebra.drop_uninformative(df, ("k",)).columns == ["i", "k"]
    assert algebra.denormalize_names(algebra.normalize_names(df, "t"), "t").columns == df.columns
    quoted = spark.createDataFrame([("it is :least {x}", 1), ("other", 5)], "s string, v int")
    assert algebra.filter_query(quoted, "s = 'it is :least {x}' OR v > :least", least=4).count() == 2
    with pytest.raises(Exception, match="below 0"):
        spark.createDataFrame([(-1.0,)], "y double").select(log_target(F.col("y"))).collect()


def test_identity_vectorizer_and_bounded_context(spark):
    df = spark.createDataFrame([(i, "abc"[i % 3], 1) for i in range(30)], "i long, s string, c int")
    v = models.IdentityVectorizer(("i",)).fit(df)
    assert v.transform(df, ("i",)).columns == ["i", "s"]

    def model(x, y, z):
        return [[float(len(x)), float(y.sum())]] * len(z)

    run = lambda d: {tuple(x.proba) for x in models.FrameBackbone(model, 10).predict(d.withColumn("y", F.col("i")), df, ["i"], "y").collect()}
    assert run(df) == run(df.repartition(5)) and len(run(df)) == 1


def test_reducers_against_plain(spark):
    r = np.random.default_rng(0)
    x = r.normal(0, 1, (120, 6)) @ r.normal(0, 1, (6, 6)) + 3
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "i long, e array<double>")
    out = lambda m: np.array([row.e for row in models.reduce_dims(df, "e", 6, m, 3).orderBy("i").collect()])
    centred = x - x.mean(0)
    spread = np.sort(np.linalg.eigvalsh(centred.T @ centred / len(x)))[::-1][:3]
    np.testing.assert_allclose(out("pca").var(0), spread, rtol=1e-8)
    np.testing.assert_allclose(out("pca").mean(0), 0, atol=1e-8)
    np.testing.assert_allclose(out("pca_whiten").var(0), 1, rtol=1e-8)
    _, s, vt = np.linalg.svd(x, full_matrices=False)
    np.testing.assert_allclose(np.abs(out("svd")), np.abs(x @ vt[:3].T), rtol=1e-6, atol=1e-8)
    np.testing.assert_allclose(out("svd_whiten").std(0), 1, rtol=1e-8)
    text = spark.createDataFrame([(i, f"word{i % 7} other{i % 3} text") for i in range(60)] + [(99, None)], "i long, t string")
    reduced = models.embed_text(text, "t", 4, hashed=64, reduce="pca").orderBy("i").collect()
    assert len(reduced) == 61 and reduced[-1]["t__txt_0"] is None and len({row["t__txt_0"] for row in reduced[:-1]}) > 5


def test_linear_regression_against_its_closed_form(spark):
    r = np.random.default_rng(1)
    x = r.normal(0, 1, (200, 3))
    y = x @ [1.0, -2.0, 0.5] + 3 + r.normal(0, 0.1, 200)
    df = spark.createDataFrame([(i, *map(float, row), float(t)) for i, (row, t) in enumerate(zip(x, y))], "i long, a double, b double, c double, y double")
    got = np.array([row.y_pred for row in models.LinearBackbone(True, 0.0).predict(df, df, ["a", "b", "c"], "y").orderBy("i").collect()])
    one = np.c_[np.ones(200), x]
    np.testing.assert_allclose(got, one @ np.linalg.lstsq(one, y, rcond=None)[0], atol=1e-6)


def test_quantiles_and_splits_without_a_task_of_all_rows(spark):
    r = np.random.default_rng(2)
    values = np.concatenate([np.full(400, 7.0), r.normal(0, 5, 333), [1e9, -1e9]])
    df = spark.createDataFrame([(i, float(v), "ab"[i % 2]) for i, v in enumerate(values)] + [(9999, None, None)], "i long, v double, l string")
    at = {"a": 0.0, "b": 0.01, "c": 0.25, "d": 0.5, "e": 0.99, "f": 1.0}
    got = metrics.quantiles(df, {"v": F.col("v")}, at).first()
    np.testing.assert_allclose([got[f"v_{k}"] for k in at], np.quantile(values, list(at.values())))
    assert metrics.quantiles(df.limit(0), {"v": F.col("v")}, {"m": 0.5}).first().v_m is None
    split = sampling.stratified_split(df, "l", F.col("v"), "i", 70).collect()
    for label in ("a", "b", None):
        own = sorted((x for x in split if x.l == label), key=lambda x: (x.v is not None, x.v, x.i))
        assert [x.split for x in own] == ["train" if 100 * (k + 1) <= 70 * len(own) else "test" for k in range(len(own))]
    assert [x.i for x in algebra.row_slice(df, ["i"], 100, 105).orderBy("i").collect()] == [100, 101, 102, 103, 104]


def test_no_scratch_on_one_machine_of_a_cluster():
    from types import SimpleNamespace as N

    from weftline.session import shared_dir

    context = N(master="spark://somewhere:7077", _jsc=N(sc=lambda: N(getCheckpointDir=lambda: N(isDefined=lambda: False, isEmpty=lambda: True))))
    with pytest.raises(RuntimeError):
        shared_dir(N(sparkContext=context, conf=N(get=lambda *_: None)))


def test_released_steps_are_gone(spark):
    import os

    from weftline.session import materialize, release

    df = materialize(spark.range(3))
    path = df._weftline_path
    assert os.path.isdir(path)
    release(df, df)
    assert not os.path.exists(path)


def test_settled_steps_leave_nothing_else(spark):
    import os

    from weftline.session import materialize, settle, shared_dir

    kept = materialize(spark.range(2))
    before = set(os.listdir(shared_dir(spark).removeprefix("file:")))
    out = settle(lambda: materialize(materialize(spark.range(3)).where("id > 0")))
    assert out.count() == 2 and kept.count() == 2
    after = set(os.listdir(shared_dir(spark).removeprefix("file:")))
    assert len(after - before) == 1
