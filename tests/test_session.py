"""Steps in the shared folder: what goes, what stays, and whose it is."""

import os
import threading

import numpy as np
from pyspark.sql import functions as F

from weftline.operators import metrics
from weftline.session import materialize, scratch_path, settle, tidy


def folder(df):
    return df._weftline_path.removeprefix("file://")


def test_settle_removes_its_own_steps_only(spark):
    """Another thread writes while ``settle`` is under way, and keeps what it wrote."""
    inside, written, kept = threading.Event(), threading.Event(), []

    def other():
        inside.wait(60)
        kept.append(materialize(spark.range(5), "other"))
        written.set()

    thread = threading.Thread(target=other)
    thread.start()
    own = []

    def make():
        own.append(materialize(spark.range(10), "own"))
        inside.set()
        assert written.wait(60)
        own.append(settle(lambda: materialize(own[0].where("id > 1"), "inner").where("id > 2"), "nested"))
        return own[1].where("id > 3")

    out = settle(make)
    thread.join()
    assert out.count() == 6 and kept[0].count() == 5
    assert not any(os.path.exists(folder(x)) for x in own) and os.path.exists(folder(kept[0]))


def test_tidy_keeps_what_its_plan_reads(spark):
    made = []

    def make():
        made.append(materialize(spark.range(10), "a"))
        made.append(materialize(made[0].where("id > 4"), "b"))
        made.append(materialize(made[1].groupBy().count(), "c"))
        return made[1].crossJoin(made[2])

    out = tidy(make)
    assert out.count() == 5
    assert [os.path.exists(folder(x)) for x in made] == [False, True, True]


def test_tidy_after_an_error_leaves_the_next_call_alone(spark):
    try:
        tidy(lambda: 1 / 0)
    except ZeroDivisionError:
        pass
    path = scratch_path(spark, "x")
    assert tidy(lambda: spark.range(3)).count() == 3 and path


def test_quantiles_by_brackets(spark, monkeypatch):
    """Groups beyond what is looked through whole: ties over a place, few values, nulls, a null group."""
    monkeypatch.setattr(metrics, "ACCURACY", 100)
    r = np.random.default_rng(3)
    groups = {"a": r.normal(0, 1, 4000), "b": r.integers(0, 5, 3000).astype(float), "c": np.full(900, 2.0), "d": r.normal(0, 1, 3), None: r.exponential(1, 700)}
    rows = [(k, float(x), float(-x)) for k, v in groups.items() for x in v] + [("a", None, None), ("e", None, 1.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double").repartition(5)
    at = {"p0": 0.0, "p1": 0.01, "p33": 1 / 3, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    got = {q.g: q for q in metrics.quantiles(df, {"x": F.col("x"), "y": F.col("y")}, at, ("g",)).collect()}
    for k, v in groups.items():
        np.testing.assert_allclose([got[k][f"x_{n}"] for n in at], np.quantile(v, list(at.values())), atol=1e-12)
        np.testing.assert_allclose([got[k][f"y_{n}"] for n in at], np.quantile(-v, list(at.values())), atol=1e-12)
    assert got["e"].x_p50 is None and got["e"].y_p50 == 1.0
    whole = metrics.quantiles(df, {"x": F.col("x")}, at).first()
    np.testing.assert_allclose([whole[f"x_{n}"] for n in at], np.quantile(np.concatenate(list(groups.values())), list(at.values())), atol=1e-12)


def test_one_vs_rest_by_hand(spark):
    rows = [(0, [0.7, 0.2, 0.1]), (0, [0.4, 0.5, 0.1]), (1, [0.4, 0.6, 0.0]), (1, [0.1, 0.9, 0.0]), (0, None), (None, [1.0, 0.0, 0.0])]
    got = {x["class"]: x for x in metrics.one_vs_rest(spark.createDataFrame(rows, "y int, p array<double>"), "y", "p").collect()}
    assert (got[0].n, got[0].auroc, got[0].ap) == (2, 0.875, 0.5 + 0.5 * 2 / 3)
    assert (got[1].n, got[1].auroc, got[1].ap) == (2, 1.0, 1.0)
    assert (got[2].n, got[2].auroc, got[2].ap) == (0, None, None)
    assert (got[None].n, got[None].auroc) == (4, 0.9375)
