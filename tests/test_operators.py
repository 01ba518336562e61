"""Null, tie and empty cases that the test tables don't have, and the constructed tasks end to end."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline import models
from weftline.catalog import Database, Edge, Rel, RefType
from weftline.functions import scalar
from weftline.operators import algebra, counts, metrics, pooling, results, sampling
from weftline.plans import graph, inference, rewrite
from weftline.sources import files
from weftline.streaming.counts import sessions, windowed_counts

DAY = dt.timedelta(days=1)
T0 = dt.datetime(2020, 1, 1)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_join_with_null_keys(spark):
    a = spark.createDataFrame([(1, None), (None, None), (2, 2)], "a int, b int")
    b = spark.createDataFrame([(1, None, "x"), (None, None, "y"), (2, 2, "z")], "c int, d int, v string")
    got = algebra.join(a, b, ["a", "b"], ["c", "d"], "left", drop_right=True)
    assert rows(got) == sorted([(1, None, "x"), (None, None, None), (2, 2, "z")], key=str)
    assert algebra.join(a, b, ["a", "b"], ["c", "d"], "outer").count() == 4
    assert algebra.join(a, b, ["a"], ["c"], "inner").count() == 2
    with pytest.raises(ValueError):
        algebra.join(a, a, ["a"], ["a"])


def test_cutoff_keeps_nulls_and_checks_all_times(spark):
    df = spark.createDataFrame([(1, T0, None), (2, T0 + 2 * DAY, T0), (3, None, None), (4, T0 + DAY, T0 + DAY)], "i int, s timestamp_ntz, t timestamp_ntz")
    at = F.lit("2020-01-02").cast("timestamp_ntz")
    assert [r.i for r in algebra.cut_off(df, ["s", "t"], at).orderBy("i").collect()] == [1, 3, 4]
    assert algebra.cut_off(df, ["s"], F.lit(None).cast("timestamp_ntz")).count() == 4
    assert algebra.cut_off(df, [], at).count() == 4


def test_numbered_is_contiguous_on_any_partitioning(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("v"))
    for n in (1, 7):
        got = [r.i for r in algebra.numbered(df.repartition(n), ["v"], "i").orderBy("v").collect()]
        assert got == list(range(1000))
    assert algebra.numbered(df.limit(0), ["v"], "i").collect() == []


def test_counts_as_of_equals_the_range_join(spark):
    r = np.random.default_rng(0)
    one = spark.createDataFrame([(i, int(r.integers(5)) if i % 9 else None, T0 + int(r.integers(60)) * DAY if i % 7 else None) for i in range(80)], "i int, k int, t timestamp_ntz")
    many = spark.createDataFrame([(int(r.integers(5)) if i % 8 else None, T0 + int(r.integers(60)) * DAY if i % 5 else None) for i in range(300)], "f int, m timestamp_ntz")
    got = counts.counts_as_of(one, "k", F.col("t"), many, "f", F.col("m"), "n", (7, 30))
    j = one.join(many, (F.col("k") == F.col("f")) & (F.col("m") <= F.col("t")), "left").groupBy("i", "k", "t")
    want = j.agg(F.count("m").alias("n"), *[F.count_if(F.col("m") > F.col("t") - F.expr(f"INTERVAL {d} DAY")).alias(f"n__{d}d") for d in (7, 30)])
    assert rows(got) == rows(want.select(got.columns))
    hot = counts.counts_as_of_hot(one, "k", F.col("t"), many, "f", F.col("m"), "n", (7, 30), bucket_days=4)
    assert rows(hot) == rows(want.select(hot.columns))


def test_pairs_admit_missing_times(spark):
    n = spark.createDataFrame([(1, "a", T0), (2, "a", None), (3, None, T0)], "i int, k string, t timestamp_ntz")
    h = spark.createDataFrame([(10, "a", T0 + DAY), (11, "a", None), (12, None, T0), (13, "a", T0)], "j int, f string, u timestamp_ntz")
    got = pooling.asof_pairs(n, h, "k", "f", "t", "u").select("i", "j")
    assert rows(got) == [(1, 11), (1, 13), (2, 10), (2, 11), (2, 13)]


def test_pool_and_combine_with_missing_elements(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1, [1.0, nan]), (1, [3.0, None]), (2, None), (3, [nan, nan])], "g int, e array<double>")
    got = {r.g: (r.emb, r.cnt) for r in pooling.pool(df, ["g"], "e", "mean").collect()}
    assert got[1] == ([2.0, None], 2) and got[3] == ([None, None], 1)
    assert {r.g: r.emb for r in pooling.pool(df, ["g"], "e", "sum").collect()}[3] == [0.0, 0.0]
    two = spark.createDataFrame([([1.0, None], [3.0, 4.0]), (None, [1.0]), ([5.0], None)], "a array<double>, b array<double>")
    assert [r[0] for r in two.select(pooling.combine(F.col("a"), F.col("b"), "max", 0.5)).collect()] == [[1.5, 2.0], [0.5], [5.0]]


def test_metrics_of_few_rows(spark):
    empty = spark.createDataFrame([], "y int, p int, s double")
    m = metrics.binary(empty, "y", "p").first()
    assert m.n == 0 and m.accuracy is None and m.f1 is None
    ones = spark.createDataFrame([(1, 1, 0.5), (1, 0, 0.5)], "y int, p int, s double")
    assert metrics.ranking(ones, "y", "s").first().auroc is None
    tied = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.5), (0, 0.5)], "y int, s double")
    got = metrics.ranking(tied, "y", "s").first()
    assert got.auroc == 0.5 and got.ap == 0.5
    assert metrics.spread(ones.limit(1), ["y"], "s").collect() == []


def test_ordinal_ranks_over_ranges(spark):
    df = spark.createDataFrame([(i, float(i * 7919 % 101)) for i in range(500)], "i long, v double")
    got = [r["rank_v"] for r in metrics.ordinal_ranks(df, ["v"], "i").orderBy("v", "i").collect()]
    assert got == list(range(1, 501))


def test_sampling_is_soft_and_deterministic(spark):
    train = spark.createDataFrame([(i, i % 4, float(i * 37 % 101)) for i in range(100)], "i long, k int, s double")
    test = spark.createDataFrame([(0,), (1,)], "k int")
    a = sampling.train_sample(train, test, "k", "i", "s", 10, 0.5)
    b = sampling.train_sample(train.repartition(7), test, "k", "i", "s", 10, 0.5)
    assert rows(a) == rows(b) and a.count() == 10
    assert sampling.train_sample(train, test, "k", "i", "s", 1, 1.0).count() == 2  # anchors stay
    assert {r.k for r in sampling.train_sample(train, test, "k", "i", "s", 20, 0.0, fill_from_test_keys=True).collect()} == {0, 1}
    assert sampling.train_sample(train, test, "k", "i", "s", 5, restrict=False).count() == 5
    gaps = spark.createDataFrame([(T0 + i * i * DAY,) for i in range(6)] + [(None,)], "t timestamp_ntz")
    assert sampling.median_step(gaps, "t").first()[0] == 5 * 86400


def test_ensemble_checks(spark):
    p = spark.createDataFrame([(1, "c", 1, [0.2, 0.8]), (2, "c", 0, [0.6, 0.4])], "key int, cutoff_timestamp string, y_true int, proba array<double>")
    joined = results.join_predictions([p, p])
    results.check_joined(joined, 2, 2)
    with pytest.raises(ValueError):
        results.check_joined(results.join_predictions([p, p.withColumn("y_true", F.lit(1))]), 2, 2)
    assert [round(x, 6) for x in results.ensemble([p, p]).orderBy("key").first().proba] == [0.2, 0.8]


def test_scalars(spark):
    one = spark.range(1)
    got = one.select(
        scalar.sanitize_label(F.lit("__a b/c__")), scalar.finite(F.lit(float("inf"))), scalar.unlog_target(F.lit(-1.0)), scalar.argmax(F.array(F.lit(0.5), F.lit(0.5))), scalar.binarize(F.lit(" YES "), "yes")
    ).first()
    assert tuple(got) == ("a_b_c", None, 0.0, 0, 1)
    assert scalar.flatten_config({"a": {"b": 1}, "c": 2}) == {"a.b": "1", "c": "2"}


def chain_db(spark, n=60):
    """A label that lies only on the far end of a chain of tables."""
    r = np.random.default_rng(1)
    p2, p3, bit = r.permutation(n), r.permutation(n), r.integers(0, 2, n)
    task = Rel("task", spark.createDataFrame([(i, i, int(bit[i])) for i in range(n)], "__row long, t_entity long, label int"))
    entities = Rel("entities", spark.createDataFrame([(i, i) for i in range(n)], "__row long, entity_id long"), ("entity_id",))
    hop2 = Rel("hop2", spark.createDataFrame([(int(p2[i]), int(p2[i]), i) for i in range(n)], "__row long, hop2_id long, h_entity long"), ("hop2_id",))
    hop3 = Rel("hop3", spark.createDataFrame([(int(p3[i]), int(p3[i]), int(p2[i]), float(bit[i])) for i in range(n)], "__row long, hop3_id long, h_hop2 long, bit double"), ("hop3_id",))
    edges = (Edge("task", "t_entity", "entities", "entity_id"), Edge("hop2", "h_entity", "entities", "entity_id"), Edge("hop3", "h_hop2", "hop2", "hop2_id"))
    return Database({x.name: x for x in (task, entities, hop2, hop3)}, edges)


def test_chain_carries_the_label(spark):
    db = chain_db(spark)
    found = inference.relevance(db, "task", db.tables["task"].df)
    assert {t: d.count() for t, d in found.items()} == {"task": 60, "entities": 60, "hop2": 60, "hop3": 60}
    features = {t: r.df.select("__row", F.array(F.col("bit") if t == "hop3" else F.lit(None).cast("double")).alias("emb")) for t, r in db.tables.items()}
    out = inference.propagate(db, "task", features, "mean").join(db.tables["task"].df, "__row")
    assert out.where(F.get("emb", F.lit(0)) != F.col("label")).count() == 0 and out.count() == 60


def test_interaction_needs_both_columns(spark):
    signals = [(1, 1), (0, 0), (-1, -1)], [(1, -1), (0, 0), (-1, 1)]
    df = spark.createDataFrame([(e, float(a), float(b)) for e in range(20) for a, b in signals[e % 2]], "e int, a double, b double")
    per = df.groupBy("e").agg(F.sum("a").alias("sa"), F.max("b").alias("mb"), F.sum(F.col("a") * F.col("b")).alias("ab"))
    assert per.select("sa", "mb").distinct().count() == 1
    assert per.where((F.col("ab") > 0) != (F.col("e") % 2 == 0)).count() == 0


def test_graph_rewrites(spark):
    db = chain_db(spark)
    assert graph.layers(db, "task") == [["task"], ["entities"], ["hop2"], ["hop3"]]
    contracted = rewrite.contract_task(rewrite.normalize(db), "task")
    assert set(contracted.tables) == {"task", "hop2", "hop3"} and Edge("hop2", "hop2__h_entity", "task", "entities__entity_id") in contracted.edges
    split = spark.createDataFrame([(i, float(i)) for i in range(5)], "e_id long, f double")
    task = spark.createDataFrame([(i, i % 2) for i in range(5)], "t_id long, y long")
    one = rewrite.simplify(Database({"task": Rel("task", task), "e": Rel("e", split)}, (Edge("task", "t_id", "e", "e_id"),)), "task", counts=None)
    assert one.tables["task"].df.select("task__t_id", "e__f").orderBy("task__t_id").collect() == [(i, float(i)) for i in range(5)]
    loop = Database({"a": Rel("a", task)}, (Edge("a", "t_id", "a", "y"),))
    assert rewrite.drop_self_references(loop).edges == ()
    with pytest.raises(ValueError):
        Database({"a": Rel("a", task)}, (Edge("a", "nope", "a", "y"),))
    assert RefType.MANY_TO_ONE.inverse is RefType.ONE_TO_MANY and RefType.MANY_TO_MANY.inverse is RefType.MANY_TO_MANY
    assert graph.longest_path([("a", "b"), ("b", "c"), ("b", "d")]) in (["a", "b", "c"], ["a", "b", "d"])


def test_vectorizer_backbones_and_reduction(spark):
    r = np.random.default_rng(0)
    data = [(i, float(x), None if i % 10 == 0 else float(z), "ab"[i % 2], T0 + i * DAY, [float(x), float(z)], 5, int(x > 0)) for i, (x, z) in enumerate(r.normal(0, 1, (200, 2)))]
    df = spark.createDataFrame(data, "i long, x double, z double, c string, t timestamp_ntz, e array<double>, same int, label int")
    x = models.Vectorizer(levels=2, width=2, exclude=("i", "label")).fit(df).transform(df, keep=("i", "label"))
    assert "same" not in x.columns and {"c_0", "e__1", "t_month"} <= set(x.columns)
    names = ["x", "z", "c_0"]
    out = models.LinearBackbone().predict(x.where("i < 150"), x.where("i >= 150"), names, "label")
    assert out.where(F.col("y_pred") == F.col("label")).count() > 45

    def nearest(train, y, test):
        return [[0.0, 1.0] if y.iloc[int((train["x"] - v).abs().argmin())] else [1.0, 0.0] for v in test["x"]]

    out = models.FrameBackbone(nearest).predict(x.where("i < 150"), x.where("i >= 150"), names, "label")
    assert out.where(scalar.argmax(F.col("proba")) == F.col("label")).count() > 45
    e = df.select("i", "e")
    for method in ("pca", "pca_whiten", "svd", "random_k", "gaussian_random_projection", "first_k"):
        got = models.reduce_dims(e, "e", 2, method, 3).collect()
        assert all(len(g.e) == 3 for g in got), method
    white = models.reduce_dims(e, "e", 2, "pca_whiten", 2).agg(*[F.stddev_pop(F.get("e", F.lit(k))) for k in (0, 1)]).first()
    assert all(abs(v - 1) < 1e-6 for v in white)
    assert models.extract(x, names, 4, ["i"]).where(F.size("emb") == 4).count() == 200


def test_files(spark, tmp_path):
    p = spark.createDataFrame([(1, "c", 1, 1, "binary")], "key int, cutoff_timestamp string, y_true int, y_pred int, task_type string")
    files.write_predictions(p, f"{tmp_path}/p", "task", "run", "val")
    assert files.read_predictions(spark, f"{tmp_path}/p").count() == 1
    files.read_predictions(spark, f"{tmp_path}/p").withColumn("name", F.lit("other")).write.mode("append").parquet(f"{tmp_path}/p")
    with pytest.raises(ValueError):
        files.read_predictions(spark, f"{tmp_path}/p")
    (tmp_path / "o").mkdir()
    (tmp_path / "o/a.json").write_text('{"seed": 1,\n "v": 2}')
    (tmp_path / "o/b.json").write_text('{"v": 3}')
    with pytest.raises(ValueError):
        files.read_objects(spark, f"{tmp_path}/o", "seed int, v int", ["seed"])


def test_streams_agree_with_batch(spark, tmp_path):
    data = spark.createDataFrame([(i % 3, T0 + i * dt.timedelta(hours=7)) for i in range(60)], "k int, t timestamp_ntz").select("k", F.col("t").cast("timestamp").alias("t"))
    data.write.parquet(f"{tmp_path}/in")
    for f in (windowed_counts, sessions):
        stream = f(spark.readStream.schema(data.schema).parquet(f"{tmp_path}/in"), "k", "t")
        q = stream.writeStream.format("memory").queryName(f.__name__).outputMode("complete").option("checkpointLocation", f"{tmp_path}/{f.__name__}").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert rows(spark.table(f.__name__)) == rows(f(data, "k", "t"))


def test_entry_imports_without_the_corpus_package():
    import subprocess
    import sys

    code = "import sys; sys.modules['weftline.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'load_task' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)
