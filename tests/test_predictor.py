"""The predictor end to end on constructed tasks: depth, interactions across columns, a split table; all kinds of fusion."""

import random

import pytest
from pyspark.sql import functions as F

from weftline import models
from weftline.catalog import Database, Edge, Rel, Task
from weftline.functions.scalar import uniform
from weftline.operators import pooling, sampling
from weftline.plans import predictor
from weftline.plans.predictor import Settings
from weftline.sources import files

TRAIN, TEST = 400, 150


def labels(seed):
    """Balanced labels of train and test entities, in random order."""
    r = random.Random(seed)
    out = [("train", i % 2) for i in range(TRAIN)] + [("test", i % 2) for i in range(TEST)]
    r.shuffle(out)
    return out


def task_on(spark, tables, edges, made) -> Task:
    rows = spark.createDataFrame([(i, s, y) for i, (s, y) in enumerate(made)], "entity_id long, split string, label long")
    rows = rows.withColumn("date", F.lit("2020-01-01").cast("timestamp_ntz"))
    db = Database({"entities": Rel("entities", spark.createDataFrame([(i,) for i in range(len(made))], "entity_id long"), ("entity_id",))} | tables, edges)
    return files.load_task(db, rows.select("entity_id", "date", "label", "split"), ("entity_id", "entities", "entity_id"), "date", "label")


def chain_task(spark, seed=0) -> Task:
    """entities <- hop2 <- hop3(bit), one row a key, ids permuted; the bit is the label."""
    made = labels(seed)
    r, n = random.Random(seed + 1), len(made)
    two, three = list(range(n)), list(range(n))
    r.shuffle(two)
    r.shuffle(three)
    hop2 = [(two[i], i) for i in range(n)]
    hop3 = [(three[i], two[i], float(made[i][1])) for i in range(n)]
    r.shuffle(hop2)
    r.shuffle(hop3)
    tables = {
        "hop2": Rel("hop2", spark.createDataFrame(hop2, "hop2_id long, entity_id long"), ("hop2_id",)),
        "hop3": Rel("hop3", spark.createDataFrame(hop3, "hop3_id long, hop2_id long, bit double"), ("hop3_id",)),
    }
    return task_on(spark, tables, (Edge("hop2", "entity_id", "entities", "entity_id"), Edge("hop3", "hop2_id", "hop2", "hop2_id")), made)


SIGNALS = {
    "signed": ([(1, 1), (0, 0), (-1, -1)], [(1, -1), (0, 0), (-1, 1)]),
    "ordered": ([(0, -1), (1, 0), (2, 1)], [(0, 1), (1, 0), (2, -1)]),
}


def signal_task(spark, kind, seed=0) -> Task:
    """Three rows an entity whose columns have the same sums, means and extremes in both classes, but not their products."""
    made = labels(seed)
    rows = [(3 * i + k, i, float(a), float(b)) for i, (_, y) in enumerate(made) for k, (a, b) in enumerate(SIGNALS[kind][0 if y else 1])]
    random.Random(seed).shuffle(rows)
    tables = {"signals": Rel("signals", spark.createDataFrame(rows, "signal_id long, entity_id long, a double, b double"), ("signal_id",))}
    return task_on(spark, tables, (Edge("signals", "entity_id", "entities", "entity_id"),), made)


def auroc(task, out):
    return predictor.evaluate(task, out).first().auroc


def test_depth_is_reached_by_fusion_only(spark):
    task = chain_task(spark)
    out = predictor.predict(task, Settings())
    assert out.columns == ["__task_id", "label", "proba", "y_pred"] or set(out.columns) == {"__task_id", "label", "proba", "y_pred"}
    assert out.count() == TEST and auroc(task, out) > 0.999
    assert auroc(task, predictor.predict(task, Settings(fusion="late"))) > 0.999
    assert auroc(task, predictor.predict(task, Settings(fusion="none"))) < 0.7


@pytest.mark.parametrize("kind", sorted(SIGNALS))
def test_interactions_across_columns(spark, kind):
    task = signal_task(spark, kind)
    for settings in (Settings(), Settings(fusion="late", normalize=True)) if kind == "signed" else (Settings(reduce="pca", reduce_dim=6),):
        assert auroc(task, predictor.predict(task, settings)) > 0.99
    if kind == "signed":  # pooled linear features agree in both classes
        assert auroc(task, predictor.predict(task, Settings(activation=None))) < 0.7


def test_layers_reach_as_far_as_they_count(spark):
    task = chain_task(spark)
    far = predictor.predict(task, Settings(layers=2, future=True))
    assert auroc(task, far) > 0.999
    assert predictor.predict(task, Settings(layers=1, future=True, include_task=True)).count() == TEST
    with pytest.raises(ValueError):
        predictor.predict(task, Settings(layers=2))


def test_budgets_and_samples(spark):
    task = signal_task(spark, "signed")
    out = predictor.predict(task, Settings(train_rows=120, context_rows=400, half_life_steps=3.0, restrict=True, anchor_fraction=0.5), models.BayesBackbone())
    assert out.count() == TEST and out.where("y_pred IS NULL").isEmpty()
    assert predictor.coverage(task, Settings(train_rows=120), out.withColumn("y_pred", F.col("y_pred").cast("double"))).first().n_train == 120
    with pytest.raises(ValueError):
        predictor.predict(task, Settings(fusion="middle"))


def test_bayes_against_plain(spark):
    import math

    r = random.Random(0)
    rows = [(i, r.gauss(i % 3, 1), None if i % 7 == 0 else r.gauss(0, 1 + i % 3), i % 3) for i in range(300)]
    df = spark.createDataFrame(rows, "i long, a double, b double, y long")
    got = {x.i: x for x in models.BayesBackbone().predict(df, df, ["a", "b"], "y").collect()}
    stats = {}
    for k in range(3):
        for c in (1, 2):
            v = [x[c] for x in rows if x[3] == k and x[c] is not None]
            m = sum(v) / len(v)
            stats[k, c] = m, sum((x - m) ** 2 for x in v) / len(v)
    for x in rows:
        z = [math.log(1 / 3) + sum(-((x[c] - stats[k, c][0]) ** 2) / (2 * stats[k, c][1]) - math.log(2 * math.pi * stats[k, c][1]) / 2 for c in (1, 2) if x[c] is not None) for k in range(3)]
        e = [math.exp(v - max(z)) for v in z]
        assert got[x[0]].proba == pytest.approx([v / sum(e) for v in e], abs=1e-9)
        assert got[x[0]].y_pred == z.index(max(z))
    assert models.BayesBackbone().predict(df.limit(0), df, ["a"], "y").first().y_pred is None


@pytest.mark.parametrize("how", ["sum", "mean", "max"])
def test_pooling_as_of_against_pairs(spark, how):
    """Null keys, null times on either side, equal times, NaN and missing elements, and a key with half of all rows."""
    r = random.Random(1)
    time = lambda: None if r.random() < 0.1 else f"2020-{r.randint(1, 12):02d}-{r.randint(1, 28):02d} 0{r.randint(0, 3)}:00:00"
    key = lambda: r.choice([1, 1, 1, 1, 2, 3, 4, None])
    needles = spark.createDataFrame([(i, key(), time()) for i in range(300)], "id long, key long, time string").withColumn("time", F.col("time").cast("timestamp_ntz"))
    value = lambda: r.choice([None, float("nan"), r.gauss(0, 1), r.gauss(0, 1)])
    hay = spark.createDataFrame([(key(), time(), None if r.random() < 0.05 else [value() for _ in range(3)]) for _ in range(300)], "key long, time string, emb array<double>")
    hay = hay.withColumn("time", F.col("time").cast("timestamp_ntz"))
    pairs = pooling.asof_pairs(needles, hay.where("emb IS NOT NULL").withColumnsRenamed({"key": "hk", "time": "ht"}), "key", "hk", "time", "ht")
    want = {x.id: x for x in pooling.pool(pairs.select("id", "emb"), ["id"], "emb", how).collect()}
    got = {x.id: x for x in pooling.pool_as_of(needles, hay.where("emb IS NOT NULL"), how).collect()}
    assert got.keys() == want.keys()
    for i, x in want.items():
        assert got[i].cnt == x.cnt and got[i].emb == pytest.approx(x.emb, abs=1e-9)
    assert pooling.pool_as_of(needles, hay.limit(0), how).count() == 0


def test_zoneless_times_count_the_same_in_any_zone(spark):
    from weftline.operators.counts import counts_as_of

    # the hours around a change of clocks
    one = spark.createDataFrame([(i, 1 if i % 9 else None, f"2021-11-0{6 + i // 24} {i % 24:02d}:30:00") for i in range(48)], "i long, k long, t string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    many = one.withColumnsRenamed({"i": "mi", "k": "mk", "t": "mt"})
    run = lambda: sorted((x.i, x.n, x["n__1d"]) for x in counts_as_of(one, "k", F.col("t"), many, "mk", F.col("mt"), "n", (1,)).collect())
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        got = run()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    keyed = [i for i in range(48) if i % 9]
    assert got == [(i, 0 if i % 9 == 0 else sum(j <= i for j in keyed), 0 if i % 9 == 0 else sum(i - 24 < j <= i for j in keyed)) for i in range(48)]


def test_recency_falls_back_to_uniform_draws(spark):
    df = spark.createDataFrame([(i, "2020-01-01") for i in range(40)], "i long, t string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    one = sampling.recency_scores(df, "i", "t", 2.0).collect()
    assert all(0 < x.score < 1 for x in one)
    assert [x.score for x in one] == [x.score for x in sampling.recency_scores(df, "i", "t", None).collect()]
    spread = df.withColumn("t", F.col("t") + F.expr("make_dt_interval(cast(i as int))"))
    assert any(x.score > 1 or x.score < 0 for x in sampling.recency_scores(spread, "i", "t", 2.0).collect())


def test_seeds_draw_independently(spark):
    df = spark.range(4000)
    a, b = (f"{df.select(uniform(F.col('id'), s).alias('u'), 'id').stat.corr('u', 'id'):.3f}" for s in (0, 1))
    both = df.select(uniform(F.col("id"), 0).alias("a"), uniform(F.col("id"), 1).alias("b"))
    assert abs(both.stat.corr("a", "b")) < 0.06 and abs(float(a)) < 0.06 and abs(float(b)) < 0.06
    order = lambda s: [x.id for x in df.orderBy(uniform(F.col("id"), s)).limit(50).collect()]
    assert len(set(order(0)) & set(order(1))) < 10
    far = spark.createDataFrame([(5,), (5 + 2**31 - 1,)], "id long").select(uniform(F.col("id")).alias("u")).distinct()
    assert far.count() == 2


def test_array_functions_are_linear_in_width(spark):
    """Work per element stays level: a plan of nested sums would take 16 times as long for 4 times the width."""
    import time

    from weftline.functions.scalar import softmax

    def seconds(width):
        rows = spark.range(1500, numPartitions=1).select(F.transform(F.sequence(F.lit(1), F.lit(width)), lambda i: i * 1.5 + F.rand(1)).alias("x"))
        run = lambda: rows.select(pooling.layer_norm(F.col("x"), width).alias("n"), softmax(F.col("x")).alias("s")).write.format("noop").mode("overwrite").save()
        run()
        start = time.perf_counter()
        run()
        return time.perf_counter() - start

    assert seconds(512) < 12 * seconds(128) + 2
