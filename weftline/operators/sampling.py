"""Deterministic sampling: scores by hash, anchors per key, budgets per group, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.scalar import micros, recency_score, uniform
from weftline.operators.metrics import quantiles, range_of
from weftline.session import materialize


def top_per_key(df: DataFrame, key: str, score: Column, k: int, tie: str) -> DataFrame:
    """The k best rows of every key; ranks prune before the shuffle."""
    by = Window.partitionBy(key).orderBy(score.desc(), tie)
    return df.withColumn("__rank", F.row_number().over(by)).where(F.col("__rank") <= k).drop("__rank")


def top(df: DataFrame, score: Column, k: int, tie: str) -> DataFrame:
    """The k best rows."""
    return df.orderBy(score.desc(), tie).limit(k)


def train_sample(train: DataFrame, test: DataFrame, key: str, id_col: str, score: str, size: int, anchor_fraction: float = 0.0, restrict: bool = True, fill_from_test_keys: bool = False) -> DataFrame:
    """Rows to learn from: anchors of the test entities first, then the best-scored rest up to ``size``.

    The size is soft: anchors are never dropped. Only counts come to the driver;
    the anchors are written, as they are counted, left out and kept.
    """
    if not fill_from_test_keys and train.limit(size + 1).count() <= size:
        return train
    if not restrict:
        return top(train, F.col(score), size, id_col)
    keys = test.select(F.col(key).alias("__key")).where(F.col("__key").isNotNull()).distinct()
    n_keys = keys.count()
    own = train.join(keys, train[key] == keys["__key"], "left_semi")
    per_key = max(1, round(size * anchor_fraction / n_keys)) if anchor_fraction > 0 and n_keys else 0
    anchors = materialize(top_per_key(own, key, F.col(score), per_key, id_col), "anchors") if per_key else own.limit(0)
    held = anchors.count() if per_key else 0
    if size <= held:
        return anchors
    if fill_from_test_keys and own.count() <= held:
        fill_from_test_keys = False  # nothing is left there
    pool = own if fill_from_test_keys else train
    rest = pool.join(anchors.select(F.col(id_col).alias("__taken")), pool[id_col] == F.col("__taken"), "left_anti")
    return anchors.unionByName(top(rest, F.col(score), size - held, id_col))


def top_per_group(df: DataFrame, group: str, score: str, k: Column, tie: str, bins: int = 256) -> DataFrame:
    """The ``k`` best rows of each of a few groups of any size; ``k`` may follow from a group's columns.

    Scores are counted by group and range. Ranges wholly among the best stay as
    they are, and only rows of the range that holds a group's last place are
    ranked, so a group is no one task's.
    """
    columns = df.columns
    df = df.withColumn("__b", range_of(df, score, bins)).withColumn("__k", k)
    sizes = df.groupBy(F.col(group).alias("__g"), F.col("__b").alias("__s")).agg(F.count("*").alias("__n"))
    better = Window.partitionBy("__g").orderBy(F.desc("__s")).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("__better", F.coalesce(F.sum("__n").over(better), F.lit(0)))
    df = df.join(F.broadcast(sizes), F.col(group).eqNullSafe(F.col("__g")) & (F.col("__b") == F.col("__s"))).where(F.col("__better") < F.col("__k"))
    whole = F.col("__better") + F.col("__n") <= F.col("__k")
    rank = F.row_number().over(Window.partitionBy(group, "__b").orderBy(F.desc(score), tie))
    edge = df.where(~whole).withColumn("__r", rank).where(F.col("__better") + F.col("__r") <= F.col("__k"))
    return df.where(whole).select(*columns).unionByName(edge.select(*columns))


def batch_samples(train: DataFrame, test: DataFrame, batch: str, key: str, id_col: str, score: str, size: int, anchor_fraction: float = 0.0, restrict: bool = True, fill_from_test_keys: bool = False) -> DataFrame:
    """For each batch of rows to predict its own rows to learn from, as ``train_sample`` would take them: ``batch``, and ``train``'s columns.

    All batches take a fixed number of passes. Anchors are ranked by batch and
    key. What fills a batch from all rows is among the ``size`` best of all,
    as a batch leaves no more of those out than it has anchors; so it is found
    once. What fills a batch from rows of its keys is found by score ranges.
    """
    columns = train.columns
    batches = materialize(test.select(F.col(batch).alias("__t"), F.col(key).alias("__key")).distinct(), "batches")
    every = batches.select("__t").distinct()
    if not fill_from_test_keys and train.limit(size + 1).count() <= size:
        return every.join(F.broadcast(train)).select(F.col("__t").alias(batch), *columns)  # a sample of at most ``size`` rows each
    best = materialize(top(train, F.col(score), size, id_col).withColumn("__place", F.row_number().over(Window.orderBy(F.desc(score), id_col))), "best")  # ``size`` rows
    if not restrict:
        return every.join(F.broadcast(best)).select(F.col("__t").alias(batch), *columns)
    keys = batches.where("__key IS NOT NULL")
    budget = keys.groupBy("__t").agg(F.count("*").alias("__keys"))
    depth = F.greatest(F.lit(1), F.rint(F.lit(size * anchor_fraction) / F.col("__keys"))) if anchor_fraction > 0 else F.lit(0)
    own = materialize(train.join(keys, F.col(key) == F.col("__key")).drop("__key").join(F.broadcast(budget), "__t"), "own")
    rank = F.row_number().over(Window.partitionBy("__t", key).orderBy(F.desc(score), id_col))
    anchors = materialize(own.withColumn("__r", rank).where(F.col("__r") <= depth).select("__t", *columns), "anchors")
    held = anchors.groupBy("__t").agg(F.count("*").alias("__held"))
    every = materialize(every.join(held, "__t", "left").select("__t", F.coalesce("__held", F.lit(0)).alias("__held")), "held")
    taken = anchors.select(F.col("__t").alias("__at"), F.col(id_col).alias("__taken"))
    left = (F.col("__t") == F.col("__at")) & (F.col(id_col) == F.col("__taken"))
    if fill_from_test_keys:
        sizes = own.groupBy("__t").agg(F.count("*").alias("__own"))
        every = every.join(sizes, "__t", "left").withColumn("__inner", F.coalesce(F.col("__own") > F.col("__held"), F.lit(False)))
    else:
        every = every.withColumn("__inner", F.lit(False))
    need = F.lit(size) - F.col("__held")
    outer = every.where(~F.col("__inner")).join(F.broadcast(best)).join(taken, left, "left_anti")
    outer = outer.withColumn("__r", F.row_number().over(Window.partitionBy("__t").orderBy("__place"))).where(F.col("__r") <= need)
    out = anchors.unionByName(outer.select("__t", *columns))
    if fill_from_test_keys:
        inner = own.drop("__keys").join(F.broadcast(every.where("__inner").select("__t", "__held")), "__t").join(taken, left, "left_anti")
        inner = top_per_group(materialize(inner, "inner"), "__t", score, need, id_col)
        out = out.unionByName(inner.select("__t", *columns))
    return out.withColumnRenamed("__t", batch)


def row_sets(links: DataFrame, group: list[str], row: str) -> DataFrame:
    """One of the groups with each set of rows: its columns.

    A set's signature doesn't depend on order: its size and two combined
    hashes, so no set is collected.
    """
    each = links.select(*group, row).distinct().groupBy(*group)
    signed = each.agg(F.count("*").alias("__n"), *[F.bit_xor(F.xxhash64(row, F.lit(i))).alias(f"__h{i}") for i in (1, 2)])
    return signed.groupBy("__n", "__h1", "__h2").agg(F.min(F.struct(*group)).alias("__first")).select(*[F.col(f"__first.{g}").alias(g) for g in group])


def context_sample(links: DataFrame, group: list[str], row: str, order: Column, cap: int) -> DataFrame:
    """Rows of a context table: all if they are at most ``cap``, else an equal budget of one or more per set of rows that a group of its links has.

    Groups with the same rows count once, over all links.
    """
    if links.select(row).distinct().count() <= cap:
        return links.select(row).distinct()
    kept = materialize(row_sets(links, group, row), "sets")
    groups = kept.count()
    a, b = links.alias("a"), kept.alias("b")
    links = a.join(b, [F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}")) for g in group], "left_semi")
    by = Window.partitionBy(*group).orderBy(order, row)
    return links.withColumn("__r", F.row_number().over(by)).where(F.col("__r") <= max(1, cap // groups)).select(row).distinct()


def relevant_rows(table: DataFrame, row: str, incoming: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """Ids of rows that any relevant row refers to: one semi-join per incoming edge (own column, other rows, their column)."""
    found = None
    for column, other, key in incoming:
        hit = table.join(other.select(F.col(key).alias("__k")), table[column] == F.col("__k"), "left_semi").select(row)
        found = hit if found is None else found.union(hit)
    return found.distinct()


def median_step(df: DataFrame, time: str) -> DataFrame:
    """The median gap between successive distinct times, in seconds.

    Days are the window's partitions; only each day's first and last time meet
    in the small second window, so no task gets all times.
    """
    t = df.select(micros(df, F.col(time)).alias("t")).where("t is not null").distinct()
    t = t.withColumn("d", F.floor(F.col("t") / 86_400_000_000))
    inside = t.withColumn("b", F.lag("t").over(Window.partitionBy("d").orderBy("t")))
    days = t.groupBy("d").agg(F.min("t").alias("first"), F.max("t").alias("last"))
    across = days.withColumn("b", F.lag("last").over(Window.orderBy("d"))).select(F.col("first").alias("t"), "b")
    gaps = inside.select("t", "b").union(across).where("b is not null").select(((F.col("t") - F.col("b")) / 1e6).alias("gap"))
    return quantiles(gaps, {"step_s": F.col("gap")}, {"median": 0.5}).withColumnRenamed("step_s_median", "median_step_s")


def stratified_split(df: DataFrame, label: str, order: Column, tie: str, train_percent: int = 80, bins: int = 64) -> DataFrame:
    """A column ``split``: the given percent of every label's rows are train, the rest test.

    Places go within ranges of the order, offset by the label's ranges before,
    so that a label of many rows is no one task's.
    """
    df = df.withColumn("__order", order)
    df = df.withColumn("__b", range_of(df, "__order", bins))
    sizes = df.groupBy(F.col(label).alias("__l"), F.col("__b").alias("__s")).agg(F.count("*").alias("__n"))
    of = Window.partitionBy("__l")
    before = of.orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("__l", "__s", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"), F.sum("__n").over(of).alias("__all"))
    rank = F.row_number().over(Window.partitionBy(label, "__b").orderBy("__order", tie))
    out = df.withColumn("__r", rank).join(sizes, F.col(label).eqNullSafe(F.col("__l")) & (F.col("__b") == F.col("__s")))
    split = F.when(100 * (F.col("__r") + F.col("__o")) <= train_percent * F.col("__all"), "train").otherwise("test")
    return out.withColumn("split", split).drop("__order", "__b", "__r", "__l", "__s", "__o", "__all")


def recency_scores(df: DataFrame, key: str, time: str, half_life_steps: float | None, name: str = "score", seed: int = 0) -> DataFrame:
    """``df`` with scores whose top k is a sample without replacement, weighted by recency in steps of the median gap of times.

    Without a half-life, or with at most one distinct time, which leaves no gap
    to measure and makes all rows equally recent, scores are uniform draws.
    """
    t = micros(df, F.col(time)) / 1e6
    stamps = df.select(t.alias("t")).where("t IS NOT NULL").agg(F.min("t").alias("a"), F.max("t").alias("b")).first() if half_life_steps else None
    if stamps is None or stamps.a == stamps.b:
        return df.withColumn(name, uniform(F.col(key), seed))
    step = median_step(df, time).first()[0]
    age = (F.lit(float(stamps.b)) - t) / F.lit(float(step))
    return df.withColumn(name, recency_score(F.col(key), age, F.lit(float(half_life_steps)), seed))
