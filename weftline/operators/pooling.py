"""Embeddings as arrays: pairs across an edge, pooling, combination, fusion."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.scalar import DAY, micros


def asof_pairs(needles: DataFrame, hay: DataFrame, key: str, hay_key: str, time: str | None = None, hay_time: str | None = None) -> DataFrame:
    """Needle rows with the hay rows of their key that are not from their future; a missing time admits."""
    on = needles[key] == hay[hay_key]
    if time and hay_time:
        on = on & (needles[time].isNull() | hay[hay_time].isNull() | (hay[hay_time] <= needles[time]))
    return needles.join(hay, on)


def no_nan(x: Column) -> Column:
    """NaN as null, the one missing value here."""
    return F.when(~F.isnan(x), x)


def pool(pairs: DataFrame, by: list[str], embedding: str, how: str, name: str = "emb", count: str = "cnt") -> DataFrame:
    """Element-wise sum, max or mean of arrays by group, missing elements aside, and the number of rows.

    Elements are exploded and aggregated map-side before they are shuffled, so
    a group of any size costs one row per element and task.
    """
    rows = pairs.select(*by, F.posexplode_outer(embedding).alias("__i", "__x")).withColumn("__x", no_nan(F.col("__x").cast("double")))
    agg = {"sum": F.coalesce(F.sum("__x"), F.lit(0.0)), "max": F.max("__x"), "mean": F.avg("__x")}[how]
    each = rows.groupBy(*by, "__i").agg(agg.alias("__v"), F.count("*").alias("__c"))
    ordered = F.array_sort(F.collect_list(F.struct("__i", "__v")))
    return each.groupBy(*by).agg(F.transform(ordered, lambda s: s["__v"]).alias(name), F.max("__c").alias(count))


def _at(x: Column, width: int) -> list[Column]:
    """The elements of an array, NaN as null."""
    return [no_nan(F.get(x, F.lit(i)).cast("double")) for i in range(width)]


def pool_as_of(needles: DataFrame, hay: DataFrame, how: str, days: int = 30) -> DataFrame:
    """(id, emb, cnt) for needles (id, key, time): the arrays of the hay rows (key, time, emb) of their key up to their time, pooled.

    A missing time admits, on either side; needles without such rows are left
    out. No pair is made: within a key and a bucket of time both sides are
    sorted once and running sums (counts, maxima) go by element, and the sums
    of the buckets before, one row each, are added. So work is linear in the
    rows, and a key with any share of them is split by its buckets. Hay
    without a time is added up by key before it meets anything.
    """
    if how not in ("sum", "mean", "max"):
        raise ValueError(how)
    width = hay.agg(F.max(F.size("emb"))).first()[0] or 0
    held = hay.where(F.col("key").isNotNull())
    bucket = F.floor(F.col("t") / F.lit(days * DAY)).alias("b")
    points = needles.where("key IS NOT NULL AND time IS NOT NULL").select("id", "key", micros(needles, F.col("time")).alias("t"), F.lit(None).cast("array<double>").alias("emb"), F.lit(0).alias("n"))
    timed = held.where("time IS NOT NULL").select(F.lit(None).cast(needles.schema["id"].dataType).alias("id"), "key", micros(hay, F.col("time")).alias("t"), F.col("emb").cast("array<double>").alias("emb"), F.lit(1).alias("n"))
    rows = points.union(timed).select("*", bucket)
    xs = _at(F.col("emb"), width)
    merge = F.max if how == "max" else F.sum
    sums = {f"x{i}": x for i, x in enumerate(xs)} | ({f"c{i}": x.isNotNull().cast("long") for i, x in enumerate(xs)} if how == "mean" else {})

    def add(a: Column, b: Column) -> Column:
        return F.greatest(a, b) if how == "max" else F.coalesce(a + b, a, b)

    # what a key holds without a time, and in each bucket
    loose = held.where("time IS NULL").select("key", F.col("emb").cast("array<double>").alias("emb"), F.lit(1).alias("n"))
    base = loose.groupBy(F.col("key").alias("lk")).agg(F.sum("n").alias("ln"), *[merge(c).alias(f"l_{k}") for k, c in sums.items()])
    totals = rows.groupBy(F.col("key").alias("tk"), F.col("b").alias("tb")).agg(F.sum("n").alias("tn"), *[merge(c).alias(f"t_{k}") for k, c in sums.items()])
    before = Window.partitionBy("tk").orderBy("tb").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("tk", "tb", F.coalesce(F.sum("tn").over(before), F.lit(0)).alias("on"), *[merge(f"t_{k}").over(before).alias(f"o_{k}") for k in sums])
    run = Window.partitionBy("key", "b").orderBy("t").rangeBetween(Window.unboundedPreceding, 0)
    inside = rows.select("id", "key", "b", F.sum("n").over(run).alias("n"), *[merge(c).over(run).alias(k) for k, c in sums.items()]).where(F.col("id").isNotNull())
    found = inside.join(offsets, (F.col("key") == F.col("tk")) & (F.col("b") == F.col("tb")))
    found = found.select("id", "key", (F.col("n") + F.col("on")).alias("n"), *[add(F.col(k), F.col(f"o_{k}")).alias(k) for k in sums])
    # needles without a time see all of their key
    whole = totals.groupBy(F.col("tk").alias("key")).agg(F.sum("tn").alias("n"), *[merge(f"t_{k}").alias(k) for k in sums])
    ends = needles.where("key IS NOT NULL AND time IS NULL").select("id", "key").join(whole, "key", "left").select("id", "key", F.coalesce("n", F.lit(0)).alias("n"), *sums)
    every = found.unionByName(ends).join(base, F.col("key") == F.col("lk"), "left")
    every = every.select("id", (F.col("n") + F.coalesce("ln", F.lit(0))).alias("cnt"), *[add(F.col(k), F.col(f"l_{k}")).alias(k) for k in sums]).where("cnt > 0")
    out = {"sum": lambda i: F.coalesce(F.col(f"x{i}"), F.lit(0.0)), "max": lambda i: F.col(f"x{i}"), "mean": lambda i: F.col(f"x{i}") / F.nullif(F.col(f"c{i}"), F.lit(0))}[how]
    return every.select("id", F.array(*[out(i) for i in range(width)]).cast("array<double>").alias("emb"), "cnt")


def combine(own: Column, other: Column, how: str, weight: float = 1.0) -> Column:
    """Element-wise sum, max or mean of an array and a weighted other one; what is missing on one side is taken from the other."""
    def two(a: Column, b: Column) -> Column:
        b = b * F.lit(weight)
        both = {"sum": a + b, "max": F.greatest(a, b), "mean": (a + b) / 2}[how]
        return F.coalesce(both, a, b)

    return F.when(other.isNull(), own).when(own.isNull(), F.transform(other, lambda b: b * F.lit(weight))).otherwise(F.zip_with(own, other, two))


def layer_norm(x: Column, width: int = 128, eps: float = 1e-5) -> Column:
    """Arrays normalised to mean 0 and variance 1 in consecutive blocks of ``width``.

    A block's sums, then its mean and deviation, are bound before its elements
    are mapped: work in proportion to the width.
    """
    blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(x) / width).cast("int") - 1), lambda b: F.slice(x, b * width + 1, width))
    add = lambda a, v: F.struct((a["s"] + v).alias("s"), (a["q"] + v * v).alias("q"))

    def sums(block: Column) -> Column:
        both = F.aggregate(block, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q")), add)
        return F.struct(block.alias("x"), F.size(block).alias("n"), both.alias("t"))

    def moments(b: Column) -> Column:
        mean = b["t"]["s"] / b["n"]
        return F.struct(b["x"].alias("x"), mean.alias("m"), F.sqrt(b["t"]["q"] / b["n"] - mean * mean + F.lit(eps)).alias("d"))

    norm = lambda b: F.transform(b["x"], lambda v: (v - b["m"]) / b["d"])
    return F.flatten(F.transform(F.transform(F.transform(blocks, sums), moments), norm))


def first_k(x: Column, k: int) -> Column:
    """The first k elements, zeros beyond the end."""
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.coalesce(F.get(x, i), F.lit(0.0)))


def project(x: Column, matrix: list[list[float]]) -> Column:
    """A literal matrix, one row per output element, times an array; stays in the JVM.

    The matrix is one constant of the plan, however wide.
    """
    rows = F.from_json(F.lit(json.dumps(matrix)), "array<array<double>>")
    return F.transform(rows, lambda row: F.aggregate(F.zip_with(x, row, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))


def sign_matrix(rows: int, columns: int, seed: int = 1) -> list[list[float]]:
    """A projection of signs over sqrt(rows), from a linear congruence, equal everywhere."""
    return [[(1.0 if sign_bit(i, j, seed) else -1.0) / rows**0.5 for j in range(columns)] for i in range(rows)]


def sign_bit(i: int, j: int, seed: int) -> bool:
    return ((i * 7919 + j * 104729 + seed * 31) * 2654435761 // 65536) % 2 == 1


def merge_estimators(df: DataFrame, row: str, est: str, embedding: str, name: str = "emb") -> DataFrame:
    """One array per row from one per (row, estimator), by dimension first and estimator within it."""
    each = df.groupBy(row).agg(F.array_sort(F.collect_list(F.struct(F.col(est).alias("e"), F.col(embedding).alias("x")))).alias("__all"))
    dims = F.sequence(F.lit(0), F.size(F.get("__all", F.lit(0))["x"]) - 1)
    return each.select(row, F.flatten(F.transform(dims, lambda d: F.transform("__all", lambda s: F.get(s["x"], d)))).alias(name))


def interleave(x: Column, estimators: int, width: int) -> Column:
    """An array of estimators one after another, by dimension first and estimator within it."""
    return x if estimators == 1 else F.array(*[F.get(x, F.lit(e * width + d)) for d in range(width) for e in range(estimators)])


def fuse(df: DataFrame, embedding: str, width: int, prefix: str = "_ctx_emb_") -> DataFrame:
    """An array's elements as float columns; null beyond its end."""
    return df.select(*[c for c in df.columns if c != embedding], *[F.get(embedding, F.lit(i)).cast("float").alias(f"{prefix}{i}") for i in range(width)])
