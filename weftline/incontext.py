"""An in-context backbone: rows to predict attend to the rows to learn from, block by block.

A row's weights over the context are a softmax of minus half the squared
distance between standardised features, over the bandwidth squared; its
prediction is the weighted mean of the context's targets, or of its classes.

Equal rows meet once: those to learn from are one key, with their number and
the sums of their targets, and those to predict one query.

The keys lie in blocks, and queries in portions; every portion meets every block
in a task of its own, so neither is held whole anywhere. A meeting gives a
query's largest score and the sums of its weights and of its targets relative
to that; those of all blocks are merged as partial softmaxes are, relative to
the largest of all.

Where the pairs that are left are many, a lattice takes the place of the features
of most values. With h the bandwidth, exp(-(q - k)^2 / 2h^2) is, up to a factor
that all pairs share, the sum over the points p of a lattice of
exp(-(q - p)^2 / h^2) exp(-(p - k)^2 / h^2), all of them positive; by Poisson's
summation, at steps of 0.4 h, every single weight is met to a relative 1e-13,
beside rounding. Points lie around the middles of the pairs that there are.
So keys that agree in the other features are summed up at every point, the
distinct other features meet point by point, and a row to predict attends to
the points. That is linear in the rows, and no key is left out, however far.

Rows of a batch attend to the context of their batch alone.

Defined results: a missing feature is at its mean; a feature without values, or
the same in all rows, says nothing; a row to learn from without a target is
left out; where no context is left, what is predicted is null; an empty table
gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.scalar import argmax
from weftline.session import materialize

#: Scores that are computed at once; they stay in a core's cache.
SCORES = 1 << 17
#: Numbers at points that a task holds at once.
HELD = 1 << 22
#: Points of a lattice at most.
POINTS = 1 << 12
#: A lattice's steps, how far it goes around the middles of pairs, and how far off a feature's values may be, in bandwidths.
STEP, REACH, FAR = 0.4, 4.3, 1e6


def matrix(t: pa.Table | pa.RecordBatch, column: str) -> np.ndarray:
    """Arrays of one length as rows."""
    c = t.column(column)
    return (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c).flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1)


def arrays(x: np.ndarray) -> pa.ListArray:
    """Rows as arrays."""
    x = x.reshape(len(x), -1)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.int32()), pa.array(x.ravel(), pa.float64()))


def partial_attention(q: np.ndarray, k: np.ndarray, v: np.ndarray, bias: np.ndarray, bandwidth: float) -> tuple[np.ndarray, np.ndarray]:
    """For each query the largest score, and the weighted sums of ``v`` relative to it; ``bias`` adds to a key's scores."""
    top, sums = np.empty(len(q)), np.empty((len(q), v.shape[1]))
    step = max(1, SCORES // max(1, len(k)))
    keys = np.column_stack([k / bandwidth**2, bias - (k * k).sum(1) / 2 / bandwidth**2]).T.copy()
    asked = np.column_stack([q, np.ones(len(q))])
    for i in range(0, len(q), step):
        score = asked[i : i + step] @ keys  # all but what a query's scores have in common
        best = score.max(1)
        score -= best[:, None]
        top[i : i + step], sums[i : i + step] = best, np.exp(score, out=score) @ v
    return top - (q * q).sum(1) / 2 / bandwidth**2, sums


def lattice_side(k: list[int], q: list[int]) -> np.ndarray:
    """The points, in steps, around the middles of all pairs of a key's cell and a query's."""
    middles = np.unique(np.unique(np.add.outer(np.array(k, np.int64), np.array(q, np.int64))) // 2)
    reach = math.ceil(REACH / STEP)
    return np.unique(np.add.outer(middles, np.arange(-reach, reach + 3)))


def point_scores(x: np.ndarray, points: np.ndarray, bandwidth: float) -> np.ndarray:
    """Of every row at every point; those of a pair add up to its own where they are largest."""
    return -sum(((x[:, [j]] - points[:, j]) ** 2 for j in range(points.shape[1])), np.zeros((len(x), len(points)))) / bandwidth**2


def summed_at_points(parts: Iterator[pa.RecordBatch], points: np.ndarray, bandwidth: float) -> Iterator[pa.RecordBatch]:
    """Of every run of keys of one batch and the same ``d``, at every point the largest score, and the weighted sums of ``v`` relative to it."""
    step = max(1, SCORES // len(points))
    made = lambda b, d, top, v: pa.record_batch({"batch": pa.array(b, pa.string()), "d": arrays(d), "top": arrays(top), "v": arrays(v)})
    last = None  # the run that may go on
    for t in (whole.slice(i, step) for whole in parts for i in range(0, len(whole), step)):
        d, v = matrix(t, "d"), matrix(t, "v")
        batch = t.column("batch").dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new = np.append(True, (d[1:] != d[:-1]).any(1) | (batch[1:] != batch[:-1]))
        first, score = np.flatnonzero(new), point_scores(matrix(t, "l"), points, bandwidth)
        top = np.maximum.reduceat(score, first, axis=0)
        w = np.exp(score - top[np.cumsum(new) - 1])
        sums = np.stack([np.add.reduceat(w * c[:, None], first, axis=0) for c in v.T], 2)
        names, d = t.column("batch").take(pa.array(first)).to_pylist(), d[first]
        if last and last[0][0] == names[0] and (last[1] == d[:1]).all():
            both = np.maximum(last[2][0], top[0])
            sums[0] = last[3][0] * np.exp(last[2][0] - both)[:, None] + sums[0] * np.exp(top[0] - both)[:, None]
            top[0] = both
        elif last:
            yield made(*last)
        if len(names) > 1:
            yield made(names[:-1], d[:-1], top[:-1], sums[:-1])
        last = names[-1:], d[-1:], top[-1:], sums[-1:]
    if last:
        yield made(*last)


def read_at_points(a: pa.Table, q: pa.Table, points: np.ndarray, bandwidth: float) -> pa.Table:
    """Attention of queries ``q`` to the points, of which ``a`` has the scores and sums for their ``kind``."""
    ids, at = a.column("kind").to_numpy(), a.column("at").to_numpy()
    order = np.lexsort((at, ids))
    ids = ids[order][:: len(points)]
    q = q.filter(pa.array(np.isin(q.column("kind").to_numpy(), ids)))
    top = a.column("top").to_numpy()[order].reshape(-1, len(points))
    v = matrix(a, "v")[order].reshape(len(top), len(points), -1)
    place, l, out = np.searchsorted(ids, q.column("kind").to_numpy()), matrix(q, "l"), np.empty((len(q), v.shape[2]))
    step = max(1, SCORES // len(points) // v.shape[2])
    for i in range(0, len(q), step):
        p = place[i : i + step]
        score = point_scores(l[i : i + step], points, bandwidth) + top[p]
        out[i : i + step] = np.einsum("qp,qpc->qc", np.exp(score - score.max(1, keepdims=True)), v[p])
    return pa.table({"id": q.column("id"), "v": arrays(out)})


class AttentionBackbone:
    """Attention over the rows to learn from; ``bandwidth`` in standard deviations.

    Up to ``direct`` pairs of distinct rows meet without a lattice.
    """

    def __init__(self, regression: bool = False, bandwidth: float = 0.5, block_rows: int = 4096, portion_rows: int = 16_384, direct: int = 1 << 30):
        self.regression, self.bandwidth, self.block_rows, self.portion_rows, self.direct = regression, bandwidth, block_rows, portion_rows, direct

    def predict(self, train: DataFrame, test: DataFrame, features: list[str], target: str, batch: str | None = None) -> DataFrame:
        """``test`` with ``y_pred``, and for classes ``proba`` in ascending order of the classes learnt from."""
        b = F.col(batch).cast("string") if batch else F.lit("")
        y = F.col(target).cast("double" if self.regression else "long")
        context = train.where(y.isNotNull())
        value = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
        stats = context.agg(F.count("*").alias("n"), *[F.struct(F.avg(value(c)).alias("m"), F.stddev_pop(value(c)).alias("s")).alias(f"f{i}") for i, c in enumerate(features)]).first()
        used = [(c, stats[f"f{i}"]) for i, c in enumerate(features) if stats[f"f{i}"]["m"] is not None and stats[f"f{i}"]["s"]]
        x = F.array(*[F.coalesce((value(c) - F.lit(s["m"])) / F.lit(s["s"]), F.lit(0.0)) for c, s in used]).cast("array<double>")
        classes = [] if self.regression else [r[0] for r in context.select(y.alias("y")).distinct().orderBy("y").collect()]
        v = [F.count("*").cast("double"), *([F.sum("y")] if self.regression else [F.sum((F.col("y") == c).cast("double")) for c in classes])]

        rows = materialize(test, "rows")
        keys = materialize(context.select(b.alias("batch"), x.alias("x"), y.alias("y")).groupBy("batch", "x").agg(F.array(*v).alias("v")), "keys")
        queries = rows.select(b.alias("batch"), x.alias("x")).distinct().withColumn("id", F.monotonically_increasing_id())
        queries = materialize(queries, "distinct")
        cut, points = self.lattice(keys, queries, len(used))
        if cut:
            found = self.through(keys, queries, cut, points, len(used), len(v))
        else:
            found = self.meet(keys.select("batch", F.col("x").alias("d"), F.array(F.lit(0.0)).alias("top"), "v"), queries.select("batch", "id", F.col("x").alias("d")), points, len(v))
        mean = F.transform(F.slice("v", 2, len(v) - 1), lambda s: s / F.get("v", F.lit(0))).alias("__p")
        found = queries.select(F.col("batch").alias("__in"), F.col("x").alias("__x"), "id").join(found.select("id", mean), "id").drop("id")
        out = rows.join(found, b.eqNullSafe(F.col("__in")) & (x == F.col("__x")), "left").drop("__in", "__x")
        if self.regression:
            return out.withColumn("y_pred", F.get("__p", F.lit(0))).drop("__p")
        named: Column = F.array(*[F.lit(c) for c in classes]) if classes else F.lit(None).cast("array<bigint>")
        return out.withColumnRenamed("__p", "proba").withColumn("y_pred", F.get(named, argmax(F.col("proba"))).cast("int"))

    def lattice(self, keys: DataFrame, queries: DataFrame, width: int) -> tuple[list[int], np.ndarray]:
        """The features that a lattice takes the place of, and its points: those by which least is to do; none and one point if few pairs meet without."""
        nothing = [], np.zeros((1, 0))
        n = keys.count() + queries.count()
        if keys.count() * queries.count() <= self.direct or not width:
            return nothing
        step = STEP * self.bandwidth
        cell = lambda c: F.floor(c / F.lit(step))
        facts = [F.struct(F.max(F.abs(c)).alias("far"), F.approx_count_distinct(c).alias("n"), F.approx_count_distinct(cell(c)).alias("cells")).alias(f"f{i}") for i, c in enumerate(_parts(range(width)))]
        k, q = (df.agg(F.approx_count_distinct("batch").alias("batches"), *facts).first() for df in (keys, queries))
        able = [i for i in range(width) if all(side[f"f{i}"]["cells"] <= POINTS and side[f"f{i}"]["far"] <= FAR * self.bandwidth for side in (k, q))]
        able = sorted(able, key=lambda i: -k[f"f{i}"]["n"] - q[f"f{i}"]["n"])[: int(math.log(POINTS, 2 * REACH / STEP))]
        cells = [df.agg(*[F.collect_set(cell(c)) for c in _parts(able)]).first() if able else () for df in (keys, queries)]
        sides: dict[int, np.ndarray] = {}
        for i, *of in zip(able, *cells):
            side = lattice_side(*of)
            if len(side) <= POINTS / math.prod(map(len, sides.values())):
                sides[i] = side * step
        plans = [list(sides)[:m] for m in range(len(sides) + 1)]
        kinds = [F.approx_count_distinct(F.xxhash64("batch", *_parts(i for i in range(width) if i not in cut))) for cut in plans]
        meetings = [a * b / max(1, q["batches"]) for a, b in zip(*(df.agg(*kinds).first() for df in (keys, queries)))]
        if meetings[0] <= self.direct:
            return nothing
        work = [(m + (n if cut else 0)) * math.prod(len(sides[i]) for i in cut) for m, cut in zip(meetings, plans)]
        cut = plans[work.index(min(work))]
        return (cut, np.array(list(product(*[sides[i] for i in cut])))) if cut else nothing

    def through(self, keys: DataFrame, queries: DataFrame, cut: list[int], points: np.ndarray, width: int, sums: int) -> DataFrame:
        """(id, v): the sums of all queries over the lattice's points, to which the keys' sums go by the features that aren't cut."""
        bandwidth = self.bandwidth
        d, l = (F.array(*_parts(some)).cast("array<double>") for some in ([i for i in range(width) if i not in cut], cut))  # noqa: E741
        keys = keys.select("batch", d.alias("d"), l.alias("l"), "v").repartitionByRange("batch", "d", "l").sortWithinPartitions("batch", "d", "l")
        keys = materialize(keys.mapInArrow(lambda parts: summed_at_points(parts, points, bandwidth), "batch string, d array<double>, top array<double>, v array<double>"), "points")
        queries = queries.select("batch", d.alias("d"), "id", l.alias("l"))
        kinds = materialize(queries.groupBy("batch", "d").agg(F.count("*").alias("n")).withColumn("kind", F.monotonically_increasing_id()), "kinds")
        whole = self.meet(keys, kinds.select("batch", F.col("kind").alias("id"), "d"), points, sums)

        held = max(1, HELD // 4 // len(points))
        deals = F.lit(max(1, -(-queries.count() // held)))
        dealt = lambda kind, salt: F.pmod(F.pmod(F.xxhash64(kind), deals) + salt, deals).alias("deal")
        salts = F.ceil(F.col("n") / F.lit(held))
        known = kinds.select(F.col("batch").alias("in"), F.col("d").alias("of"), "kind", "n")
        asked = queries.join(known, F.col("batch").eqNullSafe(F.col("in")) & (F.col("d") == F.col("of"))).select(dealt("kind", F.pmod(F.xxhash64("id"), salts)), "kind", "id", "l")
        told = kinds.select("kind", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"))
        told = told.join(whole, F.col("kind") == F.col("id")).select(dealt("id", F.col("salt")), F.col("id").alias("kind"), "at", "top", "v")
        none = pa.table({"id": pa.array([], pa.int64()), "v": pa.array([], pa.list_(pa.float64()))})
        read = lambda a, q: read_at_points(a, q, points, bandwidth) if len(a) and len(q) else none
        return told.groupBy("deal").cogroup(asked.groupBy("deal")).applyInArrow(read, "id bigint, v array<double>")

    def meet(self, keys: DataFrame, queries: DataFrame, points: np.ndarray, sums: int) -> DataFrame:
        """(id, at, top, v): what all keys of a query's batch sum up to at each point, relative to the largest score."""
        most = max(1, HELD // 4 // len(points))
        blocks = max(1, -(-keys.count() // min(most, self.block_rows)))
        portions = max(1, -(-queries.count() // min(most, self.portion_rows)))
        drawn = lambda n, *salt: F.pmod(F.xxhash64(*salt), F.lit(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        keys = keys.select("batch", drawn(blocks, "d", "top").alias("block"), "d", "top", "v").withColumn("portion", every(portions))
        queries = queries.select("batch", drawn(portions, "id").alias("portion"), "id", "d").withColumn("block", every(blocks))
        bandwidth = self.bandwidth

        def attend(a: pa.Table, q: pa.Table) -> pa.Table:
            if not len(a) or not len(q):
                return pa.table({"id": pa.array([], pa.int64()), "at": pa.array([], pa.int32()), "top": pa.array([], pa.float64()), "v": pa.array([], pa.list_(pa.float64()))})
            asked, k, bias = matrix(q, "d"), matrix(a, "d"), matrix(a, "top")
            v = matrix(a, "v").reshape(len(a), len(points), -1)
            found = [partial_attention(asked, k, v[:, i], bias[:, i], bandwidth) for i in range(len(points))]
            at = np.repeat(np.arange(len(points), dtype=np.int32), len(q))
            return pa.table({"id": np.tile(q.column("id").to_numpy(), len(points)), "at": at, "top": np.concatenate([t for t, _ in found]), "v": arrays(np.concatenate([s for _, s in found]))})

        place = ("batch", "block", "portion")
        if blocks * portions > 1:  # by their size few tasks would seem enough, but not by what is done with them
            tasks = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            keys, queries = keys.repartition(tasks, *place), queries.repartition(tasks, *place)
        parts = keys.groupBy(*place).cogroup(queries.groupBy(*place)).applyInArrow(attend, "id bigint, at int, top double, v array<double>")
        best = F.max("top").over(Window.partitionBy("id", "at"))
        parts = parts.select("id", "at", best.alias("top"), F.exp(F.col("top") - best).alias("share"), "v")
        return parts.groupBy("id", "at").agg(F.first("top").alias("top"), F.array(*[F.sum(F.get("v", F.lit(i)) * F.col("share")) for i in range(sums)]).alias("v"))


def _parts(some: Iterable[int]) -> list[Column]:
    """Some of a row's features."""
    return [F.get("x", F.lit(i)) for i in some]
