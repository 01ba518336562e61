"""Exact top-k by inner product with Fagin's threshold algorithm.

Vectors and queries are dealt to blocks by hashes of their ids, of bounded
size on average; every query block meets every vector block once, and sorts
its lists once for all the block's queries. In a block, each dimension has a list of vectors in order of their component. A query
walks all lists from the end that its own component favours, scores what it
meets, and stops when the sum of the components at its depth, the best any
unmet vector could have, is below its kth score. The blocks' best are merged.

Defined results: vectors that are null, or hold null or non-finite components,
and rows without an id take no part; ties go to the smaller id; rows with the
query's id are its own and no candidates; other repeated rows are candidates
each; a query row that repeats counts once; vectors of unequal length count as
ending in zeros; scores beyond a long saturate, and tie there; an empty table gives an empty
one; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 10
SCALE = 1024
#: Components of a block of vectors or queries of about one width, on average: 8 MB, or 16,384 vectors of 64. A vector
#: is sent to one task for each block of queries, a query to one for each block of vectors.
BLOCK_COMPONENTS = 1 << 20
#: Depth of the first round; each later one goes twice as deep.
FIRST_DEPTH = 16

SCHEMA = "query_id bigint, query_key bigint, vec_id bigint, score bigint"


def padded(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows of doubles, zeros to ``width``, and nothing beyond it."""
    sizes = pc.list_value_length(column).to_numpy()
    flat = pc.list_flatten(column).to_numpy()
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat[place < width]
    return out


def quantise(x: np.ndarray, whole: bool = False) -> np.ndarray:
    """floor(SCALE * x) as doubles, or as Python integers, which no component overflows."""
    if not whole:
        return np.floor(SCALE * x)
    exact = [[int(v) * SCALE if abs(v) >= 2.0**52 else math.floor(v * SCALE) for v in r] for r in x.tolist()]
    return np.array(exact, object).reshape(x.shape)


def beyond_doubles(x: np.ndarray, q: np.ndarray) -> bool:
    """Whether products of rows of ``x`` and ``q`` could leave the integers that doubles hold."""
    a, b = (float(np.abs(y).max(initial=0)) for y in (x, q))
    return max(a, b) >= 2.0**43 or (a * SCALE + 1) * (b * SCALE + 1) * max(1, x.shape[1]) >= 2.0**53


class Lists:
    """A block of vectors with its sorted list of each dimension, built once for all queries of the block."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, whole: bool):
        self.x, self.ids = quantise(x, whole), ids
        self.order = np.argsort(x, axis=0, kind="stable").astype(np.int32)
        #: Vectors that queries met, over all of them.
        self.met = 0

    def top(self, q: np.ndarray, own: int, k: int = K) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of the k best for ``q``, rows of id ``own`` left out."""
        n = len(self.ids)
        dims = np.flatnonzero(q != 0)
        seen = self.ids == own
        scores, ids = np.empty(0, self.x.dtype), np.empty(0, np.int64)
        if not len(dims):
            dims = np.arange(min(1, self.x.shape[1]))
        up, down = dims[q[dims] < 0], dims[q[dims] >= 0]
        done, depth = 0, FIRST_DEPTH
        while done < n:
            depth = min(n, depth)
            met = np.zeros(n, bool)
            met[self.order[done:depth][:, up].ravel()] = True
            met[self.order[n - depth : n - done][:, down].ravel()] = True
            new = np.flatnonzero(met & ~seen) if len(dims) else np.flatnonzero(~seen)
            seen[new] = True
            self.met += len(new)
            found = self.x[new] @ q
            if found.dtype == object:
                found = np.maximum(np.minimum(found, 2**63 - 1), -(2**63))
            scores, ids = np.concatenate([scores, found]), np.concatenate([ids, self.ids[new]])
            best = np.lexsort((ids, -scores))[:k]
            scores, ids = scores[best], ids[best]
            edge = (self.x[self.order[depth - 1, up], up] * q[up]).sum() + (self.x[self.order[n - depth, down], down] * q[down]).sum()
            if len(scores) == k and scores[-1] > edge or seen.all():
                break
            done, depth = depth, depth * 2
        return scores, ids


def search_block(vectors: pa.Table, queries: pa.Table, k: int = K) -> pa.Table:
    """All queries of a pair of blocks against all its vectors; rows (vec_id, vec_key, v)."""
    own, keys = queries.column("vec_id").to_pylist(), queries.column("vec_key").to_pylist()
    sides = vectors.column("v"), queries.column("v")
    width = min((pc.max(pc.list_value_length(c)).as_py() or 0) for c in sides)  # what one side lacks is zero
    x, q = (padded(c, width) for c in sides)
    whole = beyond_doubles(x, q)
    lists = Lists(x, vectors.column("vec_id").to_numpy().astype(np.int64), whole)
    out: list[tuple[int, int, int, int]] = []
    for i, key, row in zip(own, keys, quantise(q, whole)):
        scores, ids = lists.top(row, i, k)
        out += [(i, key, int(j), int(s)) for s, j in zip(scores, ids)]
    made = list(zip(*out)) or [[]] * 4
    return pa.Table.from_arrays([pa.array(list(c), pa.int64()) for c in made], ["query_id", "query_key", "vec_id", "score"])


def search(vectors: DataFrame, k: int = K, every: int = 100, block_rows: int | None = None, query_rows: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score of the k best for each vector whose id ``every`` divides."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", bad))
    rows = rows.select("vec_id", F.xxhash64("embedding").alias("vec_key"), F.col("embedding").cast("array<double>").alias("v"))
    asked = rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "vec_key"])
    kind = F.when(F.size("v") > 1, F.ceil(F.log2(F.size("v")))).otherwise(0).cast("int")
    sizes = sorted(rows.groupBy(kind.alias("w")).agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0)).collect())  # by powers of two of a width

    def dealt(counts: list[int], rows_each: int | None, salt: int) -> tuple[Column, int]:
        """The number of a row's block, and how many there are; widths of one power of two lie together, so that padding at most doubles a block."""
        block, total = F.lit(0), 0
        for (w, *_), n in zip(sizes, counts):
            k = max(1, -(-n // (rows_each or max(1, BLOCK_COMPONENTS >> w))))
            block = F.when(kind == w, F.pmod(F.xxhash64("vec_id", "vec_key", F.lit(salt)), F.lit(k)).cast("int") + total).otherwise(block)
            total += k
        return block, max(1, total)

    block, blocks = dealt([n for _, n, _ in sizes], block_rows, 1)
    query_block, query_blocks = dealt([m for *_, m in sizes], query_rows, 2)
    all_of = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = rows.select("*", block.alias("b")).select("*", all_of(query_blocks).alias("q"))
    right = asked.select("*", query_block.alias("q")).select("*", all_of(blocks).alias("b"))

    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        return search_block(vectors, queries, k)

    found = left.groupBy("b", "q").cogroup(right.groupBy("b", "q")).applyInArrow(run, SCHEMA)
    best = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score
FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY rank <= {K}
"""
