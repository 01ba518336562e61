"""Features of strings: min-hashes for names, and latent vectors of texts, kept from run to run.

``min_hash`` gives strings that share most of their character n-grams mostly
equal columns, whatever the number of distinct strings.

``TextVectors`` is TF-IDF over the distinct texts of a column, reduced by a
randomised SVD: a range finder multiplies the sparse matrix with a projection
drawn by hash, one more pass gives its small other side, and only matrices of
``dim`` + ``OVER`` rows and columns come to the driver. Terms keep their vectors,
so a text met later is projected without a fit. With a folder, terms and
vectors are written there by the hash of the text, and a second run reads them
and computes nothing that it holds.

Defined results: null texts have no vector; a text without known terms has
zeros; with fewer distinct texts than dimensions, what is beyond them is zero.
"""

from __future__ import annotations

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.scalar import uniform
from weftline.session import materialize

#: Columns of the random projection beyond the dimensions asked for.
OVER = 8


def grams(x: Column, n: int = 3) -> Column:
    """The character n-grams of a string in lower case, its ends marked; null for null."""
    marked = F.concat(F.lit("^"), F.lower(x), F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(marked) - (n - 1), F.lit(1))), lambda i: F.substr(marked, i, F.lit(n))))


def min_hash(x: Column, width: int = 4, n: int = 3) -> list[Column]:
    """``width`` numbers in (0, 1): the least hash of a string's n-grams under as many seeds.

    Two strings agree in a column with the probability of the share of n-grams
    that they have in common.
    """
    least = lambda seed: F.array_min(F.transform(grams(x, n), lambda g: uniform(g, seed)))
    return [least(seed) for seed in range(width)]


def terms(x: Column) -> Column:
    """The words of a text in lower case."""
    return F.filter(F.split(F.lower(x), r"\s+"), lambda w: w != "")


def _sum_arrays(rows: DataFrame, by: str, vector: Column, width: int, name: str) -> DataFrame:
    """Element-wise sums of arrays by key, added up before the shuffle."""
    sums = rows.groupBy(by).agg(*[F.sum(F.get(vector, F.lit(i))).alias(f"s{i}") for i in range(width)])
    return sums.select(by, F.array(*[f"s{i}" for i in range(width)]).alias(name))


def _gram_matrix(rows: DataFrame, vector: str, width: int) -> np.ndarray:
    """Sums of products of a vector's elements; ``width`` squared numbers to the driver."""
    at = lambda i: F.get(vector, F.lit(i))
    row = rows.agg(*[F.coalesce(F.sum(at(i) * at(j)), F.lit(0.0)) for i in range(width) for j in range(i, width)]).first()
    out, values = np.zeros((width, width)), iter(row)
    for i in range(width):
        for j in range(i, width):
            out[i, j] = out[j, i] = next(values)
    return out


def _times(vector: Column, matrix: np.ndarray) -> Column:
    """A vector times a small matrix."""
    columns = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in matrix.T])
    return F.transform(columns, lambda c: F.aggregate(F.zip_with(vector, c, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))


def _draws(term: Column, width: int, seed: int) -> Column:
    """A term's row of the random projection."""
    return F.array(*[F.sqrt(-2 * F.log(uniform(term, seed + 2 * i))) * F.cos(2 * np.pi * uniform(term, seed + 2 * i + 1)) for i in range(width)])


class TextVectors:
    """Latent vectors of a column's distinct texts; see the module."""

    def __init__(self, dim: int = 16, rounds: int = 2, seed: int = 0, folder: str | None = None):
        self.dim, self.rounds, self.seed, self.folder = dim, rounds, seed, folder
        #: Texts that were given vectors, not read from the folder, by the last call.
        self.computed = 0

    def vectors(self, df: DataFrame, column: str) -> DataFrame:
        """(text, vector) for each distinct text of a column."""
        texts = materialize(df.select(F.col(column).cast("string").alias("text")).where("text IS NOT NULL").distinct().withColumn("h", F.sha2("text", 256)), "texts")
        held, known = (self._read(df.sparkSession, x) for x in ("vectors", "terms"))
        new = texts if held is None else texts.join(held, "h", "left_anti")
        self.computed = new.count()
        if self.computed:
            if known is None:
                known = materialize(self.fit(new), "terms")
                self._write(known, "terms")
            made = materialize(self.project(new, known), "vectors")
            self._write(made, "vectors")
            held = made if held is None else held.unionByName(made)
        return texts.select("text", "h").join(held, "h").select("text", "vector") if held is not None else texts.select("text", F.array().cast("array<double>").alias("vector")).limit(0)

    def transform(self, df: DataFrame, column: str, prefix: str | None = None) -> DataFrame:
        """``df`` with ``dim`` columns of a text's vector; null for null."""
        prefix = prefix or f"{column}__svd_"
        wide = self.vectors(df, column).select(F.col("text").alias("__t"), *[F.get("vector", F.lit(i)).cast("float").alias(f"{prefix}{i}") for i in range(self.dim)])
        return df.join(wide, F.col(column).cast("string") == F.col("__t"), "left").drop("__t")

    def fit(self, texts: DataFrame) -> DataFrame:
        """(term, idf, v): each term's weight and its vector, of ``texts`` (h, text)."""
        n, width = texts.count(), self.dim + OVER
        each = texts.select("h", F.explode(terms(F.col("text"))).alias("term")).groupBy("h", "term").agg(F.count("*").alias("tf"))
        idf = each.groupBy("term").agg((F.log(F.lit(float(n)) / F.count("*")) + 1).alias("idf"))
        cells = materialize(each.join(idf, "term").select("h", "term", (F.col("tf") * F.col("idf")).alias("w"), "idf"), "cells")
        scaled = lambda vector: F.transform(vector, lambda x: x * F.col("w"))
        side = cells.select("h", scaled(_draws(F.col("term"), width, self.seed)).alias("p"))
        for last in [False] * self.rounds + [True]:
            left = materialize(_sum_arrays(side, "h", F.col("p"), width, "y"), "left")
            q = left.select("h", _times(F.col("y"), self._orthonormal(_gram_matrix(left, "y", width))).alias("q"))
            right = cells.join(q, "h").select("term", "idf", scaled(F.col("q")).alias("p"))
            right = materialize(_sum_arrays(right, "term", F.col("p"), width, "b").join(idf, "term"), "right")
            if not last:  # once more through the matrix brings the range closer
                z = right.select("term", _times(F.col("b"), self._orthonormal(_gram_matrix(right, "b", width))).alias("z"))
                side = cells.join(z, "term").select("h", scaled(F.col("z")).alias("p"))
        values, vectors = np.linalg.eigh(_gram_matrix(right, "b", width))
        best = np.argsort(-values)[: self.dim]
        sizes = np.sqrt(np.maximum(values[best], 0))
        turn = vectors[:, best] / np.where(sizes > 1e-9 * max(sizes.max(initial=0), 1e-30), sizes, np.inf)
        return right.select("term", "idf", _times(F.col("b"), turn).alias("v"))

    @staticmethod
    def _orthonormal(gram: np.ndarray) -> np.ndarray:
        """What turns columns with these products into orthonormal ones; directions without size go."""
        values, vectors = np.linalg.eigh(gram)
        keep = values > 1e-12 * max(values.max(initial=0), 1e-300)
        return vectors * np.where(keep, 1 / np.sqrt(np.where(keep, values, 1.0)), 0.0)

    def project(self, texts: DataFrame, known: DataFrame) -> DataFrame:
        """(h, vector) for ``texts`` (h, text)."""
        each = texts.select("h", F.explode(terms(F.col("text"))).alias("term")).groupBy("h", "term").agg(F.count("*").alias("tf"))
        rows = each.join(known, "term").select("h", F.transform("v", lambda x: x * F.col("tf") * F.col("idf")).alias("p"))
        sums = _sum_arrays(rows, "h", F.col("p"), self.dim, "vector")
        return texts.select("h").join(sums, "h", "left").select("h", F.coalesce("vector", F.array(*[F.lit(0.0)] * self.dim)).alias("vector"))

    def _read(self, spark: SparkSession, name: str) -> DataFrame | None:
        if self.folder is None:
            return None
        try:
            return spark.read.parquet(f"{self.folder}/{name}")
        except AnalysisException:  # nothing is held yet
            return None

    def _write(self, df: DataFrame, name: str) -> None:
        if self.folder is not None:
            df.write.mode("append").parquet(f"{self.folder}/{name}")
