"""The model surface: vectorizing, pluggable backbones, extraction, dimension reduction.

Neural backbones are not part of this engine; ``Backbone`` is where one plugs
in. The defaults are ``pyspark.ml`` estimators, so they train and predict as
distributed jobs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.ml.feature import PCA, Imputer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.scalar import argmax, datetime_parts, fixed_width, softmax
from weftline.operators.algebra import column_profile
from weftline.operators.pooling import first_k, interleave, project, sign_matrix
from weftline.session import materialize
from weftline.text import min_hash


class Vectorizer:
    """Mixed columns as float features: numbers as they are, times in parts, arrays in columns, strings by frequent levels.

    With ``min_hashes``, strings of more levels than are known get so many
    columns that agree for similar strings.

    ``fit`` reads the data twice: once for constant columns, once for the levels
    of all strings; ``transform`` is a projection and can be pushed around.
    """

    def __init__(self, levels: int = 8, width: int = 16, exclude: tuple[str, ...] = (), min_hashes: int = 0):
        self.levels, self.width, self.exclude, self.min_hashes = levels, width, set(exclude), min_hashes
        self.many: set[str] = set()
        self.columns: list[tuple[str, str]] = []
        self.known: dict[str, list[str]] = {}

    def fit(self, df: DataFrame) -> Vectorizer:
        constant = {r.column_name for r in column_profile(df.select(*[f.name for f in df.schema if not isinstance(f.dataType, T.MapType)])).where("is_constant").collect()}
        for f in df.schema:
            if f.name in constant | self.exclude:
                continue
            kind = "number" if isinstance(f.dataType, (T.NumericType, T.BooleanType)) else "time" if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)) else "array" if isinstance(f.dataType, T.ArrayType) else "string"
            self.columns.append((f.name, kind))
        self.known = {c: [] for c, kind in self.columns if kind == "string"}
        if self.known:
            each = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in self.known])).alias("x")
            counts = df.select(each).select("x.*").where("v IS NOT NULL").groupBy("c", "v").agg(F.count("*").alias("n"))
            best = Window.partitionBy("c").orderBy(F.desc("n"), "v")
            for r in counts.withColumn("r", F.row_number().over(best)).where(F.col("r") <= self.levels + 1).orderBy("c", "r").collect():  # a few levels a column
                if r.r > self.levels:
                    self.many.add(r.c)
                else:
                    self.known[r.c].append(r.v)
        return self

    def transform(self, df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
        out = {}
        for name, kind in self.columns:
            if kind == "number":
                out[name] = F.col(name).cast("float")
            elif kind == "time":
                out |= {k: c.cast("float") for k, c in datetime_parts(F.col(name), name).items()}
            elif kind == "array":
                out |= fixed_width(name, self.width)
            else:
                out |= {f"{name}_{i}": (F.col(name).cast("string") == v).cast("float") for i, v in enumerate(self.known[name])}
                if name in self.many:
                    out |= {f"{name}__mh_{i}": c.cast("float") for i, c in enumerate(min_hash(F.col(name).cast("string"), self.min_hashes))}
        return df.select(*keep, *[c.alias(k) for k, c in out.items()])


class IdentityVectorizer:
    """Columns as they are, for backbones that take mixed types themselves; only constant ones are left out."""

    def __init__(self, exclude: tuple[str, ...] = ()):
        self.exclude = set(exclude)
        self.columns: list[str] = []

    def fit(self, df: DataFrame) -> IdentityVectorizer:
        rows = df.select(*[f.name for f in df.schema if not isinstance(f.dataType, T.MapType)])
        self.columns = [r.column_name for r in column_profile(rows).where("NOT is_constant").collect() if r.column_name not in self.exclude]
        return self

    def transform(self, df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
        return df.select(*keep, *self.columns)


class Backbone(Protocol):
    """A tabular model: learns from features and a target, adds ``proba`` (array) or ``y_pred``."""

    def predict(self, train: DataFrame, test: DataFrame, features: list[str], target: str) -> DataFrame: ...


class LinearBackbone:
    """Logistic or linear regression on mean-imputed features; without features, what is most likely of all rows."""

    def __init__(self, regression: bool = False, ridge: float = 0.01):
        self.regression, self.ridge = regression, ridge

    def predict(self, train: DataFrame, test: DataFrame, features: list[str], target: str) -> DataFrame:
        from pyspark.ml import Pipeline
        from pyspark.ml.classification import LogisticRegression
        from pyspark.ml.regression import LinearRegression

        if not features:
            train, test, features = train.withColumn("__none", F.lit(0.0)), test.withColumn("__none", F.lit(0.0)), ["__none"]
        filled = [f"__f_{i}" for i in range(len(features))]
        impute = Imputer(inputCols=features, outputCols=filled)
        assemble = VectorAssembler(inputCols=filled, outputCol="__x")
        model = (LinearRegression if self.regression else LogisticRegression)(featuresCol="__x", labelCol=target, regParam=self.ridge, predictionCol="__y")
        out = Pipeline(stages=[impute, assemble, model]).fit(train).transform(test)
        out = out.withColumn("y_pred", F.col("__y")) if self.regression else out.withColumn("proba", vector_to_array("probability")).withColumn("y_pred", F.col("__y").cast("int"))
        return out.drop("__x", "__y", "probability", "rawPrediction", "__none", *filled)


class BayesBackbone:
    """Gaussian naive Bayes: closed form from one aggregation, in the JVM throughout.

    A feature that is null says nothing; a variance has a floor.
    """

    def __init__(self, floor: float = 1e-3):
        self.floor = floor

    def predict(self, train: DataFrame, test: DataFrame, features: list[str], target: str) -> DataFrame:
        y = F.col(target).cast("long")
        x = lambda c: F.col(c).cast("double")
        aggs = [F.count("*").alias("n"), *[a for c in features for a in (F.avg(x(c)).alias(f"m_{c}"), F.var_pop(x(c)).alias(f"v_{c}"))]]
        found = sorted(train.where(y.isNotNull()).groupBy(y.alias("k")).agg(*aggs).collect(), key=lambda r: r.k)  # a row a class
        total = sum(r.n for r in found)

        def log_likelihood(r) -> Column:
            out = F.lit(math.log(r.n / total))
            for c in features:
                m, v = r[f"m_{c}"], r[f"v_{c}"]
                if m is not None:
                    v = max(v, self.floor)
                    out = out + F.coalesce(-(x(c) - m) * (x(c) - m) / (2 * v) - 0.5 * math.log(2 * math.pi * v), F.lit(0.0))
            return out

        logs = F.array(*[log_likelihood(r) for r in found]) if found else F.lit(None).cast("array<double>")
        classes = F.array(*[F.lit(r.k) for r in found]) if found else F.lit(None).cast("array<bigint>")
        out = test.withColumn("proba", softmax(logs))
        return out.withColumn("y_pred", F.get(classes, argmax(F.col("proba"))).cast("int"))


class FrameBackbone:
    """Any in-memory model ``f(train features, train target, test features) -> probabilities``, batch by batch.

    The context is a bounded sample, the rows with the smallest hashes, which
    travels with the function; test rows stream past it in Arrow batches.
    """

    def __init__(self, model: Callable[[pd.DataFrame, pd.Series, pd.DataFrame], list], most_context: int = 50_000):
        self.model, self.most_context = model, most_context

    def predict(self, train: DataFrame, test: DataFrame, features: list[str], target: str) -> DataFrame:
        rows = train.select(*features, target)
        context = rows.orderBy(F.xxhash64(*rows.columns), *rows.columns).limit(self.most_context).toPandas()
        model = self.model

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield b.assign(proba=list(model(context[features], context[target], b[features])))

        schema = T.StructType([*test.schema.fields, T.StructField("proba", T.ArrayType(T.DoubleType()))])
        return test.mapInPandas(run, schema)


def extract(df: DataFrame, features: list[str], dim: int, keep: list[str], seed: int = 1, activation: str | None = None, estimators: int = 1) -> DataFrame:
    """Default row embeddings: standardised features, missing ones at their mean, through a sign projection.

    Every estimator has a projection of its own, by its seed; an embedding
    holds those of all, one after another, so that they are pooled together.
    With ``relu`` elements below 0 become 0, so that pooled embeddings tell
    apart rows whose features agree column by column.
    """
    if not features:
        return df.select(*keep, F.array(*[F.lit(0.0)] * (dim * estimators)).alias("emb"))
    value = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    stats = df.agg(*[F.struct(F.avg(value(c)).alias("m"), F.stddev_pop(value(c)).alias("s")).alias(c) for c in features]).first()
    z = [F.coalesce((value(c) - F.lit(stats[c]["m"])) / F.lit(stats[c]["s"] or 1.0), F.lit(0.0)) if stats[c]["m"] is not None else F.lit(0.0) for c in features]
    out = project(F.array(*z), [row for e in range(estimators) for row in sign_matrix(dim, len(features), seed + e)])
    if activation == "relu":
        out = F.transform(out, lambda v: F.greatest(v, F.lit(0.0)))
    elif activation:
        raise ValueError(activation)
    return df.select(*keep, out.alias("emb"))


def gaussian_matrix(rows: int, columns: int, seed: int = 1, density: float = 1.0) -> list[list[float]]:
    """A random projection, dense or sparse, drawn from a seeded stream."""
    import numpy as np

    rng = np.random.default_rng(seed)
    m = rng.standard_normal((rows, columns)) if density == 1.0 else rng.choice([-1.0, 0.0, 1.0], (rows, columns), p=[density / 2, 1 - density, density / 2]) / density**0.5
    return (m / rows**0.5).tolist()


def random_places(width: int, dim: int, seed: int = 1) -> list[int]:
    """Places of an array drawn without replacement."""
    import random

    return random.Random(seed).sample(range(width), min(dim, width))


def impute_mean(df: DataFrame, embedding: str, width: int) -> DataFrame:
    """Missing elements at the mean of their place."""
    x = lambda i: F.get(embedding, F.lit(i)).cast("double")
    means = df.agg(*[F.avg(F.when(~F.isnan(x(i)), x(i))).alias(f"m{i}") for i in range(width)]).first()
    return df.withColumn(embedding, F.array(*[F.coalesce(F.when(~F.isnan(x(i)), x(i)), F.lit(float(means[i] or 0.0))) for i in range(width)]))


def reduce_dims(df: DataFrame, embedding: str, width: int, method: str, dim: int, seed: int = 1) -> DataFrame:
    """Arrays of ``width`` reduced to ``dim``: random projections, PCA or SVD with or without whitening, random or first places.

    Fits are distributed; what comes to the driver is width x width at most.
    Components beyond the data's rank are zeros. All-missing input gives the
    first places.
    """
    x = F.col(embedding)
    if method == "first_k" or df.where(x.isNotNull()).isEmpty():
        return df.withColumn(embedding, first_k(x, dim))
    df = impute_mean(df, embedding, width)
    if method == "random_k":
        at = random_places(width, dim, seed)
        return df.withColumn(embedding, F.array(*[F.get(x, F.lit(i)) for i in at], *[F.lit(0.0)] * (dim - len(at))))
    if method in ("gaussian_random_projection", "sparse_random_projection", "sign_random_projection"):
        m = sign_matrix(dim, width, seed) if method.startswith("sign") else gaussian_matrix(dim, width, seed, 1.0 if method.startswith("gauss") else width**-0.5)
        return df.withColumn(embedding, project(x, m))
    k = min(dim, width)
    whiten, kind = method.endswith("_whiten"), method.removesuffix("_whiten")
    rows = df.withColumn("__v", array_to_vector(x))
    if kind == "pca":
        model = PCA(k=k, inputCol="__v", outputCol="__o").fit(rows)
        parts = model.pc.toArray().T
        mean = df.agg(*[F.avg(F.get(x, F.lit(i))) for i in range(width)]).first()
        shift = [-sum(p * m for p, m in zip(row, mean)) for row in parts]
    else:
        from pyspark.mllib.linalg.distributed import RowMatrix
        from pyspark.mllib.util import MLUtils

        svd = RowMatrix(MLUtils.convertVectorColumnsFromML(rows.select("__v"), "__v")).computeSVD(k)  # Gram matrix in the JVM
        parts, shift = svd.V.toArray().T, [0.0] * k
    out = F.zip_with(project(x, parts.tolist()), F.array(*[F.lit(float(s)) for s in shift[: len(parts)]]), lambda a, b: a + b)
    df = df.withColumn(embedding, out)
    if whiten:
        sd = df.agg(*[F.stddev_pop(F.get(x, F.lit(i))) for i in range(len(parts))]).first()
        df = df.withColumn(embedding, F.zip_with(x, F.array(*[F.lit(1.0 / s if s else 0.0) for s in sd]), lambda a, b: a * b))
    return df.withColumn(embedding, first_k(x, dim))


def reduce_estimators(df: DataFrame, embedding: str, estimators: int, width: int, method: str, dim: int, seed: int = 1, apart: bool = False) -> DataFrame:
    """Embeddings of ``estimators`` times ``width`` elements reduced to ``dim``: jointly, or each estimator's ``apart`` to ``dim`` of its own."""
    x = F.col(embedding)
    if not apart:
        return reduce_dims(df.withColumn(embedding, interleave(x, estimators, width)), embedding, estimators * width, method, dim, seed)
    names = [f"__e{i}" for i in range(estimators)]
    df = df.withColumns({n: F.slice(x, i * width + 1, width) for i, n in enumerate(names)})
    for n in names:
        df = reduce_dims(df, n, width, method, dim, seed)
    return df.withColumn(embedding, F.concat(*names)).drop(*names)


def embed_text(df: DataFrame, column: str, dim: int = 32, prefix: str | None = None, hashed: int = 256, reduce: str | None = None, seed: int = 1) -> DataFrame:
    """Text features: each distinct value hashed to ``dim`` signed term frequencies, joined back.

    With ``reduce``, terms are hashed to ``hashed`` places, and those reduced to
    ``dim`` by the method, which is fitted on the distinct values.
    """
    prefix = prefix or f"{column}__txt_"
    places = hashed if reduce else dim
    values = df.select(F.col(column).alias("__s")).where("__s is not null").distinct()
    bits = F.conv(F.substring(F.md5("w"), 1, 13), 16, 10).cast("long")
    words = values.select("__s", F.explode(F.split(F.lower("__s"), r"\s+")).alias("w")).withColumn("__h", bits)
    each = words.select("__s", F.pmod("__h", F.lit(places)).alias("i"), F.when(F.pmod(F.shiftright("__h", 32), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("v"))
    sums = each.groupBy("__s", "i").agg(F.sum("v").alias("v"))
    held = F.map_from_entries(F.collect_list(F.struct("i", "v")))  # at most ``places`` entries
    dense = F.transform(F.sequence(F.lit(0), F.lit(places - 1)), lambda i: F.coalesce(F.element_at("__m", i.cast("long")), F.lit(0.0)))
    arrays = sums.groupBy("__s").agg(held.alias("__m")).select("__s", dense.alias("__e"))
    if reduce:
        arrays = reduce_dims(materialize(arrays, "texts"), "__e", places, reduce, dim, seed)
    wide = arrays.select("__s", *[F.get("__e", F.lit(i)).cast("float").alias(f"{prefix}{i}") for i in range(dim)])
    return df.join(wide, df[column] == wide["__s"], "left").drop("__s")
