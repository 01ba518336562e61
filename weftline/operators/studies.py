"""Trials of hyper-parameter studies, lookups and checks around result tables."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.results import join_predictions


def trials_with_tests(trials: DataFrame, tests: DataFrame, key: str = "number") -> DataFrame:
    """Trials with their durations in seconds and, where a trial was tested, its test results."""
    secs = (F.unix_micros(F.col("complete").cast("timestamp")) - F.unix_micros(F.col("start").cast("timestamp"))) / 1e6
    return trials.withColumn("duration_s", secs).join(tests, key, "left")


def winners(df: DataFrame, by: list[str], value: str, tie: str, reference: DataFrame | None = None) -> DataFrame:
    """The row of the least value per group, joined to a reference on the group; raises where the reference lacks a group."""
    best = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.min_by(F.struct(*[c for c in df.columns if c not in by]), F.struct(value, tie)).alias("r")).select(*by, "r.*")
    if reference is None:
        return best
    if not best.join(reference, by, "left_anti").isEmpty():
        raise ValueError("the reference lacks a group")
    return best.join(reference, by)


def first_complete(df: DataFrame, state: str, order: list[str]) -> DataFrame:
    """The first row in state COMPLETE of an order."""
    return df.where(F.col(state) == "COMPLETE").orderBy(*order).limit(1)


def head_of_known(df: DataFrame, column: str, order: str, n: int) -> DataFrame:
    """The first n rows whose column isn't null."""
    return df.where(F.col(column).isNotNull()).orderBy(order).limit(n)


def split_name(name: Column, sep: str = "_") -> tuple[Column, Column]:
    """A name's part before its first separator, and the rest."""
    return F.substring_index(name, sep, 1), F.substring(name, F.length(F.substring_index(name, sep, 1)) + 2, F.length(name))


def strip_affix(name: Column, prefix: str = "^params_", suffix: str = "_[0-9]+$") -> Column:
    """A parameter's name without its study's prefix and number."""
    return F.regexp_replace(F.regexp_replace(name, prefix, ""), suffix, "")


def lookup(column: Column, values: dict, default=None) -> Column:
    """A small mapping as a literal map."""
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), column), F.lit(default)) if default is not None else F.element_at(F.create_map(*pairs), column)


def check_disjoint(a: DataFrame, b: DataFrame) -> None:
    """Raises where two frames share a row."""
    if not a.intersect(b).isEmpty():
        raise ValueError("the sets share rows")


def check_numeric(df: DataFrame) -> None:
    """Raises where a column is neither a number nor a flag nor a string level."""
    bad = [f"{c}: {t}" for c, t in df.dtypes if t.split("(")[0] not in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal", "boolean", "string")]
    if bad:
        raise TypeError(f"columns a model can't take: {bad}")


def subset_ensembles(preds: list[DataFrame], most: int = 10) -> DataFrame:
    """Accuracy of the mean probabilities of every non-empty subset of members, in one pass over the joined predictions."""
    if len(preds) > most:
        raise ValueError(f"2^{len(preds)} subsets are too many")
    j = join_predictions(preds)
    p = [F.element_at(f"proba_{i}", 2) for i in range(len(preds))]
    sets = [s for k in range(1, len(preds) + 1) for s in combinations(range(len(preds)), k)]
    right = lambda s: F.avg(((reduce(lambda a, b: a + b, (p[i] for i in s)) / len(s) > 0.5).cast("int") == F.col("y_true_0")).cast("int"))
    row = j.agg(*[right(s).alias(f"s{n}") for n, s in enumerate(sets)])
    out = F.explode(F.array(*[F.struct(F.lit(",".join(map(str, s))).alias("members"), F.lit(len(s)).alias("size"), F.col(f"s{n}").alias("accuracy")) for n, s in enumerate(sets)]))
    return row.select(out.alias("r")).select("r.*")


def split_sizes(rows: DataFrame, by: str, split: str, splits: list[str]) -> DataFrame:
    """Rows per group and split, as one column per split."""
    return rows.groupBy(by).pivot(split, splits).count().select(by, *[F.coalesce(s, F.lit(0)).alias(f"rows_{s}") for s in splits])
