"""Analytics over predictions and results: ensembles, differences, ranks, wins, regret, marginals."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.scalar import argmax, ensemble_proba
from weftline.operators.metrics import quantiles, with_quantiles

KEYS = ["key", "cutoff_timestamp"]


def join_predictions(preds: list[DataFrame]) -> DataFrame:
    """Predictions of one task side by side by key and cutoff, columns suffixed by member."""
    out = None
    for i, p in enumerate(preds):
        p = p.withColumnsRenamed({c: f"{c}_{i}" for c in p.columns if c not in KEYS})
        out = p if out is None else out.join(p, KEYS)
    return out


def check_joined(joined: DataFrame, n: int, members: int) -> None:
    """Raises where members differ in rows or labels."""
    same = reduce(lambda a, b: a & b, (F.col("y_true_0").eqNullSafe(F.col(f"y_true_{i}")) for i in range(members)))
    rows, bad = joined.agg(F.count("*"), F.count_if(~same)).first()
    if rows != n or bad:
        raise ValueError(f"members don't match: {rows} joined rows of {n}, {bad} labels differ")


def ensemble(preds: list[DataFrame], logits: bool = True) -> DataFrame:
    """Classification members as one: mean log probabilities by softmax, or mean probabilities."""
    j = join_predictions(preds).withColumn("proba", ensemble_proba([F.col(f"proba_{i}") for i in range(len(preds))], logits))
    return j.select(*KEYS, F.col("y_true_0").alias("y_true"), argmax(F.col("proba")).alias("y_pred"), F.array_max("proba").alias("p_pred"), "proba")


def ensemble_regression(preds: list[DataFrame]) -> DataFrame:
    """Regression members as their mean."""
    total = reduce(lambda a, b: a + b, (F.col(f"y_pred_{i}") for i in range(len(preds))))
    return join_predictions(preds).select(*KEYS, F.col("y_true_0").alias("y_true"), (total / len(preds)).alias("y_pred"))


def diff(preds: list[DataFrame]) -> DataFrame:
    """Rows in which members predict differently."""
    all_preds = F.array(*[F.col(f"y_pred_{i}") for i in range(len(preds))])
    return join_predictions(preds).where(F.size(F.array_distinct(all_preds)) > 1).select(*KEYS, F.col("y_true_0").alias("y_true"), all_preds.alias("y_preds"))


def full_join_trials(studies: list[DataFrame], key: str = "number") -> DataFrame:
    """Trials of studies by number, whichever study has them; columns suffixed by study."""
    out = None
    for i, s in enumerate(studies):
        s = s.withColumnsRenamed({c: f"{c}_{i}" for c in s.columns if c != key})
        out = s if out is None else out.join(s, key, "full")
    return out


def dense_rank(df: DataFrame, by: list[str], value: str, name: str = "rank") -> DataFrame:
    """Dense ranks by falling value within a study; nulls share the last."""
    return df.withColumn(name, F.dense_rank().over(Window.partitionBy(*by).orderBy(F.col(value).desc_nulls_last())))


def mean_rank(df: DataFrame, task: str, model: str, value: str) -> DataFrame:
    """Each model's average over tasks of its rank, equal values sharing the mean of their places, nulls last."""
    w = Window.partitionBy(task).orderBy(F.col(value).desc_nulls_last())
    place = F.rank().over(w) + (F.count("*").over(Window.partitionBy(task, value)) - 1) / 2
    return df.withColumn("__r", place).groupBy(model).agg(F.avg("__r").alias("mean_rank"), F.count("*").alias("n_tasks"))


def best_per_task(df: DataFrame, task: str, value: str, digits: int = 2) -> DataFrame:
    """Rows whose value, as printed, equals the best of their task."""
    shown = F.round(value, digits)
    return df.withColumn("is_best", F.coalesce(shown == F.max(shown).over(Window.partitionBy(task)), F.lit(False)))


def win_matrix(df: DataFrame, metrics: list[str], lower: dict[str, bool]) -> DataFrame:
    """For ordered pairs of models: wins, losses, shared tasks, and tasks decided by a metric that isn't the first.

    A task counts by the first of ``metrics`` both report. Rows: model, task,
    and a column per metric. The join is by task, of which each model has one row.
    """
    a, b = df.alias("a"), df.alias("b")
    pairs = a.join(b, (F.col("a.task") == F.col("b.task")) & (F.col("a.model") != F.col("b.model")))
    both = [F.col(f"a.{m}").isNotNull() & F.col(f"b.{m}").isNotNull() for m in metrics]
    sign = lambda m: F.signum((F.col(f"b.{m}") - F.col(f"a.{m}")) if lower[m] else (F.col(f"a.{m}") - F.col(f"b.{m}")))
    outcome = F.coalesce(*[F.when(ok, sign(m)) for ok, m in zip(both, metrics)])
    rows = pairs.select(F.col("a.model").alias("model"), F.col("b.model").alias("other"), outcome.alias("o"), both[0].alias("first")).where("o is not null")
    return rows.groupBy("model", "other").agg(F.count_if(F.col("o") > 0).alias("wins"), F.count_if(F.col("o") < 0).alias("losses"), F.count("*").alias("shared"), F.count_if(~F.col("first")).alias("fallback"))


def regret(df: DataFrame, task: str, value: str, maximize: bool = True) -> DataFrame:
    """Distance from the task's best, and that over the task's interquartile range where it has one."""
    x = F.col(value)
    facts = df.where(F.col(task).isNotNull()).groupBy(task).agg((F.max(x) if maximize else F.min(x)).alias("__best"))
    facts = with_quantiles(facts, quantiles(df, {"x": x}, {"q25": 0.25, "q75": 0.75}, (task,)), (task,))
    iqr = F.col("x_q75") - F.col("x_q25")
    r = F.col("__best") - x if maximize else x - F.col("__best")
    return df.join(facts, task).withColumn("regret", r).withColumn("norm_regret", F.when(iqr > 0, F.col("regret") / iqr)).drop("__best", "x_q25", "x_q75")


def relative_cost(df: DataFrame, task: str, variant: str, cost: str) -> DataFrame:
    """Geometric mean over tasks of a variant's cost against the task's cheapest."""
    ratio = F.col(cost) / F.min(cost).over(Window.partitionBy(task))
    return df.withColumn("__q", ratio).groupBy(variant).agg(F.exp(F.avg(F.log("__q"))).alias("relative_cost"))


def marginals(df: DataFrame, params: list[str], task: str, loss: str) -> DataFrame:
    """For each level of each parameter: mean loss, its standard error, and in how many tasks its mean is the least (ties count for all)."""
    long = df.select(task, loss, F.explode(F.array(*[F.struct(F.lit(p).alias("param"), F.col(p).cast("string").alias("level")) for p in params])).alias("x")).select(task, loss, "x.*")
    each = long.groupBy("param", "level").agg(F.avg(loss).alias("mean"), (F.stddev_samp(loss) / F.sqrt(F.count(loss))).alias("sem"))
    per_task = long.groupBy("param", "level", task).agg(F.avg(loss).alias("m"))
    wins = per_task.withColumn("w", F.col("m") == F.min("m").over(Window.partitionBy("param", task))).groupBy("param", "level").agg(F.count_if("w").alias("wins"))
    return each.join(wins, ["param", "level"])


def value_summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Count, mean, deviation, extremes and quartiles by group."""
    x = F.col(value)
    facts = df.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))
    quarters = quantiles(df, {"x": x}, {"q25": 0.25, "median": 0.5, "q75": 0.75}, tuple(by))
    out = with_quantiles(facts, quarters, tuple(by))
    return out.select(*by, "n", "mean", "std", "min", F.col("x_q25").alias("q25"), F.col("x_median").alias("median"), F.col("x_q75").alias("q75"), "max")


def rowwise(df: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """Statistics across the columns of each row, nulls aside; no aggregation, so no shuffle.

    Sums are written out over the columns; only the median needs them sorted.
    """
    x = [F.col(f"__x{i}") for i in range(len(columns))]
    df = df.select(*keep, *[F.col(c).cast("double").alias(f"__x{i}") for i, c in enumerate(columns)])
    plus = lambda terms: reduce(add, terms, F.lit(0.0))
    df = df.withColumns({"n": reduce(add, [v.isNotNull().cast("int") for v in x], F.lit(0)), "sum": plus(F.coalesce(v, F.lit(0.0)) for v in x)})
    df = df.withColumns({"mean": F.col("sum") / F.nullif(F.col("n"), F.lit(0)), "__a": F.array_sort(F.array(*x))})  # nulls last
    middle = lambda i: F.get("__a", F.floor(i).cast("int"))
    median = F.when(F.col("n") > 0, (middle((F.col("n") - 1) / 2) + middle(F.col("n") / 2)) / 2)
    squares = plus(F.coalesce((v - F.col("mean")) * (v - F.col("mean")), F.lit(0.0)) for v in x)
    return df.select(*keep, "n", "sum", "mean", median.alias("median"), F.sqrt(squares / F.nullif(F.col("n") - 1, F.lit(0))).alias("std"))


def disambiguate(df: DataFrame, name: str, extra: Column, out: str = "label") -> DataFrame:
    """A label of its own for each row: the name, with something appended where rows share it."""
    shared = F.count("*").over(Window.partitionBy(name)) > 1
    return df.withColumn(out, F.when(shared, F.concat(F.col(name), F.lit(" ("), extra, F.lit(")"))).otherwise(F.col(name)))
