"""Evaluation metrics as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.algebra import numbered


def range_of(df: DataFrame, column: str, bins: int) -> Column:
    """The number of a value's range, ranges being cut at approximate quantiles; nulls are in range 0."""
    cuts = sorted(set(df.approxQuantile(column, [i / bins for i in range(1, bins)], 0.01)))
    return F.size(F.filter(F.array(*[F.lit(float(x)) for x in cuts]), lambda x: x < F.col(column))) if cuts else F.lit(0)


def with_offsets(df: DataFrame, sums: dict[str, Column], by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with range ``__b`` joined to each sum over the group's ranges before it; as many rows as a group has ranges are sorted in one place."""
    totals = df.groupBy(*by, F.col("__b").alias("__s")).agg(*[c.alias(k) for k, c in sums.items()])
    before = Window.partitionBy(*by).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(k).alias(f"__g_{k}") for k in by], "__s", *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(k) for k in sums])
    same = F.col("__b") == F.col("__s")
    for k in by:
        same = same & F.col(k).eqNullSafe(F.col(f"__g_{k}"))
    return df.join(offsets if by else F.broadcast(offsets), same).drop("__b", "__s", *[f"__g_{k}" for k in by])


#: A quantile's place is first found to one in so many rows of its group; groups of up to twice as many rows are looked through whole.
ACCURACY = 10_000


def quantiles(df: DataFrame, values: dict[str, Column], at: dict[str, float], by: tuple[str, ...] = ()) -> DataFrame:
    """Exact, interpolated quantiles ``<value>_<place>`` of several values, nulls aside; one row a group, or one in all.

    Mergeable sketches bracket every place of every value and group at once. A
    second pass counts what is below each bracket and the distinct values in
    it, a few in ten thousand, among which the place is then exact; so neither
    a group's values nor their distinct ones are held or sorted anywhere.
    Without values a quantile is null.
    """
    keys = [*by, "__c"]
    slack = 3.0 / ACCURACY
    n = len(at)
    ends = F.array(*[F.lit(min(1.0, max(0.0, q + d))) for d in (-slack, slack) for q in at.values()])
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("__c"), x.cast("double").alias("__x")) for k, x in values.items()])).alias("__v")
    long = df.select(*by, each).select(*by, "__v.*").where("__x IS NOT NULL")
    sketch = long.groupBy(*keys).agg(F.count("*").alias("__all"), F.percentile_approx("__x", ends, F.lit(ACCURACY)).alias("__ends"))
    sketch = sketch.select(*keys, "__all", F.slice("__ends", 1, n).alias("__lo"), F.slice("__ends", n + 1, n).alias("__hi"))
    whole = F.col("__all") < 2 * ACCURACY

    def bracketed(rows: DataFrame) -> DataFrame:
        if not by:
            return rows.join(F.broadcast(sketch), "__c")  # as many rows as values
        a, b = rows.alias("a"), sketch.alias("b")
        return a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]).select("a.*", "__all", "__lo", "__hi")

    places = range(len(at))
    x = F.col("__x")
    inside = whole
    for i in places:
        inside = inside | ((x >= F.col("__lo")[i]) & (x <= F.col("__hi")[i]))
    below = [F.count_if(~whole & (x < F.col("__lo")[i])).alias(f"__b{i}") for i in places]
    g = bracketed(bracketed(long).groupBy(*keys, F.when(inside, x).alias("__y")).agg(F.count("*").alias("__n"), *below))
    group = Window.partitionBy(*keys)
    g = g.select(*keys, "__y", "__n", "__all", "__lo", "__hi", F.array(*[F.sum(f"__b{i}").over(group) for i in places]).alias("__below")).where("__y IS NOT NULL")
    g = g.withColumn("__i", F.explode(F.sequence(F.lit(0), F.lit(len(at) - 1))))
    i, y = F.col("__i"), F.col("__y")
    g = g.where(whole | ((y >= F.get("__lo", i)) & (y <= F.get("__hi", i))))
    upto = Window.partitionBy(*keys, "__i").orderBy("__y").rowsBetween(Window.unboundedPreceding, -1)
    g = g.withColumn("__under", F.get("__below", i) + F.coalesce(F.sum("__n").over(upto), F.lit(0)))
    place = F.get(F.array(*[F.lit(float(q)) for q in at.values()]), i) * (F.col("__all") - 1)
    held = lambda p: F.max(F.when((F.col("__under") <= p) & (p < F.col("__under") + F.col("__n")), y))
    share = F.max(place - F.floor(place))
    found = g.groupBy(*keys, "__i").agg((held(F.floor(place)) * (1 - share) + held(F.ceil(place)) * share).alias("__q"))
    out = [F.max(F.when((F.col("__c") == k) & (i == n), F.col("__q"))).alias(f"{k}_{name}") for k in values for n, name in enumerate(at)]
    return found.groupBy(*by).agg(*out)


def ordinal_ranks(df: DataFrame, columns: list[str], tie: str) -> DataFrame:
    """``df`` with ``rank_<column>``: places from 1 in the order of each column, ties by ``tie``.

    Ranges are of (value, tie), so neither all rows nor those of one value are
    sorted by one task.
    """
    out = df
    for c in columns:
        out = numbered(out, [c, tie], f"rank_{c}").withColumn(f"rank_{c}", F.col(f"rank_{c}") + 1)
    return out


def spearman(df: DataFrame, a: str, b: str, tie: str) -> DataFrame:
    """Pearson correlation of ordinal ranks."""
    return ordinal_ranks(df.select(tie, a, b), [a, b], tie).agg(F.corr(f"rank_{a}", f"rank_{b}").alias("spearman"))


def regression(df: DataFrame, label: str, pred: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Errors, their spread, and explained variance, for all rows or by group; medians are exact."""
    y, e = F.col(label), F.col(pred) - F.col(label)
    n, sse = F.count("*"), F.sum(e * e)
    aggs = {
        "mae": F.avg(F.abs(e)), "mae_var": F.var_samp(F.abs(e)), "mae_std": F.stddev_samp(F.abs(e)), "mae_sem": F.stddev_samp(F.abs(e)) / F.sqrt(n),
        "mse": F.avg(e * e), "rmse": F.sqrt(F.avg(e * e)), "median_ae": None, "max_error": F.max(F.abs(e)),
        "r2": 1 - sse / (F.var_pop(y) * n), "explained_variance": 1 - F.var_pop(e) / F.var_pop(y),
        "mean_residual": F.avg(e), "median_residual": None, "n": n,
    }
    facts = df.groupBy(*by).agg(*[c.alias(k) for k, c in aggs.items() if c is not None])
    medians = quantiles(df, {"ae": F.abs(e), "residual": e}, {"median": 0.5}, by).withColumnsRenamed({"ae_median": "median_ae", "residual_median": "median_residual"})
    return with_quantiles(facts, medians, by).select(*by, *aggs)


def with_quantiles(facts: DataFrame, found: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Facts of groups beside their quantiles; null keys are groups too."""
    if not by:
        return facts.crossJoin(F.broadcast(found))  # single rows
    names = [c for c in found.columns if c not in by]
    a, b = facts.alias("a"), found.alias("b")
    return a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in by], "left").select("a.*", *[f"b.{c}" for c in names])


def score_groups(df: DataFrame, label: str, score: str, by: tuple[str, ...] = (), bins: int = 64) -> DataFrame:
    """Positives and negatives by distinct score within a group, with the numbers of both at lower scores.

    Running sums go within (group, range of scores), offset by the group's
    ranges before, so that no group is sorted in one task.
    """
    g = df.groupBy(*by, score).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.sum(1 - F.col(label).cast("long")).alias("neg"))
    g = g.withColumn("__b", range_of(df, score, bins))
    lower = Window.partitionBy(*by, "__b").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    g = g.withColumns({f"__{k}": F.coalesce(F.sum(k).over(lower), F.lit(0)) for k in ("neg", "pos")})
    g = with_offsets(g, {"__on": F.sum("neg"), "__op": F.sum("pos")}, by)
    return g.select(*by, score, "pos", "neg", (F.col("__neg") + F.col("__on")).alias("neg_below"), (F.col("__pos") + F.col("__op")).alias("pos_below"))


def ranking(df: DataFrame, label: str, score: str, by: tuple[str, ...] = ()) -> DataFrame:
    """AUROC with ties at half, and average precision, over score groups; one row a group, or one in all.

    Sums of products of counts beside what lies below; those above follow from
    the group's totals, which the same aggregate has. A measure without
    positives, or AUROC without negatives, is null.
    """
    g = score_groups(df, label, score, by)
    totals = g.groupBy(*by).agg(F.sum("pos").alias("__pos_all"), F.sum("neg").alias("__neg_all"))
    g = with_quantiles(g, totals, by)
    above = F.col("__pos_all") - F.col("pos_below")
    precision = F.coalesce(above / F.nullif(above + F.col("__neg_all") - F.col("neg_below"), F.lit(0)), F.lit(0.0))
    return g.groupBy(*by).agg(
        (F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2)) / F.nullif(F.first("__pos_all") * F.first("__neg_all"), F.lit(0))).alias("auroc"),
        (F.sum(F.col("pos") * precision) / F.nullif(F.first("__pos_all"), F.lit(0))).alias("ap"),
    )


def one_vs_rest(df: DataFrame, label: str, proba: str) -> DataFrame:
    """Per class, its place in ``proba``, how many rows have it, and how its probability ranks them before the rest; and a row of means over classes.

    Classes that no row has, or all have, rank nothing and are in no mean, and
    the row of means has a null class. Rows without a label or probabilities
    are left out.
    """
    rows = df.where(F.col(label).isNotNull()).select(F.col(label).cast("long").alias("__y"), F.posexplode(proba).alias("class", "__score")).where("__score IS NOT NULL")
    rows = rows.select(F.col("class").cast("long").alias("class"), (F.col("class") == F.col("__y")).cast("long").alias("__is"), F.col("__score").cast("double").alias("__score"))
    counts = rows.groupBy("class").agg(F.sum("__is").alias("n"))
    each = ranking(rows, "__is", "__score", ("class",)).join(counts, "class").select("class", "n", "auroc", F.when(F.col("auroc").isNotNull(), F.col("ap")).alias("ap"))
    macro = each.agg(F.lit(None).cast("long").alias("class"), F.sum("n").alias("n"), F.avg("auroc").alias("auroc"), F.avg("ap").alias("ap"))
    return each.unionByName(macro)


def binary(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Confusion counts and what follows from them; ratios without a base are null."""
    y, p = F.col(label) == 1, F.col(pred) == 1
    c = df.agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    over = lambda a, b: a / F.nullif(b, F.lit(0))
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    c = c.withColumn("n", n).withColumn("n_0", F.col("tn") + F.col("fp")).withColumn("n_1", F.col("tp") + F.col("fn"))
    c = c.withColumn("accuracy", over(F.col("tp") + F.col("tn"), F.col("n"))).withColumn("precision", over(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", over(F.col("tp"), F.col("n_1")))
    c = c.withColumn("f1", over(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))).withColumn("accuracy_var", F.col("accuracy") * (1 - F.col("accuracy")))
    return c.withColumn("accuracy_std", F.sqrt("accuracy_var")).withColumn("accuracy_sem", F.sqrt(F.col("accuracy_var") / F.nullif(F.col("n"), F.lit(0))))


def multiclass(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Accuracy, and precision, recall and F1 averaged over all classes seen."""
    each = F.explode(F.array_distinct(F.array(label, pred))).alias("c")
    by = df.select(label, pred, each).groupBy("c").agg(F.count_if((F.col(label) == F.col("c")) & (F.col(pred) == F.col("c"))).alias("tp"), F.count_if(F.col(pred) == F.col("c")).alias("p"), F.count_if(F.col(label) == F.col("c")).alias("l"))
    zero = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return by.agg(
        (F.sum("tp") / F.sum("l")).alias("accuracy"), F.avg(zero(F.col("tp"), F.col("p"))).alias("macro_precision"), F.avg(zero(F.col("tp"), F.col("l"))).alias("macro_recall"),
        F.avg(zero(2 * F.col("tp"), F.col("p") + F.col("l"))).alias("macro_f1"), F.count("*").alias("n_classes"),
    )


PLACES = {"p01": 0.01, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p99": 0.99}


def distributions(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """One row: of each value extremes, quantiles (interpolated), mean and population deviation."""
    facts = df.agg(*[f(x).alias(f"{v}_{k}") for v, x in values.items() for k, f in (("min", F.min), ("max", F.max), ("mean", F.avg), ("std", F.stddev_pop))])
    return with_quantiles(facts, quantiles(df, values, PLACES), ())


def target_coverage(train: DataFrame, test: DataFrame, target: str, pred: str) -> DataFrame:
    """How well the learnt-from targets cover those to predict, and their shape; all parts are single rows."""
    y = F.col(target)
    a = train.agg(F.count("*").alias("n_train"), F.skewness(y).alias("train_skew"), F.kurtosis(y).alias("train_excess_kurtosis")).crossJoin(distributions(train, {"train": y}))
    a = a.withColumn("train_abs_z_max", F.greatest(F.col("train_max") - F.col("train_mean"), F.col("train_mean") - F.col("train_min")) / F.nullif(F.col("train_std"), F.lit(0.0)))
    ends = train.agg(F.min(y).alias("__min"), F.max(y).alias("__max"))
    b = test.crossJoin(F.broadcast(ends)).agg(
        F.count("*").alias("n_test"), F.avg((y < F.col("__min")).cast("int")).alias("frac_test_below_train_min"), F.avg((y > F.col("__max")).cast("int")).alias("frac_test_above_train_max")
    )
    b = b.crossJoin(distributions(test, {"test": y, "pred": F.col(pred)}))
    b = b.withColumn("frac_test_outside_train_range", F.col("frac_test_below_train_min") + F.col("frac_test_above_train_max"))
    b = b.withColumn("pred_spread_ratio", (F.col("pred_max") - F.col("pred_min")) / F.nullif(F.col("test_max") - F.col("test_min"), F.lit(0.0)))
    return a.crossJoin(b)


def spread(df: DataFrame, by: list[str], value: str, least: int = 2) -> DataFrame:
    """Mean, sample variance, deviation and standard error by group; groups of fewer than ``least`` are left out."""
    x = F.col(value)
    out = df.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.var_samp(x).alias("var"), F.stddev_samp(x).alias("std"), (F.stddev_samp(x) / F.sqrt(F.count(x))).alias("sem"))
    return out.where(F.col("n") >= least)
