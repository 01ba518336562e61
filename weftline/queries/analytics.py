"""Metrics, ensembles, and analytics of results."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import scalar
from weftline.operators import metrics, results
from weftline.queries.base import PREDS_SQL, SCORES_SQL, preds, query, r6, rounded, scores

_REG = "reg AS (SELECT o_orderkey, o_totalprice AS y, o_totalprice + (o_orderkey * 7919 % 1000 - 500) * 10.0 AS p FROM orders)"


def _reg(t):
    return t.orders.select("o_orderkey", F.col("o_totalprice").alias("y"), (F.col("o_totalprice") + (F.col("o_orderkey") * 7919 % 1000 - 500) * F.lit(10.0)).alias("p"))


@query(f"""WITH {_REG}, e AS (SELECT *, p - y AS e, abs(p - y) AS a FROM reg), x AS (
SELECT avg(a) AS mae, var_samp(a) AS mae_var, stddev_samp(a) AS mae_std, stddev_samp(a) / sqrt(count(*)) AS mae_sem, avg(e * e) AS mse, sqrt(avg(e * e)) AS rmse,
 median(a) AS median_ae, max(a) AS max_error, 1 - sum(e * e) / (var_pop(y) * count(*)) AS r2, 1 - var_pop(e) / var_pop(y) AS explained_variance, avg(e) AS mean_residual, median(e) AS median_residual, count(*) AS n FROM e)
SELECT round(mae, 3) AS mae, round(mae_var, 1) AS mae_var, round(mae_std, 3) AS mae_std, round(mae_sem, 4) AS mae_sem, round(mse, 1) AS mse, round(rmse, 3) AS rmse, round(median_ae, 3) AS median_ae,
 round(max_error, 3) AS max_error, round(r2, 8) AS r2, round(explained_variance, 8) AS explained_variance, round(mean_residual, 4) AS mean_residual, round(median_residual, 3) AS median_residual, n FROM x""")
def metrics_regression(t):
    digits = {"mae": 3, "mae_var": 1, "mae_std": 3, "mae_sem": 4, "mse": 1, "rmse": 3, "median_ae": 3, "max_error": 3, "r2": 8, "explained_variance": 8, "mean_residual": 4, "median_residual": 3}
    m = metrics.regression(_reg(t), "y", "p")
    return m.select(*[F.round(c, digits[c]).alias(c) if c in digits else c for c in m.columns])


_BIN = "bin AS (SELECT c_custkey, c_custkey % 2 AS y, (c_custkey * 7919 % 97) / CAST(97 AS DOUBLE) + (c_custkey % 2) * CAST(0.2 AS DOUBLE) AS s FROM customer)"


def _bin(t):
    s = (F.col("c_custkey") * 7919 % 97) / F.lit(97.0) + (F.col("c_custkey") % 2) * F.lit(0.2)
    return t.customer.select("c_custkey", (F.col("c_custkey") % 2).alias("y"), s.alias("s"))


@query(f"""WITH {_BIN}, c AS (SELECT count(*) FILTER (y = 1 AND s > 0.5) AS tp, count(*) FILTER (y = 0 AND s > 0.5) AS fp, count(*) FILTER (y = 1 AND s <= 0.5) AS fn, count(*) FILTER (y = 0 AND s <= 0.5) AS tn FROM bin),
d AS (SELECT *, tp + fp + fn + tn AS n, tn + fp AS n_0, tp + fn AS n_1, (tp + tn) / (tp + fp + fn + tn) AS accuracy FROM c)
SELECT tp, fp, fn, tn, n, n_0, n_1, round(accuracy, 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / n_1, 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1,
round(accuracy * (1 - accuracy), 6) AS accuracy_var, round(sqrt(accuracy * (1 - accuracy)), 6) AS accuracy_std, round(sqrt(accuracy * (1 - accuracy) / n), 6) AS accuracy_sem FROM d""")
def metrics_binary(t):
    return rounded(metrics.binary(_bin(t).withColumn("p", (F.col("s") > 0.5).cast("int")), "y", "p"))


@query(f"""WITH {_BIN}, g AS (SELECT s, sum(y) AS pos, sum(1 - y) AS neg FROM bin GROUP BY s),
w AS (SELECT *, coalesce(sum(neg) OVER b, 0) AS nb, coalesce(sum(pos) OVER b, 0) AS pb, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM g WINDOW b AS (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT round(sum(CAST(pos AS DOUBLE) * (nb + neg / 2)) / (max(p) * max(n)), 6) AS auroc, round(sum(CAST(pos AS DOUBLE) * (p - pb) / (p - pb + n - nb)) / max(p), 6) AS ap FROM w""")
def metrics_ranking(t):
    return rounded(metrics.ranking(_bin(t), "y", "s"))


@query("""WITH x AS (SELECT c_nationkey % 4 AS y, c_custkey % 4 AS p FROM customer), k AS (SELECT DISTINCT c FROM (SELECT y AS c FROM x UNION ALL SELECT p FROM x)),
b AS (SELECT c, count(*) FILTER (y = c AND p = c) AS tp, count(*) FILTER (p = c) AS np, count(*) FILTER (y = c) AS ny FROM x CROSS JOIN k GROUP BY c)
SELECT round(sum(tp) / sum(ny), 6) AS accuracy, round(avg(CASE WHEN np > 0 THEN tp / np ELSE 0 END), 6) AS macro_precision, round(avg(CASE WHEN ny > 0 THEN tp / ny ELSE 0 END), 6) AS macro_recall,
round(avg(CASE WHEN np + ny > 0 THEN 2 * tp / (np + ny) ELSE 0 END), 6) AS macro_f1, count(*) AS n_classes FROM b""")
def metrics_multiclass(t):
    rows = t.customer.select((F.col("c_nationkey") % 4).cast("long").alias("y"), (F.col("c_custkey") % 4).alias("p"))
    return rounded(metrics.multiclass(rows, "y", "p"))


_OVR = """x AS (SELECT c_custkey, c_nationkey % 5 AS y, (c_custkey * 7919 % 211 + 1) AS a, (c_custkey * 104729 % 97 + 1) AS b, (c_custkey * 31 % 53 + 1 + 40 * CAST(c_nationkey % 5 = 2 AS INT)) AS c, 7 AS d FROM customer),
l AS (SELECT y = k AS p, k, round(CASE k WHEN 0 THEN a WHEN 1 THEN b WHEN 2 THEN c ELSE d END / CAST(a + b + c + d AS DOUBLE), 4) AS s FROM x CROSS JOIN (VALUES (0), (1), (2), (3)) v(k)),
g AS (SELECT k, s, count(*) FILTER (p) AS pos, count(*) FILTER (NOT p) AS neg FROM l GROUP BY ALL),
w AS (SELECT *, coalesce(sum(neg) OVER lo, 0) AS nb, sum(pos) OVER hi AS pa, sum(neg) OVER hi AS na FROM g
 WINDOW lo AS (PARTITION BY k ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), hi AS (PARTITION BY k ORDER BY s DESC ROWS UNBOUNDED PRECEDING)),
m AS (SELECT CAST(k AS BIGINT) AS class, CAST(sum(pos) AS BIGINT) AS n, sum(pos * (nb + neg / 2)) / nullif(sum(pos) * sum(neg), 0) AS auroc, sum(pos * pa / (pa + na)) / nullif(sum(pos), 0) AS ap FROM w GROUP BY k)"""


@query(f"""WITH {_OVR} SELECT class, n, round(auroc, 6) AS auroc, round(ap, 6) AS ap FROM m UNION ALL SELECT NULL, CAST(sum(n) AS BIGINT), round(avg(auroc), 6), round(avg(ap), 6) FROM m""")
def metrics_one_vs_rest(t):
    k, hit = F.col("c_custkey"), (F.col("c_nationkey") % 5 == 2).cast("int")
    parts = [k * 7919 % 211 + 1, k * 104729 % 97 + 1, k * 31 % 53 + 1 + 40 * hit, F.lit(7)]
    rows = t.customer.select((F.col("c_nationkey") % 5).alias("y"), F.array(*[F.round(p / sum(parts[1:], parts[0]), 4) for p in parts]).alias("proba"))
    return rounded(metrics.one_vs_rest(rows, "y", "proba"))


_REG_BY = """SELECT o_orderpriority, round(avg(a), 3) AS mae, round(median(a), 3) AS median_ae, round(median(e), 3) AS median_residual, count(*) AS n
FROM (SELECT o_orderpriority, (o_orderkey * 7919 % 1000 - 500) * 10.0 + o_totalprice - o_totalprice AS e, abs((o_orderkey * 7919 % 1000 - 500) * 10.0 + o_totalprice - o_totalprice) AS a FROM orders) GROUP BY 1"""


@query(_REG_BY)
def metrics_regression_by(t):
    rows = t.orders.select("o_orderpriority", F.col("o_totalprice").alias("y"), (F.col("o_totalprice") + (F.col("o_orderkey") * 7919 % 1000 - 500) * F.lit(10.0)).alias("p"))
    m = metrics.regression(rows, "y", "p", ("o_orderpriority",))
    return m.select("o_orderpriority", *[F.round(c, 3).alias(c) for c in ("mae", "median_ae", "median_residual")], "n")


def _dist(c: str, p: str) -> str:
    q = ", ".join(f"round(quantile_cont({c}, {v}), 4) AS {p}_{n}" for n, v in (("p01", 0.01), ("p25", 0.25), ("p50", 0.5), ("p75", 0.75), ("p99", 0.99)))
    return f"round(min({c}), 4) AS {p}_min, round(max({c}), 4) AS {p}_max, round(avg({c}), 4) AS {p}_mean, round(stddev_pop({c}), 4) AS {p}_std, {q}"


@query(f"""WITH {_REG}, tr AS (SELECT * FROM reg WHERE o_orderkey % 5 <> 0), te AS (SELECT * FROM reg WHERE o_orderkey % 5 = 0),
z AS (SELECT min(y) AS lo, max(y) AS hi, avg(y) AS m, stddev_pop(y) AS s FROM tr),
sh AS (SELECT avg(((y - m) / s) ** 3) AS sk, avg(((y - m) / s) ** 4) - 3 AS ku, max(abs((y - m) / s)) AS mz FROM tr CROSS JOIN z),
a AS (SELECT count(*) AS n_train, {_dist('y', 'train')} FROM tr),
b AS (SELECT count(*) AS n_test, {_dist('y', 'test')}, {_dist('p', 'pred')}, round(avg(CAST(y < lo AS INTEGER)), 6) AS frac_test_below_train_min, round(avg(CAST(y > hi AS INTEGER)), 6) AS frac_test_above_train_max,
 round(avg(CAST(y < lo AS INTEGER)) + avg(CAST(y > hi AS INTEGER)), 6) AS frac_test_outside_train_range, round((max(p) - min(p)) / (max(y) - min(y)), 6) AS pred_spread_ratio FROM te CROSS JOIN z)
SELECT a.*, b.*, round(sk, 6) AS train_skew, round(ku, 6) AS train_excess_kurtosis, round(mz, 6) AS train_abs_z_max FROM a, b, sh""")
def target_coverage(t):
    rows = _reg(t)
    out = metrics.target_coverage(rows.where("o_orderkey % 5 != 0"), rows.where("o_orderkey % 5 = 0"), "y", "p")
    digits = lambda c: 4 if c.split("_")[0] in ("train", "test", "pred") and c.split("_")[-1] in ("min", "max", "mean", "std", "p01", "p25", "p50", "p75", "p99") and "abs_z" not in c else 6
    return out.select(*[F.round(c, digits(c)).alias(c) if k == "double" else F.col(c) for c, k in out.dtypes])


_SPREAD = "count({0}) AS n, round(avg({0}), 6) + 0 AS mean, round(var_samp({0}), 6) + 0 AS var, round(stddev_samp({0}), 6) + 0 AS std, round(stddev_samp({0}) / sqrt(count({0})), 6) + 0 AS sem"


@query(f"WITH {PREDS_SQL}, m AS (" + " UNION ALL ".join(f"SELECT {i} AS member, avg(CAST(CAST(p > 0.5 AS BIGINT) = y_true AS INTEGER)) AS accuracy FROM p{i}" for i in range(3)) + f") SELECT 'accuracy' AS metric, {_SPREAD.format('accuracy')} FROM m")
def member_spread(t):
    rows = None
    for i in range(3):
        m = preds(t, i).agg(F.avg((F.col("y_pred") == F.col("y_true")).cast("int")).alias("accuracy")).withColumn("metric", F.lit("accuracy"))
        rows = m if rows is None else rows.unionByName(m)
    return rounded(metrics.spread(rows, ["metric"], "accuracy"))


@query(f"SELECT o_orderpriority, {_SPREAD.format('o_totalprice')} FROM orders GROUP BY 1")
def mean_sem(t):
    out = metrics.spread(t.orders, ["o_orderpriority"], "o_totalprice")
    return out.select("o_orderpriority", "n", *[r6(c).alias(c) for c in ("mean", "var", "std", "sem")])


# ensembles

_J = "p0 JOIN p1 USING (key, cutoff_timestamp) JOIN p2 USING (key, cutoff_timestamp)"


@query(f"WITH {PREDS_SQL} SELECT key, cutoff_timestamp, p0.y_true AS y_true_0, p1.y_true AS y_true_1, p2.y_true AS y_true_2, CAST(p0.p > 0.5 AS BIGINT) AS y_pred_0, CAST(p1.p > 0.5 AS BIGINT) AS y_pred_1, CAST(p2.p > 0.5 AS BIGINT) AS y_pred_2 FROM {_J}")
def ensemble_join(t):
    j = results.join_predictions([preds(t, i) for i in range(3)])
    results.check_joined(j, t.customer.count(), 3)
    return j.drop("proba_0", "proba_1", "proba_2")


def _ens(pos: str) -> str:
    return f"SELECT key, cutoff_timestamp, y_true, CAST(CASE WHEN q > 1 - q THEN 1 ELSE 0 END AS INTEGER) AS y_pred, round(greatest(q, 1 - q), 6) AS p_pred FROM (SELECT key, cutoff_timestamp, p0.y_true, {pos} AS q FROM {_J})"


@query(f"WITH {PREDS_SQL} " + _ens("exp((ln(p0.p) + ln(p1.p) + ln(p2.p)) / 3) / (exp((ln(p0.p) + ln(p1.p) + ln(p2.p)) / 3) + exp((ln(greatest(1 - p0.p, 1e-300)) + ln(greatest(1 - p1.p, 1e-300)) + ln(greatest(1 - p2.p, 1e-300))) / 3))"))
def ensemble_logits(t):
    return rounded(results.ensemble([preds(t, i) for i in range(3)]).drop("proba"))


@query(f"WITH {PREDS_SQL} " + _ens("(p0.p + p1.p + p2.p) / 3"))
def ensemble_mean(t):
    return rounded(results.ensemble([preds(t, i) for i in range(3)], logits=False).drop("proba"))


@query(f"WITH {PREDS_SQL} SELECT key, cutoff_timestamp, y_true, round((p0.p + p1.p + p2.p) / 3, 6) AS y_pred FROM (SELECT key, cutoff_timestamp, p0.y_true AS y_true, p0.p AS a FROM p0) z JOIN p0 USING (key) JOIN p1 USING (key) JOIN p2 USING (key)".replace("SELECT key, cutoff_timestamp, y_true, round", "SELECT z.key, z.cutoff_timestamp, z.y_true, round"))
def ensemble_regression(t):
    rows = [preds(t, i).withColumn("y_pred", F.element_at("proba", 2)).drop("proba") for i in range(3)]
    return rounded(results.ensemble_regression(rows))


@query(f"WITH {PREDS_SQL} SELECT key, cutoff_timestamp, y_true, [a, b, c] AS y_preds FROM (SELECT key, cutoff_timestamp, p0.y_true AS y_true, CAST(p0.p > 0.5 AS BIGINT) AS a, CAST(p1.p > 0.5 AS BIGINT) AS b, CAST(p2.p > 0.5 AS BIGINT) AS c FROM {_J}) WHERE NOT (a = b AND b = c)")
def ensemble_diff(t):
    return results.diff([preds(t, i) for i in range(3)])


@query(f"WITH {PREDS_SQL} SELECT key, CAST(CASE WHEN p > 1 - p THEN 1 ELSE 0 END AS INTEGER) AS y_pred, round(greatest(p, 1 - p), 6) AS p_pred FROM p0")
def argmax_proba(t):
    return preds(t, 0).select("key", scalar.argmax(F.col("proba")).alias("y_pred"), r6(F.array_max("proba")).alias("p_pred"))


# results


@query("""WITH a AS (SELECT s_suppkey * 30 AS number, s_acctbal AS value FROM supplier), b AS (SELECT p_partkey AS number, p_retailprice AS value FROM part)
SELECT number, a.value AS value_0, b.value AS value_1 FROM a FULL JOIN b USING (number)""")
def combine_trials(t):
    a = t.supplier.select((F.col("s_suppkey") * 30).alias("number"), F.col("s_acctbal").alias("value"))
    return results.full_join_trials([a, t.part.select(F.col("p_partkey").alias("number"), F.col("p_retailprice").alias("value"))])


@query(f"WITH {SCORES_SQL} SELECT model, task, mae, dense_rank() OVER (PARTITION BY task ORDER BY mae DESC NULLS LAST) AS rank FROM scores")
def dense_rank(t):
    return results.dense_rank(scores(t).select("model", "task", "mae"), ["task"], "mae").withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH {SCORES_SQL}, r AS (SELECT model, rank() OVER (PARTITION BY task ORDER BY r2 DESC NULLS LAST) + (count(*) OVER (PARTITION BY task, r2) - 1) / 2 AS r FROM scores)
SELECT model, round(avg(r), 6) AS mean_rank, count(*) AS n_tasks FROM r GROUP BY model""")
def mean_rank(t):
    return rounded(results.mean_rank(scores(t), "task", "model", "r2"))


@query(f"WITH {SCORES_SQL} SELECT model, task, r2, coalesce(round(r2, 1) = max(round(r2, 1)) OVER (PARTITION BY task), false) AS is_best FROM scores")
def best_per_task(t):
    return results.best_per_task(scores(t).select("model", "task", "r2"), "task", "r2", 1)


@query(f"""WITH {SCORES_SQL}, p AS (SELECT a.model, b.model AS other, CASE WHEN a.mae IS NOT NULL AND b.mae IS NOT NULL THEN sign(b.mae - a.mae) WHEN a.r2 IS NOT NULL AND b.r2 IS NOT NULL THEN sign(a.r2 - b.r2) END AS o,
 a.mae IS NOT NULL AND b.mae IS NOT NULL AS f FROM scores a JOIN scores b ON a.task = b.task AND a.model <> b.model)
SELECT model, other, count(*) FILTER (o > 0) AS wins, count(*) FILTER (o < 0) AS losses, count(*) AS shared, count(*) FILTER (NOT f) AS fallback FROM p WHERE o IS NOT NULL GROUP BY model, other""")
def win_matrix(t):
    return results.win_matrix(scores(t), ["mae", "r2"], {"mae": True, "r2": False})


@query(f"""WITH {SCORES_SQL}, q AS (SELECT task, quantile_cont(r2, 0.75) - quantile_cont(r2, 0.25) AS iqr FROM scores GROUP BY task)
SELECT task, model, r2, round(max(r2) OVER (PARTITION BY task) - r2, 6) AS regret, CASE WHEN iqr > 0 THEN round((max(r2) OVER (PARTITION BY task) - r2) / iqr, 6) END AS norm_regret FROM scores JOIN q USING (task)""")
def regret(t):
    return rounded(results.regret(scores(t).select("task", "model", "r2"), "task", "r2"))


@query(f"WITH {SCORES_SQL}, q AS (SELECT model, cost / min(cost) OVER (PARTITION BY task) AS q FROM scores) SELECT model, round(exp(avg(ln(q))), 6) AS relative_cost FROM q GROUP BY model")
def relative_time(t):
    return rounded(results.relative_cost(scores(t), "task", "model", "cost"))


@query("""WITH x AS (SELECT o_orderstatus AS task, 'o_orderpriority' AS param, o_orderpriority AS level, o_totalprice AS v FROM orders UNION ALL SELECT o_orderstatus, 'mod', CAST(o_orderkey % 3 AS VARCHAR), o_totalprice FROM orders),
e AS (SELECT param, level, avg(v) AS mean, stddev_samp(v) / sqrt(count(v)) AS sem FROM x GROUP BY ALL), p AS (SELECT param, level, task, avg(v) AS m FROM x GROUP BY ALL),
w AS (SELECT param, level, m = min(m) OVER (PARTITION BY param, task) AS w FROM p)
SELECT param, level, round(mean, 4) AS mean, round(sem, 4) AS sem, count(*) FILTER (w) AS wins FROM e JOIN w USING (param, level) GROUP BY ALL""")
def marginals(t):
    rows = t.orders.select("o_orderstatus", "o_orderpriority", (F.col("o_orderkey") % 3).alias("mod"), "o_totalprice")
    out = results.marginals(rows, ["o_orderpriority", "mod"], "o_orderstatus", "o_totalprice")
    return out.withColumn("mean", F.round("mean", 4)).withColumn("sem", F.round("sem", 4))


@query("SELECT o_orderpriority, count(o_totalprice) AS n, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS std, min(o_totalprice) AS min, round(quantile_cont(o_totalprice, 0.25), 4) AS q25, round(median(o_totalprice), 4) AS median, round(quantile_cont(o_totalprice, 0.75), 4) AS q75, max(o_totalprice) AS max FROM orders GROUP BY 1")
def hp_summary(t):
    out = results.value_summary(t.orders, ["o_orderpriority"], "o_totalprice")
    return out.select(*[F.round(c, 4).alias(c) if c in ("mean", "std", "q25", "median", "q75") else c for c in out.columns])


@query("SELECT o_orderpriority, " + ", ".join(f"round(avg(o_totalprice) FILTER (o_orderstatus = '{s}'), 4) AS \"{s}\"" for s in "FOP") + " FROM orders GROUP BY 1")
def pivot_mean(t):
    out = t.orders.groupBy("o_orderpriority").pivot("o_orderstatus", list("FOP")).agg(F.avg("o_totalprice"))
    return out.select("o_orderpriority", *[F.round(s, 4).alias(s) for s in "FOP"])


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity, list_filter([nullif(l_quantity, 10), l_discount * 100, l_tax * 100], lambda v: v IS NOT NULL) AS a FROM lineitem),
s AS (SELECT *, list_sum(a) / len(a) AS m FROM x)
SELECT l_orderkey, l_linenumber, CAST(len(a) AS INTEGER) AS n, round(list_sum(a), 6) AS sum, round(m, 6) AS mean, round(list_median(a), 6) AS median, round(list_stddev_samp(a), 6) AS std FROM s""")
def rowwise_stats(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.nullif("l_quantity", F.lit(10.0)).alias("a"), (F.col("l_discount") * 100).alias("b"), (F.col("l_tax") * 100).alias("c"))
    return rounded(results.rowwise(rows, ["a", "b", "c"], ["l_orderkey", "l_linenumber"]))


@query("SELECT s_suppkey, CASE WHEN count(*) OVER (PARTITION BY s_nationkey) > 1 THEN CAST(s_nationkey AS VARCHAR) || ' (' || s_name || ')' ELSE CAST(s_nationkey AS VARCHAR) END AS label FROM supplier")
def task_labels(t):
    rows = t.supplier.select("s_suppkey", F.col("s_nationkey").cast("string").alias("name"), "s_name")
    return results.disambiguate(rows, "name", F.col("s_name")).select("s_suppkey", "label")


@query("""WITH r AS (SELECT p_brand AS run, p_type AS path, CAST(max(p_size) AS VARCHAR) AS value FROM part GROUP BY ALL)
SELECT path, count(DISTINCT value) AS n_values, count(DISTINCT run) AS n_runs, count(DISTINCT run) < (SELECT count(DISTINCT run) FROM r) AS incomplete FROM r GROUP BY path
HAVING count(DISTINCT value) > 1 OR count(DISTINCT run) < (SELECT count(DISTINCT run) FROM r)""")
def config_diff(t):
    rows = t.part.groupBy(F.col("p_brand").alias("run"), F.col("p_type").alias("path")).agg(F.max("p_size").cast("string").alias("value"))
    return scalar.config_diff(rows)


@query("SELECT p_partkey, trim(regexp_replace(p_type || ' / ' || p_brand || '!', '[^A-Za-z0-9._=-]+', '_', 'g'), '_') AS label FROM part")
def sanitize_label(t):
    return t.part.select("p_partkey", scalar.sanitize_label(F.concat("p_type", F.lit(" / "), "p_brand", F.lit("!"))).alias("label"))
