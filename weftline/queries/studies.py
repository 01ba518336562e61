"""Studies, lookups and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import studies
from weftline.operators.pooling import combine, pool
from weftline.queries.base import PREDS_SQL, SCORES_SQL, TASK_SQL, preds, query, r6, rounded, scores, task_rows
from weftline.queries.vectors import KEYED_SQL, _arr, _r, keyed


@query("""WITH tr AS (SELECT o_orderkey AS number, o_orderdate AS start, o_orderdate + INTERVAL 1 HOUR * (o_orderkey % 24) AS complete FROM orders), te AS (SELECT l_orderkey AS number, max(l_extendedprice) AS test FROM lineitem GROUP BY 1)
SELECT number, CAST(epoch(complete) - epoch(start) AS DOUBLE) AS duration_s, test FROM tr LEFT JOIN te USING (number)""")
def trials_with_tests(t):
    tr = t.orders.select(F.col("o_orderkey").alias("number"), F.col("o_orderdate").alias("start"), (F.col("o_orderdate") + F.expr("INTERVAL 1 HOUR") * (F.col("o_orderkey") % 24).cast("int")).alias("complete"))
    te = t.lineitem.groupBy(F.col("l_orderkey").alias("number")).agg(F.max("l_extendedprice").alias("test"))
    return studies.trials_with_tests(tr, te).select("number", "duration_s", "test")


@query(f"""WITH {SCORES_SQL}, b AS (SELECT task, model, mae FROM scores WHERE mae IS NOT NULL QUALIFY row_number() OVER (PARTITION BY task ORDER BY mae, model) = 1), r AS (SELECT task, round(avg(mae), 6) AS mean_mae FROM scores GROUP BY task)
SELECT task, model, mae, mean_mae FROM b JOIN r USING (task)""")
def winners_join(t):
    s = scores(t)
    ref = s.groupBy("task").agg(r6(F.avg("mae")).alias("mean_mae"))
    return studies.winners(s.select("task", "model", "mae"), ["task"], "mae", "model", ref)


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice, o_orderkey LIMIT 1")
def first_complete_trial(t):
    rows = t.orders.select("o_orderkey", "o_totalprice", F.when(F.col("o_orderstatus") == "F", "COMPLETE").otherwise("FAIL").alias("state"))
    return studies.first_complete(rows, "state", ["o_totalprice", "o_orderkey"]).select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0 ORDER BY c_custkey LIMIT 20")
def head_of_known(t):
    rows = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).alias("v"))
    return studies.head_of_known(rows, "v", "c_custkey", 20).select("c_custkey")


@query("""SELECT c_custkey, 'db' || c_nationkey AS db, c_mktsegment || '_x' AS task, CASE c_mktsegment WHEN 'BUILDING' THEN 'b' WHEN 'MACHINERY' THEN 'm' ELSE '?' END AS code, lower(c_mktsegment) || '_' || c_nationkey AS param FROM customer""")
def name_parts(t):
    name = F.concat(F.lit("db"), F.col("c_nationkey").cast("string"), F.lit("_"), "c_mktsegment", F.lit("_x"))
    a, b = studies.split_name(name)
    param = F.concat(F.lit("params_"), F.lower("c_mktsegment"), F.lit("_"), F.col("c_nationkey").cast("string"), F.lit("_"), F.col("c_custkey").cast("string"))
    code = studies.lookup(F.col("c_mktsegment"), {"BUILDING": "b", "MACHINERY": "m"}, "?")
    return t.customer.select("c_custkey", a.alias("db"), b.alias("task"), code.alias("code"), studies.strip_affix(param).alias("param"))


@query("SELECT CAST(0 AS BIGINT) AS shared")
def disjoint_splits(t):
    rows = task_rows(t)
    a, b = (rows.where(f"split {op} 'test'").select("c_custkey", "cutoff") for op in ("!=", "="))
    studies.check_disjoint(a, b)
    return a.intersect(b).agg(F.count("*").alias("shared"))


@query(f"WITH {TASK_SQL} SELECT CAST(label AS BIGINT) AS label, count(*) FILTER (split = 'train') AS rows_train, count(*) FILTER (split = 'val') AS rows_val, count(*) FILTER (split = 'test') AS rows_test FROM task GROUP BY label")
def split_sizes(t):
    return studies.split_sizes(task_rows(t), "label", "split", ["train", "val", "test"])


@query(f"WITH {PREDS_SQL}, j AS (SELECT p0.y_true AS y, p0.p AS a, p1.p AS b, p2.p AS c FROM p0 JOIN p1 USING (key) JOIN p2 USING (key)) " + " UNION ALL ".join(
    f"SELECT '{m}' AS members, {n} AS size, round(avg(CAST(CAST(({e}) / {n} > 0.5 AS BIGINT) = y AS INTEGER)), 6) AS accuracy FROM j"
    for m, n, e in (("0", 1, "a"), ("1", 1, "b"), ("2", 1, "c"), ("0,1", 2, "a + b"), ("0,2", 2, "a + c"), ("1,2", 2, "b + c"), ("0,1,2", 3, "a + b + c"))
))
def ensemble_subsets(t):
    return rounded(studies.subset_ensembles([preds(t, i) for i in range(3)]))


def _late(how: str, sql: str):
    def f(t):
        ctx = pool(t.embeddings, ["label"], "embedding", "max", "ctx").drop("cnt")
        own = F.transform("embedding", lambda x: x.cast("double"))
        return keyed(t.embeddings).join(ctx, "label", "left").select("vec_id", _r(combine(own, F.col("ctx"), how)).alias("emb"))

    f.__name__ = f"late_fusion_{how}"
    query(f"""WITH e AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), a AS (SELECT label, i, max(CAST(x AS DOUBLE)) AS v FROM e GROUP BY ALL), c AS (SELECT label, list(v ORDER BY i) AS ctx FROM a GROUP BY label)
SELECT vec_id, {_arr(f'CASE WHEN ctx IS NULL THEN embedding ELSE list_transform(list_zip(embedding, ctx), lambda p: {sql}) END')} AS emb FROM {KEYED_SQL} LEFT JOIN c USING (label)""")(f)


for _how, _sql in (("sum", "CAST(p[1] AS DOUBLE) + p[2]"), ("max", "greatest(CAST(p[1] AS DOUBLE), p[2])")):
    _late(_how, _sql)
