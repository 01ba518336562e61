"""Rewrites of the schema, relevance, propagation, prediction."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from weftline import models
from weftline.catalog import Database, Edge, Rel, Task
from weftline.functions.scalar import uniform
from weftline.incontext import AttentionBackbone
from weftline.operators import sampling
from weftline.operators.algebra import number_splits, numbered
from weftline.operators.pooling import sign_bit
from weftline.plans import graph, inference, predictor, rewrite
from weftline.queries.algebra import SPEC, task_of
from weftline.queries.base import TASK_SQL, query, r6, task_rows
from weftline.session import materialize
from weftline.queries.vectors import _arr, _r
from weftline.sources import files


def _sign(i: int, j: int, seed: int = 1) -> int:
    """An element of the sign projection, up to its scale."""
    return 1 if sign_bit(i, j, seed) else -1


def _single(x: str) -> str:
    """A value as a single-precision float, in double."""
    return f"CAST(CAST({x} AS FLOAT) AS DOUBLE)"


def _star(t) -> Database:
    return files.load_database(t.spark, t.folder, {k: SPEC[k] for k in ("region", "nation", "customer", "orders")})


@query("SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def pull_fk_rows(t):
    db = rewrite.pull(_star(t), "orders", "customer", Edge("orders", "o_custkey", "customer", "c_custkey"), drop_key=True)
    return db.tables["orders"].df.select("o_orderkey", "c_name")


@query("SELECT o_orderkey AS orders__o_orderkey, c_custkey AS customer__c_custkey, n_name AS nation__n_name, r_name AS region__r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def rewrite_pull_fk(t):
    db = _star(t)
    task = Rel("task", t.orders.select(F.col("o_orderkey").alias("t_orderkey")))
    db = rewrite.normalize(db.replace(task, edges=(*db.edges, Edge("task", "t_orderkey", "orders", "o_orderkey"))))
    db = rewrite.pull_dimensions(db, "task")
    return db.tables["orders"].df.select("orders__o_orderkey", "customer__c_custkey", "nation__n_name", "region__r_name")


def _junction(t, link) -> Database:
    """Links of orders and suppliers, both of which keep references of their own."""
    db = files.load_database(t.spark, t.folder, {k: SPEC[k] for k in ("orders", "customer", "nation", "supplier", "region")})
    task = Rel("task", t.nation.select(F.col("n_nationkey").alias("t_nation")))
    return rewrite.normalize(db.replace(Rel("link", link), task, edges=(*db.edges, Edge("link", "k_order", "orders", "o_orderkey"), Edge("link", "k_supp", "supplier", "s_suppkey"), Edge("task", "t_nation", "nation", "n_nationkey"))))


def _junction_sql(links: str) -> str:
    return f"""WITH link AS ({links})
SELECT 'a' AS side, k_order AS key, s_name AS other FROM link LEFT JOIN supplier ON s_suppkey = k_supp UNION ALL SELECT 'b', k_supp, o_orderpriority FROM link LEFT JOIN orders ON o_orderkey = k_order"""


@query(_junction_sql("SELECT o_orderkey AS k_order, o_orderkey % 50 + 1 AS k_supp FROM orders"))
def rewrite_junction_whole(t):
    return _linked(_junction(t, t.orders.select(F.col("o_orderkey").alias("k_order"), (F.col("o_orderkey") % 50 + 1).alias("k_supp"))))


@query(_junction_sql("SELECT l_orderkey AS k_order, l_suppkey AS k_supp FROM lineitem"))
def rewrite_junction(t):
    return _linked(_junction(t, t.lineitem.select(F.col("l_orderkey").alias("k_order"), F.col("l_suppkey").alias("k_supp"))))


def _linked(db: Database):
    """Each link from either side, once the junction is gone."""
    db = rewrite.eliminate_junctions(db, "task")
    a, b = db.tables["link#1"].df, db.tables["link#2"].df
    left = a.select(F.lit("a").alias("side"), F.col("link#1__k_order").alias("key"), F.col("link#1__supplier__s_name").alias("other"))
    return left.unionByName(b.select(F.lit("b").alias("side"), F.col("link#2__k_supp").alias("key"), F.col("link#2__orders__o_orderpriority").alias("other")))


@query(f"""WITH {TASK_SQL}, c AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1)
SELECT task_id AS task____task_id, c_name AS customer__c_name, coalesce(n, 0) AS customer__customer__refcount__orders FROM task JOIN customer USING (c_custkey) LEFT JOIN c ON k = c_custkey""".replace("customer__customer__refcount__orders", "refcount"))
def rewrite_simplify(t):
    task = task_of(t)
    db = rewrite.simplify(task.db, task.table)
    return db.tables["task"].df.select("task____task_id", "customer__c_name", F.col("customer__refcount__orders").alias("refcount"))


@query("SELECT r_name, n_name, s_name FROM region FULL JOIN nation ON r_regionkey = n_regionkey FULL JOIN supplier ON n_nationkey = s_nationkey")
def longest_path_join(t):
    db = files.load_database(t.spark, t.folder, {k: SPEC[k] for k in ("region", "nation", "supplier")})
    return rewrite.join_longest_path(db).df.select("r_name", "n_name", "s_name")


_DAG = {
    ("task", "customer"): "task SEMI JOIN customer USING (c_custkey)", ("customer", "nation"): "customer SEMI JOIN nation ON n_nationkey = c_nationkey",
    ("customer", "orders"): "customer SEMI JOIN orders ON o_custkey = c_custkey", ("nation", "region"): "nation SEMI JOIN region ON r_regionkey = n_regionkey",
    ("nation", "supplier"): "nation SEMI JOIN supplier ON s_nationkey = n_nationkey", ("orders", "lineitem"): "orders SEMI JOIN lineitem ON l_orderkey = o_orderkey",
    ("lineitem", "supplier"): "lineitem SEMI JOIN supplier ON s_suppkey = l_suppkey", ("lineitem", "part"): "lineitem SEMI JOIN part ON p_partkey = l_partkey",
}


@query(f"WITH {TASK_SQL} " + " UNION ALL ".join(f"SELECT '{a}' AS source, '{b}' AS target, count(*) AS linked FROM {x}" for (a, b), x in _DAG.items()))
def inference_dag(t):
    """The edges along which inference goes, and how many rows of an edge's source lead on along it."""
    task, out = task_of(t), None
    for e in graph.inference_dag(task.db, task.table):
        far = task.db.tables[e.target].df.select(F.col(e.target_col).alias("__k"))
        rows = task.db.tables[e.source].df.join(far, F.col(e.source_col) == F.col("__k"), "left_semi")
        one = rows.agg(F.lit(e.source).alias("source"), F.lit(e.target).alias("target"), F.count("*").alias("linked"))
        out = one if out is None else out.unionByName(one)
    return out


def _tasked(t, rows) -> Database:
    """customer <- orders with row numbers, and a task on the customers and cutoffs of ``rows``."""
    task = Rel("task", numbered(rows.select(F.col("c_custkey").alias("t_cust"), "cutoff"), ["t_cust", "cutoff"], "__row"), (), ("cutoff",))
    customer = Rel("customer", t.customer.withColumn("__row", F.col("c_custkey")), ("c_custkey",))
    orders = Rel("orders", t.orders.withColumn("__row", F.col("o_orderkey")), ("o_orderkey",), ("o_orderdate",))
    edges = (Edge("task", "t_cust", "customer", "c_custkey"), Edge("orders", "o_custkey", "customer", "c_custkey"))
    return Database({"task": task, "customer": customer, "orders": orders}, edges)


def _last(t) -> Database:
    """The task on all customers at the last cutoff."""
    return _tasked(t, task_rows(t).where("split = 'test'"))


def _relevant(db: Database):
    """How many rows of each table the task reaches."""
    found = inference.relevance(db, "task", db.tables["task"].df)
    out = None
    for name, rows in found.items():
        n = rows.agg(F.lit(name).alias("t"), F.count("*").alias("n"))
        out = n if out is None else out.unionByName(n)
    return out


@query("SELECT 'customer' AS t, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders SEMI JOIN customer ON o_custkey = c_custkey UNION ALL SELECT 'task', count(*) FROM customer")
def relevance(t):
    return _relevant(_last(t))


@query(f"WITH {TASK_SQL} SELECT 'customer' AS t, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders SEMI JOIN customer ON o_custkey = c_custkey UNION ALL SELECT 'task', count(*) FROM task")
def relevance_whole(t):
    return _relevant(_tasked(t, task_rows(t)))


def _propagated(db: Database):
    """The task's rows with what one sweep makes of zeros, balances and prices."""
    task, customer, orders = (db.tables[n].df for n in ("task", "customer", "orders"))
    features = {"task": task.select("__row", F.array(F.lit(0.0)).alias("emb")), "customer": customer.select("__row", F.array("c_acctbal").alias("emb")), "orders": orders.select("__row", F.array("o_totalprice").alias("emb"))}
    out = inference.propagate(db, "task", features, "mean")
    return task.join(out, "__row").select("t_cust", "cutoff", (F.round(F.get("emb", F.lit(0)), 8) + F.lit(0.0)).alias("x"))


@query("""WITH o AS (SELECT o_custkey AS k, avg(o_totalprice) AS m FROM orders GROUP BY 1), c AS (SELECT c_custkey, CASE WHEN m IS NULL THEN c_acctbal ELSE (c_acctbal + m) / 2 END AS x FROM customer LEFT JOIN o ON k = c_custkey)
SELECT c_custkey AS t_cust, round((0 + x) / 2, 8) + 0 AS x FROM c""")
def propagate_embeddings(t):
    return _propagated(_last(t)).select("t_cust", "x")


@query(f"""WITH {TASK_SQL}, o AS (SELECT o_custkey AS k, avg(o_totalprice) AS m FROM orders GROUP BY 1), c AS (SELECT c_custkey, CASE WHEN m IS NULL THEN c_acctbal ELSE (c_acctbal + m) / 2 END AS x FROM customer LEFT JOIN o ON k = c_custkey)
SELECT c_custkey AS t_cust, cutoff, round((0 + x) / 2, 8) + 0 AS x FROM task JOIN c USING (c_custkey)""")
def propagate_embeddings_whole(t):
    return _propagated(_tasked(t, task_rows(t)))


@query("""WITH o AS (SELECT o_custkey AS k, avg(o_totalprice) AS m FROM orders GROUP BY 1)
SELECT c_custkey, round(CASE WHEN m IS NULL THEN c_acctbal ELSE (c_acctbal + m * CAST(0.5 AS DOUBLE)) / 2 END, 8) + 0 AS x FROM customer LEFT JOIN o ON k = c_custkey""")
def message_passing(t):
    customer = Rel("customer", t.customer.withColumn("__row", F.col("c_custkey")))
    orders = Rel("orders", t.orders.withColumn("__row", F.col("o_orderkey")), (), ("o_orderdate",))
    db = Database({"customer": customer, "orders": orders}, (Edge("orders", "o_custkey", "customer", "c_custkey"),))
    features = {"customer": customer.df.select("__row", F.array("c_acctbal").alias("emb")), "orders": orders.df.select("__row", F.array("o_totalprice").alias("emb"))}
    out = inference.message_passing(db, features, rounds=1)["customer"]
    return out.select(F.col("__row").alias("c_custkey"), (F.round(F.get("emb", F.lit(0)), 8) + F.lit(0.0)).alias("x"))


def _features(t):
    from weftline.operators.counts import counts_as_of

    rows = counts_as_of(task_rows(t), "c_custkey", F.col("cutoff"), t.orders, "o_custkey", F.col("o_orderdate"), "n", (90, 365))
    rows = rows.join(t.customer.select(F.col("c_custkey").alias("__c"), "c_acctbal", "c_mktsegment"), F.col("c_custkey") == F.col("__c")).drop("__c")
    rows = materialize(rows, "rows")
    v = models.Vectorizer(exclude=("c_custkey", "split", "label", "target")).fit(rows)
    x = materialize(v.transform(rows, keep=("c_custkey", "split", "label", "target")), "features")
    names = [c for c in x.columns if c not in ("c_custkey", "split", "label", "target")]
    return x, names


@query()
def predict_binary(t):
    x, names = _features(t)
    out = models.LinearBackbone().predict(x.where("split != 'test'"), x.where("split = 'test'"), names, "label")
    return out.select("c_custkey", "label", "y_pred", r6(F.get("proba", F.lit(1))).alias("p"))


@query()
def predict_regression(t):
    x, names = _features(t)
    out = models.LinearBackbone(regression=True).predict(x.where("split != 'test'"), x.where("split = 'test'"), names, "target")
    return out.select("c_custkey", "target", F.greatest("y_pred", F.lit(0.0)).alias("y_pred"))


_EXTRACTED = {5: "n", 6: "n90", 7: "n365", 8: "c_acctbal"} | {9 + i: f"CAST(r = {i} AS INTEGER)" for i in range(5)}


@query(f"""WITH {TASK_SQL}, seg AS (SELECT c_mktsegment, row_number() OVER (ORDER BY count(*) DESC, c_mktsegment) - 1 AS r FROM customer GROUP BY 1),
x AS (SELECT c_custkey, c_acctbal, r, count(o_orderdate) AS n, count(o_orderdate) FILTER (WHERE o_orderdate > cutoff - INTERVAL 90 DAY) AS n90, count(o_orderdate) FILTER (WHERE o_orderdate > cutoff - INTERVAL 365 DAY) AS n365
  FROM task JOIN customer USING (c_custkey) JOIN seg USING (c_mktsegment) LEFT JOIN orders ON o_custkey = c_custkey AND o_orderdate <= cutoff WHERE split = 'test' GROUP BY ALL),
z AS (SELECT c_custkey, {", ".join(f"coalesce(({_single(x)} - avg({_single(x)}) OVER ()) / nullif(stddev_pop({_single(x)}) OVER (), 0), 0) AS z{j}" for j, x in _EXTRACTED.items())} FROM x)
SELECT c_custkey, {_arr('[' + ', '.join('(' + ' + '.join(f"{_sign(i, j)} * z{j}" for j in _EXTRACTED) + ') / sqrt(CAST(8 AS DOUBLE))' for i in range(8)) + ']')} AS emb FROM z""")
def extract_embeddings(t):
    x, names = _features(t)
    return models.extract(x.where("split = 'test'"), names, 8, ["c_custkey"]).withColumn("emb", _r(F.col("emb")))


def _fused_task(t) -> Task:
    orders = Rel("orders", t.orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"), ("o_orderkey",), ("o_orderdate",))
    customer = Rel("customer", t.customer.select("c_custkey", "c_acctbal"), ("c_custkey",))
    db = Database({"customer": customer, "orders": orders}, (Edge("orders", "o_custkey", "customer", "c_custkey"),))
    return files.load_task(db, task_rows(t).drop("target"), ("c_custkey", "customer", "c_custkey"), "cutoff", "label")


FUSED = predictor.Settings(dim=1, activation=None, train_rows=None, context_rows=None)
_ORDER_FEATURES = ("year(o_orderdate)", "month(o_orderdate)", "day(o_orderdate)", "hour(o_orderdate)", "epoch(o_orderdate)", "o_totalprice")
#: The task's own features, by their places among all; those that are the same in all rows are left out.
_TASK_FEATURES = {0: "year(cutoff)", 4: "epoch(cutoff)", 5: "c_acctbal", 6: "refs"}
def _predictor_sql(features: tuple[str, ...], estimators: int = 1, future: bool = False) -> str:
    """Gaussian naive Bayes on ``features`` of the rewritten task, its context ``cnt`` and ``ctx`` (``ctx1`` and so on for more estimators), and ``late``, own and context combined."""
    more = [(e, f"{e or ''}") for e in range(estimators)]
    emb = ", ".join(" + ".join(f"{_sign(0, i, 1 + e)} * coalesce((x{i} - m{i}) / nullif(s{i}, 0), 0)" for i in range(6)) + f" AS emb{n}" for e, n in more)
    ctx = ", ".join(f"avg(emb{n}) AS ctx{n}" for _, n in more)
    own = " + ".join(f"{_sign(0, j)} * coalesce(({_single(x)} - avg({_single(x)}) OVER ()) / nullif(stddev_pop({_single(x)}) OVER (), 0), 0)" for j, x in ({**_TASK_FEATURES, 7: "cnt"}).items())
    n = range(len(features))
    return f"""WITH {TASK_SQL}, o AS (SELECT o_custkey, o_orderdate, {", ".join(f"{_single(x)} AS x{i}" for i, x in enumerate(_ORDER_FEATURES))} FROM orders),
s AS (SELECT {", ".join(f"avg(x{i}) AS m{i}, stddev_pop(x{i}) AS s{i}" for i in range(6))} FROM o),
e AS (SELECT o_custkey, o_orderdate, {emb} FROM o CROSS JOIN s),
r AS (SELECT o_custkey, count(*) AS refs FROM orders GROUP BY 1),
c AS (SELECT c_custkey, cutoff, count(emb) AS cnt, {ctx} FROM task JOIN e ON o_custkey = c_custkey {"" if future else "AND o_orderdate <= cutoff"} GROUP BY ALL),
t AS (SELECT task_id, split, label, cutoff, c_acctbal, coalesce(refs, 0) AS refs, coalesce(cnt, 0) AS cnt, {", ".join(f"ctx{n}" for _, n in more)} FROM task JOIN customer USING (c_custkey) LEFT JOIN r ON o_custkey = c_custkey LEFT JOIN c USING (c_custkey, cutoff)),
w AS (SELECT *, {own} AS own FROM t),
f AS (SELECT task_id, split, label, {", ".join(f"{_single(x)} AS f{i}" for i, x in enumerate(features))} FROM (SELECT *, coalesce((own + ctx) / 2, own) AS late FROM w)),
k AS (SELECT label AS k, ln(count(*) / sum(count(*)) OVER ()) AS prior, {", ".join(f"avg(f{i}) AS a{i}, greatest(var_pop(f{i}), 0.001) AS v{i}" for i in n)} FROM f WHERE split <> 'test' GROUP BY label),
l AS (SELECT task_id, label, k, prior {"".join(f" + coalesce(0 - (f{i} - a{i}) * (f{i} - a{i}) / (2 * v{i}) - ln(2 * pi() * v{i}) / 2, 0)" for i in n)} AS z FROM f CROSS JOIN k WHERE split = 'test')
SELECT task_id AS __task_id, label, CAST(arg_max(k, z) AS INTEGER) AS y_pred, round(sum(CASE WHEN k = 1 THEN exp(z - top) END) / sum(exp(z - top)), 4) + 0 AS p
FROM (SELECT *, max(z) OVER (PARTITION BY task_id) AS top FROM l) GROUP BY task_id, label"""


def _predicted(t, settings: predictor.Settings):
    out = predictor.predict(_fused_task(t), settings, models.BayesBackbone())
    return out.select("__task_id", "label", "y_pred", (F.round(F.get("proba", F.lit(1)), 4) + F.lit(0.0)).alias("p"))


@query(_predictor_sql((*_TASK_FEATURES.values(), "cnt", "ctx")))
def predict_fused(t):
    """The whole predictor: rewrites, relevance, extraction, as-of pooling, early fusion, and a closed-form backbone."""
    return _predicted(t, FUSED)


@query(_predictor_sql((*_TASK_FEATURES.values(), "late")))
def predict_late(t):
    """The same with late fusion."""
    return _predicted(t, replace(FUSED, fusion="late"))


@query(_predictor_sql(tuple(_TASK_FEATURES.values())))
def predict_unfused(t):
    """The same from the task's own features alone."""
    return _predicted(t, replace(FUSED, fusion="none"))


@query(_predictor_sql((*_TASK_FEATURES.values(), "cnt", "ctx", "ctx1", "ctx2", "ctx3"), 4))
def predict_estimators(t):
    """The same with four extractions side by side, pooled in one pass."""
    return _predicted(t, replace(FUSED, estimators=4))


@query(_predictor_sql((*_TASK_FEATURES.values(), "cnt", "ctx"), future=True))
def predict_propagated(t):
    """The same in rounds of layered propagation, which draws on the future too."""
    return _predicted(t, replace(FUSED, layers=2, future=True))


_NEAR = {"n90": "count(o_orderdate) FILTER (WHERE o_orderdate > cutoff - INTERVAL 90 DAY)", "n365": "count(o_orderdate) FILTER (WHERE o_orderdate > cutoff - INTERVAL 365 DAY)", "n": "count(o_orderdate)", "c_acctbal": "c_acctbal"}


@query(f"""WITH {TASK_SQL}, x AS (SELECT task_id, c_custkey, split, label, {", ".join(f"{x} AS {k}" for k, x in _NEAR.items())} FROM task JOIN customer USING (c_custkey) LEFT JOIN orders ON o_custkey = c_custkey AND o_orderdate <= cutoff GROUP BY task_id, c_custkey, c_acctbal, split, label),
s AS (SELECT {", ".join(f"avg({k}) AS m_{k}, stddev_pop({k}) AS s_{k}" for k in _NEAR)} FROM x WHERE split <> 'test'),
z AS (SELECT task_id, c_custkey, split, label, {", ".join(f"({k} - m_{k}) / s_{k} AS {k}" for k in _NEAR)} FROM x CROSS JOIN s),
p AS (SELECT q.c_custkey, q.label, k.label AS y, -({" + ".join(f"(q.{k} - k.{k}) * (q.{k} - k.{k})" for k in _NEAR)}) / 2 / 0.25 AS e FROM z q JOIN z k ON q.split = 'test' AND k.split <> 'test'),
w AS (SELECT c_custkey, label, y, exp(e - max(e) OVER (PARTITION BY c_custkey)) AS w FROM p),
r AS (SELECT c_custkey, label, sum(w * y) / sum(w) AS p FROM w GROUP BY ALL)
SELECT c_custkey, label, CAST(p > 0.5 AS INTEGER) AS y_pred, round(p, 6) AS p FROM r""")
def predict_in_context(t):
    """Attention of every row to predict over all rows to learn from."""
    from weftline.operators.counts import counts_as_of

    rows = counts_as_of(task_rows(t), "c_custkey", F.col("cutoff"), t.orders, "o_custkey", F.col("o_orderdate"), "n", (90, 365))
    rows = materialize(rows.join(t.customer.select(F.col("c_custkey").alias("__c"), "c_acctbal"), F.col("c_custkey") == F.col("__c")).drop("__c"), "rows")
    names = [c for c in rows.columns if c not in ("c_custkey", "cutoff", "split", "label", "target")]
    out = AttentionBackbone().predict(rows.where("split != 'test'"), rows.where("split = 'test'"), names, "label")
    return out.select("c_custkey", "label", "y_pred", r6(F.get("proba", F.lit(1))).alias("p"))


@query(f"""WITH {TASK_SQL}, test AS (SELECT (task_id - min(task_id) OVER ()) // 400 AS batch, c_custkey FROM task WHERE split = 'test'),
train AS (SELECT task_id, c_custkey, md5('0:' || task_id) AS u FROM task WHERE split <> 'test'),
b AS (SELECT batch, count(DISTINCT c_custkey) AS keys FROM test GROUP BY 1),
anchors AS (SELECT batch, task_id FROM train JOIN (SELECT DISTINCT batch, c_custkey FROM test) USING (c_custkey) JOIN b USING (batch)
 QUALIFY row_number() OVER (PARTITION BY batch, c_custkey ORDER BY u DESC, task_id) <= greatest(1, round_even(1000 * CAST(0.3 AS DOUBLE) / keys, 0))),
rest AS (SELECT b.batch, task_id, row_number() OVER (PARTITION BY b.batch ORDER BY u DESC, task_id) AS r FROM b CROSS JOIN train ANTI JOIN anchors ON anchors.batch = b.batch AND anchors.task_id = train.task_id)
SELECT batch, task_id FROM anchors UNION ALL SELECT batch, task_id FROM rest WHERE r <= 1000 - (SELECT count(*) FROM anchors a WHERE a.batch = rest.batch)""")
def train_sample_batches(t):
    """For every 400 rows to predict 1,000 to learn from: their own entities' first, then the best of all."""
    rows = materialize(number_splits(task_rows(t), ["train", "val", "test"], ["c_custkey", "cutoff"], "task_id").select("task_id", "c_custkey", "split"), "rows")
    test = rows.where("split = 'test'")
    first = test.agg(F.min("task_id").alias("__first"))
    test = test.crossJoin(F.broadcast(first)).withColumn("batch", F.floor((F.col("task_id") - F.col("__first")) / 400))
    train = rows.where("split != 'test'").withColumn("u", uniform(F.col("task_id")))
    return sampling.batch_samples(train, test, "batch", "c_custkey", "task_id", "u", 1000, 0.3).select("batch", "task_id")


@query("""WITH l AS (SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS k, 'customer' AS e, o_totalprice FROM orders UNION ALL SELECT o_orderkey, CAST(o_custkey AS VARCHAR), 'task', o_totalprice FROM orders
 UNION ALL SELECT o_orderkey, CAST(c_nationkey AS VARCHAR), 'nation', o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey),
g AS (SELECT min(e || ' ' || k) AS g FROM (SELECT e, k, list(o_orderkey ORDER BY o_orderkey) AS s FROM l GROUP BY ALL) GROUP BY s),
r AS (SELECT o_orderkey, row_number() OVER (PARTITION BY e, k ORDER BY o_totalprice DESC, o_orderkey) AS r FROM l WHERE e || ' ' || k IN (SELECT g FROM g))
SELECT DISTINCT o_orderkey FROM r WHERE r <= greatest(1, (SELECT count(*) FROM orders) // 2 // (SELECT count(*) FROM g))""")
def context_row_sets(t):
    """Half of all orders, shared out over the sets of them that customers, the task's rows and nations have; a customer's and its task row's are one."""
    orders = t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
    nations = orders.join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    link = lambda df, edge, key: df.select("o_orderkey", F.col(key).cast("string").alias("k"), F.lit(edge).alias("e"), "o_totalprice")
    links = link(orders, "customer", "o_custkey").union(link(orders, "task", "o_custkey")).union(link(nations, "nation", "c_nationkey"))
    return sampling.context_sample(links, ["e", "k"], "o_orderkey", F.desc("o_totalprice"), t.orders.count() // 2)


@query()
def predict_layered(t):
    out = predictor.predict(_fused_task(t), predictor.Settings(layers=2, future=True))
    return out.select("__task_id", "label", "y_pred", r6(F.get("proba", F.lit(1))).alias("p"))
