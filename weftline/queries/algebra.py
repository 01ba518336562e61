"""Sources, algebra, counts, sampling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import scalar
from weftline.operators import algebra as A
from weftline.operators import counts as C
from weftline.operators import metrics, sampling
from weftline.operators.pooling import asof_pairs
from weftline.queries.base import NULLS_SQL, SCORES_SQL, TASK_SQL, Tables, cutoffs, orders_nullfk, orders_nulls, query, r6, rounded, scores, task_rows
from weftline.session import materialize, scratch_path
from weftline.sources import files
from weftline.streaming import counts as streams

SPEC = {
    "region": {"keys": ["r_regionkey"]},
    "nation": {"keys": ["n_nationkey"], "refs": {"n_regionkey": ("region", "r_regionkey")}},
    "customer": {"keys": ["c_custkey"], "refs": {"c_nationkey": ("nation", "n_nationkey")}},
    "supplier": {"keys": ["s_suppkey"], "refs": {"s_nationkey": ("nation", "n_nationkey")}},
    "part": {"keys": ["p_partkey"]},
    "orders": {"keys": ["o_orderkey"], "times": ["o_orderdate"], "refs": {"o_custkey": ("customer", "c_custkey")}},
    "lineitem": {"times": ["l_shipdate"], "refs": {"l_orderkey": ("orders", "o_orderkey"), "l_partkey": ("part", "p_partkey"), "l_suppkey": ("supplier", "s_suppkey")}},
}


def splits(t: Tables) -> dict[str, DataFrame]:
    rows = materialize(task_rows(t), "task")
    return {s: rows.where(F.col("split") == s).drop("split", "target") for s in ("train", "val", "test")}


def task_of(t: Tables, dry_run: bool = False):
    return files.load_task(files.load_database(t.spark, t.folder, SPEC), task_rows(t).drop("target"), ("c_custkey", "customer", "c_custkey"), "cutoff", "label", dry_run=dry_run)


@query(f"WITH {TASK_SQL} SELECT task_id AS __task_id, c_custkey, cutoff, label, split FROM task")
def load_task(t):
    task = task_of(t)
    return task.db.tables[task.table].df


@query(f"WITH {TASK_SQL} SELECT split, count(*) AS n, CAST(min(task_id) AS BIGINT) AS first_id, CAST(max(task_id) AS BIGINT) AS last_id, CAST(sum(label) AS BIGINT) AS positive FROM task GROUP BY split")
def task_union(t):
    rows = A.union_splits(splits(t), ["c_custkey", "cutoff"])
    return rows.groupBy("split").agg(F.count("*").alias("n"), F.min("__task_id").alias("first_id"), F.max("__task_id").alias("last_id"), F.sum("label").alias("positive"))


@query(f"WITH {TASK_SQL} SELECT split, count(*) AS n FROM task WHERE split <> 'train' GROUP BY split UNION ALL SELECT 'lineitem', 0")
def dry_run_schema(t):
    task = task_of(t, dry_run=True)
    rest = task.db.tables["lineitem"].df.agg(F.lit("lineitem").alias("split"), F.count("*").alias("n"))
    return task.db.tables[task.table].df.groupBy("split").agg(F.count("*").alias("n")).unionByName(rest)


@query("SELECT c_custkey, CAST(lower(trim(c_mktsegment)) = 'building' AS INTEGER) AS y FROM customer")
def binarize_target(t):
    return t.customer.select("c_custkey", scalar.binarize(F.col("c_mktsegment"), "building").alias("y"))


@query("""WITH top AS (SELECT c_mktsegment AS m FROM customer GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT c_custkey, CAST(c_mktsegment = m AS INTEGER) AS y FROM customer CROSS JOIN top""")
def top_class_vs_rest(t):
    top = t.customer.groupBy(F.col("c_mktsegment").alias("m")).count().orderBy(F.desc("count"), "m").limit(1).select("m")
    return t.customer.crossJoin(F.broadcast(top)).select("c_custkey", (F.col("c_mktsegment") == F.col("m")).cast("int").alias("y"))


@query("SELECT vec_id, " + ", ".join(f"round(CAST(embedding[{i + 1}] AS DOUBLE), 6) + 0 AS embedding_{i}" for i in range(64)) + " FROM embeddings")
def expand_arrays(t):
    return rounded(files.expand_arrays(t.embeddings.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding")), {"embedding": 64}))


@query(f"WITH {TASK_SQL} SELECT name, eval_mode, key, cutoff_timestamp, y_true, y_pred, task_type FROM (SELECT 'task' AS name, split AS eval_mode, c_custkey AS key, strftime(cutoff, '%Y-%m-%dT%H:%M:%S') AS cutoff_timestamp, label AS y_true, label AS y_pred, 'binary' AS task_type FROM task WHERE split = 'test')")
def predictions_round_trip(t):
    path = scratch_path(t.spark, "preds")
    rows = task_rows(t).where("split = 'test'").select(
        F.col("c_custkey").alias("key"), F.date_format("cutoff", "yyyy-MM-dd'T'HH:mm:ss").alias("cutoff_timestamp"), F.col("label").alias("y_true"), F.col("label").alias("y_pred"), F.lit("binary").alias("task_type")
    )
    files.write_predictions(rows, path, "task", "run-0", "test")
    return files.read_predictions(t.spark, path).drop("id")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_round_trip(t):
    path = scratch_path(t.spark, "csv")
    files.write_csv(t.nation, path)
    return files.read_csv(t.spark, path, t.nation.schema.simpleString()[7:-1].replace(":", " "))


@query("SELECT n_nationkey, n_name FROM nation")
def json_lines_round_trip(t):
    path = scratch_path(t.spark, "json")
    t.nation.select("n_nationkey", "n_name").write.json(path)
    return files.read_lines(t.spark, path, "n_nationkey int, n_name string")


@query("SELECT CAST(sum(n_nationkey + 0.5) AS DOUBLE) AS duration_s FROM nation")
def trace_durations(t):
    path = scratch_path(t.spark, "trace")
    t.nation.select(F.concat(F.lit("{name: a, event: DURATION-full-program, duration_s: "), (F.col("n_nationkey") + 0.5).cast("string"), F.lit("}"))).write.text(path)
    return files.scan_durations(t.spark, path).agg(F.sum("duration_s").alias("duration_s"))


@query("SELECT 'val' AS stage, 'r' || n_regionkey AS db, lower(c_mktsegment) AS task, round(avg(c_acctbal), 6) AS score FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL")
def run_directory_scan(t):
    """Results of a run per region and market segment, written as run folders with ensemble members among them, and scanned."""
    root = scratch_path(t.spark, "runs")
    fs = t.spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = t.spark.sparkContext._jsc.hadoopConfiguration()
    rows = t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"))
    runs = rows.groupBy("n_regionkey", F.lower("c_mktsegment").alias("task")).agg(F.avg("c_acctbal").alias("score")).collect()  # regions times segments
    for r in runs:
        for member in ("", "/member_0"):
            path = fs.Path(f"{root}/val/r{r.n_regionkey}_{r.task}{member}/results.json")
            out = path.getFileSystem(conf).create(path, True)
            out.write(bytearray(f'{{"score": {r.score!r}}}'.encode()))
            out.close()
    return files.scan_runs(t.spark, root, "score double").select("stage", "db", "task", r6("score").alias("score"))


@query(f"WITH {TASK_SQL} SELECT c_custkey, cutoff, label AS __target, CASE WHEN split = 'test' THEN 'eval' ELSE 'train' END AS __split FROM task")
def feature_dump(t):
    rows = task_rows(t).drop("target")
    return files.feature_dump(rows.where("split <> 'test'").drop("split"), rows.where("split = 'test'").drop("split"), "label")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 250000 AND o_orderpriority = '1-URGENT'")
def filter_query(t):
    return A.filter_query(t.orders, "o_totalprice > :least AND o_orderpriority = :kind", least=250000, kind="1-URGENT").select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def split_filter(t):
    return A.filter_in(t.orders, "o_custkey", t.customer.where("c_acctbal > 5000").select("c_custkey")).select("o_orderkey", "o_custkey")


@query(f"WITH {NULLS_SQL} SELECT o_orderkey FROM orders_nulls WHERE o_orderdate <= TIMESTAMP '1999-01-01' OR o_orderdate IS NULL")
def cutoff_filter(t):
    return A.cut_off(orders_nulls(t), ["o_orderdate"], F.lit("1999-01-01").cast("timestamp_ntz")).select("o_orderkey")


@query(f"WITH {TASK_SQL}, {NULLS_SQL} SELECT cutoff, count(*) AS n FROM cut JOIN orders_nulls ON o_orderdate <= cutoff OR o_orderdate IS NULL GROUP BY cutoff")
def cutoff_sets(t):
    return A.at_cutoffs(orders_nulls(t), ["o_orderdate"], cutoffs(t).select("cutoff")).groupBy("cutoff").agg(F.count("*").alias("n"))


@query("SELECT n_nationkey AS nation__n_nationkey, n_name AS nation__n_name, n_regionkey AS nation__n_regionkey FROM nation")
def normalize_names(t):
    return A.normalize_names(A.normalize_names(t.nation, "nation"), "nation")


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 50 OFFSET 50")
def test_batches(t):
    return A.row_slice(t.customer.select("c_custkey", "c_name"), ["c_custkey"], 50, 100)


@query(f"""WITH {NULLS_SQL}, p AS (SELECT o_orderkey, o_custkey, o_orderdate, 1 AS same, CAST(NULL AS INTEGER) AS nothing FROM orders_nulls)
SELECT 'o_orderkey' AS column_name, count(o_orderkey) AS n_non_null, false AS is_constant FROM p UNION ALL
SELECT 'o_custkey', count(o_custkey), false FROM p UNION ALL SELECT 'o_orderdate', count(o_orderdate), false FROM p UNION ALL
SELECT 'same', count(*), true FROM p UNION ALL SELECT 'nothing', 0, true""")
def column_profile(t):
    rows = orders_nulls(t).select("o_orderkey", "o_custkey", "o_orderdate", F.lit(1).alias("same"), F.lit(None).cast("int").alias("nothing"))
    return A.column_profile(rows)


def _join(how: str, word: str):
    def f(t):
        return A.join(orders_nullfk(t).select("o_orderkey", "o_custkey"), t.customer.select("c_custkey", "c_name"), ["o_custkey"], ["c_custkey"], how)

    f.__name__ = f"join_{how}"
    query(f"WITH {NULLS_SQL} SELECT o_orderkey, o_custkey, c_custkey, c_name FROM orders_nullfk {word} JOIN customer ON o_custkey = c_custkey")(f)


for _how, _word in (("left", "LEFT"), ("right", "RIGHT"), ("inner", ""), ("outer", "FULL")):
    _join(_how, _word)

_A = "SELECT c_custkey, CASE WHEN c_nationkey % 5 <> 3 THEN c_nationkey END AS k1, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS k2 FROM customer"
_B = f"SELECT k1 AS j1, k2 AS j2, min(c_custkey) AS m FROM ({_A}) GROUP BY k1, k2"
_ON = "k1 IS NOT DISTINCT FROM j1 AND k2 IS NOT DISTINCT FROM j2 AND NOT (k1 IS NULL AND k2 IS NULL)"


@query(f"WITH a AS ({_A}), b AS ({_B}) " + " UNION ALL ".join(f"SELECT '{h}' AS how, c_custkey, m FROM a {w} JOIN b ON {_ON}" for h, w in (("left", "LEFT"), ("right", "RIGHT"), ("inner", ""), ("outer", "FULL"))))
def join_composite_nullsafe(t):
    a = t.customer.select("c_custkey", F.when(F.col("c_nationkey") % 5 != 3, F.col("c_nationkey")).alias("k1"), F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("k2"))
    b = a.groupBy(F.col("k1").alias("j1"), F.col("k2").alias("j2")).agg(F.min("c_custkey").alias("m"))
    return reduce(DataFrame.unionByName, [A.join(a, b, ["k1", "k2"], ["j1", "j2"], h).select(F.lit(h).alias("how"), "c_custkey", "m") for h in A.HOWS])


@query(f"WITH {TASK_SQL} SELECT cutoff FROM task WHERE split <> 'train' GROUP BY cutoff")
def eval_timestamps(t):
    return task_rows(t).where("split <> 'train'").select("cutoff").distinct().orderBy("cutoff")


@query("SELECT s_suppkey AS k, s_name AS name, NULL AS seg FROM supplier UNION ALL SELECT c_custkey, c_name, c_mktsegment FROM customer")
def union_all(t):
    a = t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    return a.unionByName(t.customer.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("seg")), allowMissingColumns=True)


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(t):
    return A.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@query(f"""WITH {NULLS_SQL} SELECT 'o_orderkey' AS cols, count(o_orderkey) AS n_rows, count(DISTINCT o_orderkey) AS n_distinct, true AS is_key FROM orders_nulls UNION ALL
SELECT 'o_custkey', count(o_custkey), count(DISTINCT o_custkey), count(o_custkey) = count(DISTINCT o_custkey) FROM orders_nulls UNION ALL
SELECT 'o_custkey,o_orderdate', count(*), count(DISTINCT (o_custkey, o_orderdate)), count(*) = count(DISTINCT (o_custkey, o_orderdate)) FROM orders_nulls WHERE o_custkey IS NOT NULL AND o_orderdate IS NOT NULL""")
def empirical_keys(t):
    return A.empirical_keys(orders_nulls(t), [["o_orderkey"], ["o_custkey"], ["o_custkey", "o_orderdate"]])


_KEYS = ("conv_id", "turn", "role")
_SETS = [(c,) for c in _KEYS] + [(a, b) for i, a in enumerate(_KEYS) for b in _KEYS[i + 1 :]]


@query("WITH s AS (" + " UNION ALL ".join(f"SELECT '{','.join(c)}' AS cols, {len(c)} AS size, count(*) AS n_rows, count(*) = count(DISTINCT ({', '.join(c)})) AS is_key FROM conversations" for c in _SETS)
+ ") SELECT cols, n_rows FROM s WHERE is_key AND NOT EXISTS (SELECT 1 FROM s x WHERE x.is_key AND x.size < s.size AND list_has_all(string_split(s.cols, ','), string_split(x.cols, ',')))")
def discover_keys(t):
    return A.discover_keys(t.conversations, list(_KEYS), 2)


# counts


@query(f"WITH {NULLS_SQL} SELECT c_custkey, count(o_custkey) AS customer__refcount__orders FROM customer LEFT JOIN orders_nullfk ON o_custkey = c_custkey GROUP BY c_custkey")
def refcount(t):
    return C.reference_counts(t.customer.select("c_custkey"), "c_custkey", orders_nullfk(t), "o_custkey", C.count_name("customer", "orders"))


@query(f"""WITH {NULLS_SQL} SELECT c_custkey, count(o_custkey) AS n,
  count(o_custkey) FILTER (WHERE o_orderdate > TIMESTAMP '2000-01-01' - INTERVAL 90 DAY) AS n__90d,
  count(o_custkey) FILTER (WHERE o_orderdate > TIMESTAMP '2000-01-01' - INTERVAL 365 DAY) AS n__365d
FROM customer LEFT JOIN orders_nulls ON o_custkey = c_custkey AND (o_orderdate <= TIMESTAMP '2000-01-01' OR o_orderdate IS NULL) GROUP BY c_custkey""")
def refcount_windowed(t):
    at = F.lit("2000-01-01").cast("timestamp_ntz")
    return C.reference_counts(t.customer.select("c_custkey"), "c_custkey", A.cut_off(orders_nulls(t), ["o_orderdate"], at), "o_custkey", "n", F.col("o_orderdate"), at, (90, 365))


def _asof(days: tuple[int, ...]) -> str:
    return ", ".join([f"count(o_orderdate) FILTER (WHERE o_orderdate > cutoff - INTERVAL {d} DAY) AS n__{d}d" for d in days])


@query(f"WITH {TASK_SQL}, {NULLS_SQL} SELECT c_custkey, cutoff, count(o_orderdate) AS n FROM task LEFT JOIN orders_nulls ON o_custkey = c_custkey AND o_orderdate <= cutoff GROUP BY c_custkey, cutoff")
def count_asof(t):
    return C.counts_as_of(task_rows(t).select("c_custkey", "cutoff"), "c_custkey", F.col("cutoff"), orders_nulls(t), "o_custkey", F.col("o_orderdate"), "n")


@query(f"WITH {TASK_SQL}, {NULLS_SQL} SELECT c_custkey, cutoff, label, count(o_orderdate) AS n, {_asof((30, 90))} FROM task LEFT JOIN orders_nulls ON o_custkey = c_custkey AND o_orderdate <= cutoff GROUP BY c_custkey, cutoff, label")
def count_asof_windowed(t):
    return C.counts_as_of(task_rows(t).select("c_custkey", "cutoff", "label"), "c_custkey", F.col("cutoff"), orders_nulls(t), "o_custkey", F.col("o_orderdate"), "n", (30, 90))


@query(f"WITH {TASK_SQL}, {NULLS_SQL} SELECT c_custkey, cutoff, count(o_orderdate) AS n, {_asof((30, 90))} FROM task LEFT JOIN orders_nulls ON o_custkey = c_custkey AND o_orderdate <= cutoff GROUP BY c_custkey, cutoff")
def count_asof_hot_keys(t):
    return C.counts_as_of_hot(task_rows(t).select("c_custkey", "cutoff"), "c_custkey", F.col("cutoff"), orders_nulls(t), "o_custkey", F.col("o_orderdate"), "n", (30, 90))


@query("""WITH c AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1), s AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1), u AS (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1)
SELECT 'customer' AS t, c_custkey AS k, coalesce(n, 0) AS a, CAST(0 AS BIGINT) AS b FROM customer LEFT JOIN c ON k = c_custkey UNION ALL
SELECT 'nation', n_nationkey, coalesce(s.n, 0), coalesce(u.n, 0) FROM nation LEFT JOIN s ON s.k = n_nationkey LEFT JOIN u ON u.k = n_nationkey""")
def count_features_all(t):
    db = C.add_count_features(files.load_database(t.spark, t.folder, SPEC))
    c = db.tables["customer"].df.select(F.lit("customer").alias("t"), F.col("c_custkey").alias("k"), F.col("customer__refcount__orders").alias("a"), F.lit(0).cast("long").alias("b"))
    n = db.tables["nation"].df.select(F.lit("nation").alias("t"), F.col("n_nationkey").cast("long").alias("k"), F.col("nation__refcount__customer").alias("a"), F.col("nation__refcount__supplier").alias("b"))
    return c.unionByName(n)


@query(f"""WITH {TASK_SQL}, {NULLS_SQL} SELECT c_custkey, count(*) AS pairs, CAST(sum(o_orderkey) AS BIGINT) AS keys
FROM task JOIN orders_nulls ON o_custkey = c_custkey AND (o_orderdate IS NULL OR o_orderdate <= cutoff) GROUP BY c_custkey""")
def asof_join(t):
    pairs = asof_pairs(task_rows(t).select("c_custkey", "cutoff"), orders_nulls(t), "c_custkey", "o_custkey", "cutoff", "o_orderdate")
    return pairs.groupBy("c_custkey").agg(F.count("*").alias("pairs"), F.sum("o_orderkey").alias("keys"))


@query("SELECT user_id, CAST(time_bucket(INTERVAL 1 DAY, ts) AS TIMESTAMP) AS window_start, count(*) AS n FROM events GROUP BY ALL")
def stream_windowed_counts(t):
    out = streams.windowed_counts(t.events, "user_id", "ts")
    return out.withColumn("window_start", F.to_timestamp_ntz(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss")))


# sampling


@query("SELECT o_orderkey, o_custkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def anchor_topk(t):
    return sampling.top_per_key(t.orders, "o_custkey", F.col("o_totalprice"), 3, "o_orderkey").select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def sample_topk(t):
    return sampling.top(t.orders, F.col("o_totalprice"), 100, "o_orderkey").select("o_orderkey")


_U = "((CAST(('0x' || substr(md5('0:' || o_orderkey), 1, 13)) AS BIGINT) + CAST(0.5 AS DOUBLE)) / CAST(4503599627370496 AS DOUBLE))"


@query(f"SELECT o_orderkey, round(-ln(-ln({_U})) - date_diff('day', o_orderdate, TIMESTAMP '2001-08-01') / CAST(180 AS DOUBLE) * CAST(0.6931471805599453 AS DOUBLE), 6) + 0 AS score FROM orders")
def recency_score(t):
    age = F.date_diff(F.lit("2001-08-01").cast("timestamp_ntz"), F.col("o_orderdate"))
    return t.orders.select("o_orderkey", r6(scalar.recency_score(F.col("o_orderkey"), age, F.lit(180.0))).alias("score"))


@query("""WITH test AS (SELECT c_custkey FROM customer), n AS (SELECT count(*) AS n FROM test),
own AS (SELECT o.* FROM orders o SEMI JOIN test ON o_custkey = c_custkey),
anchors AS (SELECT o_orderkey FROM own QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= (SELECT greatest(1, round_even(5000 * CAST(0.25 AS DOUBLE) / n, 0)) FROM n)),
rest AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders ANTI JOIN anchors USING (o_orderkey))
SELECT o_orderkey FROM anchors UNION ALL SELECT o_orderkey FROM rest WHERE r <= 5000 - (SELECT count(*) FROM anchors)""")
def train_sample(t):
    test = t.customer.select(F.col("c_custkey").alias("o_custkey"))
    return sampling.train_sample(t.orders, test, "o_custkey", "o_orderkey", "o_totalprice", 5000, 0.25).select("o_orderkey")


@query("""WITH g AS (SELECT count(DISTINCT o_custkey) AS n FROM orders)
SELECT o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= (SELECT greatest(1, 200 // n) FROM g)""")
def context_sample(t):
    return sampling.context_sample(t.orders, ["o_custkey"], "o_orderkey", F.desc("o_totalprice"), 200)


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) OR c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def relevant_rows(t):
    return sampling.relevant_rows(t.customer, "c_custkey", [("c_custkey", t.orders.where("o_totalprice > 400000"), "o_custkey"), ("c_nationkey", t.nation.where("n_regionkey = 1"), "n_nationkey")])


@query("SELECT CAST(median(gap) AS DOUBLE) AS median_step_s FROM (SELECT epoch(ts - lag(ts) OVER (ORDER BY ts)) AS gap FROM (SELECT DISTINCT ts FROM events)) WHERE gap IS NOT NULL")
def median_step(t):
    return sampling.median_step(t.events, "ts")


@query("SELECT c_custkey, CASE WHEN 100 * row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey * 48271 % 65537, c_custkey) <= 80 * count(*) OVER (PARTITION BY c_mktsegment) THEN 'train' ELSE 'test' END AS split FROM customer")
def stratified_split(t):
    return sampling.stratified_split(t.customer, "c_mktsegment", F.col("c_custkey") * 48271 % 65537, "c_custkey").select("c_custkey", "split")


@query("""WITH r AS (SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS a, row_number() OVER (ORDER BY CAST(o_orderkey * 7919 % 10007 AS DOUBLE), o_orderkey) AS b FROM orders)
SELECT round(corr(a, b), 6) + 0 AS spearman FROM r""")
def spearman(t):
    rows = t.orders.select("o_orderkey", F.col("o_totalprice").alias("x"), (F.col("o_orderkey") * 7919 % 10007).cast("double").alias("y"))
    return rounded(metrics.spearman(rows, "x", "y", "o_orderkey"))


@query(f"WITH {SCORES_SQL} SELECT model, task, mae FROM scores WHERE mae IS NOT NULL ORDER BY mae, model, task LIMIT 5")
def top_trials(t):
    return scores(t).where("mae is not null").orderBy("mae", "model", "task").limit(5).select("model", "task", "mae")
