"""Registration of queries, and the derived tables that several of them use."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.session import table, tidy

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of ``T`` (tables by name) under its name, with its SQL if there is any."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: tidy(lambda: f(Tables(spark, sf_dir)))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


class Tables:
    """The tables of a folder as attributes, and the folder's session."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)


def r6(c: Column | str) -> Column:
    """A float in six digits, without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def rounded(df: DataFrame, *exact: str) -> DataFrame:
    """All double columns in six digits."""
    return df.select(*[r6(c).alias(c) if t in ("double", "float") and c not in exact else F.col(c) for c, t in df.dtypes])


CUTOFFS = [("1998-01-01", "train"), ("1999-01-01", "train"), ("2000-01-01", "val"), ("2001-01-01", "test")]


def cutoffs(t: Tables) -> DataFrame:
    rows = t.spark.createDataFrame([(c, s) for c, s in CUTOFFS], "c string, split string")
    return rows.select(F.to_timestamp_ntz("c").alias("cutoff"), "split")


def task_rows(t: Tables) -> DataFrame:
    """customer x cutoff; label: orders within 90 days after the cutoff; target: their total price."""
    cuts = F.broadcast(cutoffs(t))  # four rows
    o = t.orders.select("o_custkey", "o_orderdate", "o_totalprice").join(cuts.select("cutoff"), (F.col("o_orderdate") > F.col("cutoff")) & (F.col("o_orderdate") <= F.col("cutoff") + F.expr("INTERVAL 90 DAY")))
    hits = o.groupBy(F.col("o_custkey").alias("k"), F.col("cutoff").alias("kc")).agg(F.sum("o_totalprice").alias("target"))
    rows = t.customer.select("c_custkey").crossJoin(cuts)
    out = rows.join(hits, (rows["c_custkey"] == hits["k"]) & (rows["cutoff"] == hits["kc"]), "left")
    return out.select("c_custkey", "cutoff", "split", F.col("k").isNotNull().cast("long").alias("label"), F.coalesce("target", F.lit(0.0)).alias("target"))


TASK_SQL = """
cut AS (SELECT * FROM (VALUES (TIMESTAMP '1998-01-01', 'train', 0), (TIMESTAMP '1999-01-01', 'train', 0),
  (TIMESTAMP '2000-01-01', 'val', 1), (TIMESTAMP '2001-01-01', 'test', 2)) v(cutoff, split, split_at)),
task AS (
  SELECT c_custkey, cutoff, split, CAST(count(o_orderkey) > 0 AS BIGINT) AS label, coalesce(sum(o_totalprice), 0) AS target,
         row_number() OVER (ORDER BY split_at, c_custkey, cutoff) - 1 AS task_id
  FROM customer CROSS JOIN cut LEFT JOIN orders
    ON o_custkey = c_custkey AND o_orderdate > cutoff AND o_orderdate <= cutoff + INTERVAL 90 DAY
  GROUP BY c_custkey, cutoff, split, split_at)
"""


def orders_nullfk(t: Tables) -> DataFrame:
    return t.orders.withColumn("o_custkey", F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey")))


def orders_nulls(t: Tables) -> DataFrame:
    """Orders with null keys and null times."""
    return orders_nullfk(t).withColumn("o_orderdate", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderdate")))


NULLS_SQL = """
orders_nullfk AS (SELECT * REPLACE (CASE WHEN o_custkey % 7 <> 0 THEN o_custkey END AS o_custkey) FROM orders),
orders_nulls AS (SELECT * REPLACE (CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate END AS o_orderdate) FROM orders_nullfk)
"""


def preds(t: Tables, i: int) -> DataFrame:
    """Member i's predictions, from arithmetic scores."""
    p = ((F.col("c_custkey") * (7919 + 104 * i)) % 997 + 1) / F.lit(999.0)
    rows = t.customer.select(F.col("c_custkey").alias("key"), F.lit("2001-01-01").alias("cutoff_timestamp"), (F.col("c_custkey") % 2).alias("y_true"), p.alias("p"))
    return rows.select("key", "cutoff_timestamp", "y_true", (F.col("p") > 0.5).cast("long").alias("y_pred"), F.array(1 - F.col("p"), F.col("p")).alias("proba"))


PREDS_SQL = ", ".join(
    f"""p{i} AS (SELECT c_custkey AS key, '2001-01-01' AS cutoff_timestamp, c_custkey % 2 AS y_true,
  (c_custkey * {7919 + 104 * i} % 997 + 1) / CAST(999 AS DOUBLE) AS p FROM customer)"""
    for i in range(3)
)


def scores(t: Tables) -> DataFrame:
    """model x task results with gaps and ties, from parts: brand as model, type as task."""
    value = (F.col("p_size") % 7).cast("double") + F.col("p_retailprice") / 1000.0
    rows = t.part.groupBy(F.col("p_brand").alias("model"), F.substring_index("p_type", " ", 1).alias("task")).agg(F.max(value).alias("raw"), F.count("*").alias("n"), F.min("p_partkey").alias("k"))
    return rows.select("model", "task", F.when(F.col("k") % 5 != 0, F.round("raw", 1)).alias("mae"), F.when(F.col("k") % 3 != 0, (F.col("k") % 13).cast("double")).alias("r2"), F.col("n").cast("double").alias("cost"))


SCORES_SQL = """
raw AS (SELECT p_brand AS model, split_part(p_type, ' ', 1) AS task,
  max(CAST(p_size % 7 AS DOUBLE) + p_retailprice / 1000.0) AS raw, count(*) AS n, min(p_partkey) AS k FROM part GROUP BY ALL),
scores AS (SELECT model, task, CASE WHEN k % 5 <> 0 THEN round(raw, 1) END AS mae,
  CASE WHEN k % 3 <> 0 THEN CAST(k % 13 AS DOUBLE) END AS r2, CAST(n AS DOUBLE) AS cost FROM raw)
"""
