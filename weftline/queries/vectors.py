"""Features and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline import models, text
from weftline.functions import scalar
from weftline.operators import pooling
from weftline.queries.base import query, r6, rounded
from weftline.session import materialize


def _arr(expr: str) -> str:
    return f"list_transform({expr}, lambda x: round(CAST(x AS DOUBLE), 6) + 0)"


def _r(c):
    return F.transform(c, lambda x: r6(x.cast("double")))


#: Embeddings of which some have no key, so that they have no context.
KEYED_SQL = "(SELECT vec_id, embedding, CASE WHEN vec_id % 7 <> 0 THEN label END AS label FROM embeddings)"


def keyed(embeddings):
    return embeddings.withColumn("label", F.when(F.col("vec_id") % 7 != 0, F.col("label")))


@query("SELECT o_orderkey, " + ", ".join(f"CAST({p}(o_orderdate) AS FLOAT) AS o_{p}" for p in ("year", "month", "day", "hour")) + ", CAST(epoch(o_orderdate) AS DOUBLE) AS o_total_seconds FROM orders")
def datetime_encode(t):
    return t.orders.select("o_orderkey", *[c.alias(k) for k, c in scalar.datetime_parts(F.col("o_orderdate"), "o").items()])


@query("SELECT o_orderkey, round(CAST(CAST((epoch_us(max(o_orderdate) OVER ()) - epoch_us(o_orderdate)) / 86400000000 AS FLOAT) AS DOUBLE), 4) AS age FROM orders")
def relative_days(t):
    out = scalar.relative_days(t.orders.select("o_orderkey", "o_orderdate"), ["o_orderdate"])
    return out.select("o_orderkey", F.round(F.col("o_orderdate_age").cast("double"), 4).alias("age"))


@query("SELECT vec_id, " + ", ".join(f"round(CAST(embedding[{i + 1}] AS DOUBLE), 6) + 0 AS e__{i}" if i < 64 else f"CAST(NULL AS DOUBLE) AS e__{i}" for i in range(62, 67)) + " FROM embeddings")
def array_fixed_width(t):
    cols = scalar.fixed_width("e", 67)
    return t.embeddings.select("vec_id", F.col("embedding").alias("e")).select("vec_id", *[r6(cols[f"e__{i}"].cast("double")).alias(f"e__{i}") for i in range(62, 67)])


def _prose_sql(limit: str) -> str:
    return f"""WITH s AS (SELECT DISTINCT text FROM (SELECT text FROM documents WHERE text IS NOT NULL ORDER BY doc_id {limit}))
SELECT count(*) AS n_unique, round(avg(len(regexp_extract_all(text, '\\s+')) + 1), 6) AS mean_words, count(*) >= 20 AND avg(len(regexp_extract_all(text, '\\s+')) + 1) >= 4 AS is_prose FROM s"""


@query(_prose_sql("LIMIT 10000"))
def prose_profile(t):
    return rounded(scalar.prose_profile(t.documents, "text", order="doc_id"))


@query(_prose_sql(""))
def prose_profile_whole(t):
    return rounded(scalar.prose_profile(t.documents, "text", sample=None))


@query("""WITH w AS (SELECT p_partkey, unnest(regexp_split_to_array(lower(p_name), '\\s+')) AS w FROM part), h AS (SELECT p_partkey, CAST('0x' || substr(md5(w), 1, 13) AS BIGINT) AS h FROM w)
SELECT p_partkey, """ + ", ".join(f"CAST(coalesce(sum(CASE WHEN (h >> 32) % 2 = 0 THEN 1 ELSE -1 END) FILTER (h % 16 = {i}), 0) AS FLOAT) AS p_name__txt_{i}" for i in range(16)) + " FROM h GROUP BY p_partkey")
def text_embed(t):
    return models.embed_text(t.part.select("p_partkey", "p_name"), "p_name", 16).drop("p_name")


@query("""WITH g AS (SELECT p_partkey, unnest(list_transform(range(1, length(p_name) + 1), lambda i: substr('^' || lower(p_name) || '$', i, 3))) AS g FROM part)
SELECT p_partkey, """ + ", ".join(f"round(min((CAST('0x' || substr(md5('{s}:' || g), 1, 13) AS BIGINT) + CAST(0.5 AS DOUBLE)) / 4503599627370496), 9) AS m{s}" for s in range(3)) + " FROM g GROUP BY p_partkey")
def min_hashes(t):
    return t.part.select("p_partkey", *[F.round(c, 9).alias(f"m{i}") for i, c in enumerate(text.min_hash(F.col("p_name"), 3))])


@query("""WITH x AS (SELECT CAST(o_totalprice AS DOUBLE) / 100000 AS a, CAST(o_totalprice AS DOUBLE) / 200000 + (o_custkey % 97) / CAST(50 AS DOUBLE) AS b FROM orders),
m AS (SELECT 'pca' AS k, var_pop(a) AS p, covar_pop(a, b) AS q, var_pop(b) AS r FROM x UNION ALL SELECT 'svd', avg(a * a), avg(a * b), avg(b * b) FROM x),
e AS (SELECT k, (p + r) / 2 AS h, sqrt((p - r) * (p - r) / 4 + q * q) AS d FROM m)
SELECT k AS method, 0 AS i, round(h + d, 6) AS v FROM e UNION ALL SELECT k, 1, round(h - d, 6) FROM e UNION ALL SELECT * FROM (VALUES ('pca_whiten', 0, 1.0), ('pca_whiten', 1, 1.0), ('svd_whiten', 0, 1.0), ('svd_whiten', 1, 1.0))""")
def component_sizes(t):
    """What a component holds, by each reducer whose signs are free: variance, second moments for SVD, and 1 for whitened ones."""
    a = F.col("o_totalprice").cast("double")
    rows = materialize(t.orders.select(F.array(a / 100000, a / 200000 + F.col("o_custkey") % 97 / F.lit(50.0)).alias("emb")), "pairs")
    out = None
    for method in ("pca", "svd", "pca_whiten", "svd_whiten"):
        parts = models.reduce_dims(rows, "emb", 2, method, 2).select(F.posexplode("emb").alias("i", "x"))
        size = F.avg(F.col("x") * F.col("x")) if method == "svd" else F.var_pop("x")
        one = parts.groupBy("i").agg(size.alias("v")).select(F.lit(method).alias("method"), "i", F.round("v", 6).alias("v"))
        out = one if out is None else out.unionByName(one)
    return out


@query("""WITH d AS (SELECT DISTINCT p_name AS t FROM part), w AS (SELECT t, unnest(string_split(lower(t), ' ')) AS w FROM d), c AS (SELECT t, w, count(*) AS tf FROM w GROUP BY ALL),
i AS (SELECT w, ln((SELECT count(*) FROM d) / CAST(count(*) AS DOUBLE)) + 1 AS idf FROM c GROUP BY w), n AS (SELECT t, sum(tf * idf * tf * idf) AS n FROM c JOIN i USING (w) GROUP BY t)
SELECT p_partkey, round(n, 4) AS size FROM part JOIN n ON t = p_name""")
def text_vectors(t):
    """Squared lengths of the latent vectors of part names: those of their TF-IDF, as the dimensions are as many as the words."""
    made = text.TextVectors(16).vectors(t.part, "p_name").select("text", F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x).alias("n"))
    return t.part.join(made, F.col("p_name") == F.col("text")).select("p_partkey", F.round("n", 4).alias("size"))


@query("SELECT o_orderkey, round(ln(1 + o_totalprice), 6) AS y, round(greatest(exp(ln(1 + o_totalprice)) - 1, 0), 3) AS back FROM orders")
def target_transform(t):
    y = scalar.log_target(F.col("o_totalprice"))
    return t.orders.select("o_orderkey", r6(y).alias("y"), F.round(scalar.unlog_target(y), 3).alias("back"))


def _pool_sql(agg: str) -> str:
    return f"""WITH e AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), a AS (SELECT label, i, {agg}(CAST(x AS DOUBLE)) AS v, count(*) AS c FROM e GROUP BY ALL)
SELECT label, {_arr('list(v ORDER BY i)')} AS emb, max(c) AS cnt FROM a GROUP BY label"""


def _pool(how: str, agg: str):
    def f(t):
        return pooling.pool(t.embeddings, ["label"], "embedding", how).withColumn("emb", _r(F.col("emb")))

    f.__name__ = f"pool_{how}"
    query(_pool_sql(agg))(f)


for _how, _agg in (("sum", "sum"), ("mean", "avg"), ("max", "max")):
    _pool(_how, _agg)


@query(f"""WITH e AS (SELECT vec_id % 2 AS t, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), a AS (SELECT t, label, i, avg(CAST(x AS DOUBLE)) AS v FROM e GROUP BY ALL), b AS (SELECT label, i, avg(v) AS v, count(*) AS c FROM a GROUP BY ALL)
SELECT label, {_arr('list(v ORDER BY i)')} AS emb, max(c) AS cnt FROM b GROUP BY label""")
def pool_tables(t):
    parts = [pooling.pool(t.embeddings.where(F.col("vec_id") % 2 == k), ["label"], "embedding", "mean").select("label", "emb") for k in (0, 1)]
    return pooling.pool(parts[0].unionByName(parts[1]), ["label"], "emb", "mean").withColumn("emb", _r(F.col("emb")))


@query(f"""WITH e AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), a AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS v FROM e GROUP BY ALL), c AS (SELECT label, list(v ORDER BY i) AS ctx FROM a GROUP BY label)
SELECT vec_id, {_arr('CASE WHEN ctx IS NULL THEN embedding ELSE list_transform(list_zip(embedding, ctx), lambda p: (CAST(p[1] AS DOUBLE) + CAST(0.5 AS DOUBLE) * p[2]) / 2) END')} AS emb FROM {KEYED_SQL} LEFT JOIN c USING (label)""")
def combine_embeddings(t):
    ctx = pooling.pool(t.embeddings, ["label"], "embedding", "mean", "ctx").drop("cnt")
    own = F.transform("embedding", lambda x: x.cast("double"))
    return keyed(t.embeddings).join(ctx, "label", "left").select("vec_id", _r(pooling.combine(own, F.col("ctx"), "mean", 0.5)).alias("emb"))


@query(f"""WITH e AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), s AS (SELECT vec_id, i, CAST(x AS DOUBLE) AS x, (i - 1) // 16 AS b FROM e),
m AS (SELECT vec_id, b, avg(x) AS m, avg(x * x) - avg(x) * avg(x) AS v FROM s GROUP BY ALL)
SELECT vec_id, list(round((x - m) / sqrt(v + CAST(1e-5 AS DOUBLE)), 5) + 0 ORDER BY i) AS emb FROM s JOIN m USING (vec_id, b) GROUP BY vec_id""")
def layer_norm(t):
    x = F.transform("embedding", lambda v: v.cast("double"))
    out = t.embeddings.select("vec_id", x.alias("x")).select("vec_id", pooling.layer_norm(F.col("x"), 16).alias("emb"))
    return out.withColumn("emb", F.transform("emb", lambda v: F.round(v, 5) + F.lit(0.0)))


@query(f"SELECT vec_id, {_arr('embedding[1:8]')} AS emb FROM embeddings")
def reduce_first_k(t):
    out = models.reduce_dims(t.embeddings.select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("emb")), "emb", 64, "first_k", 8)
    return out.withColumn("emb", _r(F.col("emb")))


@query(f"""WITH e AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) - 1 AS j FROM embeddings),
p AS (SELECT vec_id, i, sum(x * CASE WHEN ((i * 7919 + j * 104729 + 31) * 2654435761 // 65536) % 2 = 1 THEN 1 ELSE -1 END / sqrt(CAST(4 AS DOUBLE))) AS v FROM e CROSS JOIN range(4) r(i) GROUP BY ALL)
SELECT vec_id, {_arr('list(v ORDER BY i)')} AS emb FROM p GROUP BY vec_id""")
def reduce_sign_rp(t):
    out = models.reduce_dims(t.embeddings.select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("emb")), "emb", 64, "sign_random_projection", 4)
    return out.withColumn("emb", _r(F.col("emb")))


def _reduce(method: str, sql: str | None = None):
    def f(t):
        rows = t.embeddings.select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("emb"))
        out = models.reduce_dims(rows, "emb", 64, method, 8)
        return out.withColumn("emb", _r(F.col("emb"))) if sql else out

    f.__name__ = f"reduce_{method}"
    query(sql)(f)


def _product_sql(matrix: list[list[float]]) -> str:
    """Each row of a literal matrix times the embedding."""
    rows = ", ".join(f"list_inner_product(CAST(embedding AS DOUBLE[]), [{', '.join(f'{x!r}::DOUBLE' for x in row)}])" for row in matrix)
    return f"SELECT vec_id, {_arr(f'[{rows}]')} AS emb FROM embeddings"


_reduce("gaussian_random_projection", _product_sql(models.gaussian_matrix(8, 64, 1)))
_reduce("sparse_random_projection", _product_sql(models.gaussian_matrix(8, 64, 1, 64**-0.5)))
_reduce("random_k", f"SELECT vec_id, {_arr('[' + ', '.join(f'embedding[{i + 1}]' for i in models.random_places(64, 8, 1)) + ']')} AS emb FROM embeddings")
for _m in ("pca", "pca_whiten", "svd", "svd_whiten"):
    _reduce(_m)


@query(f"""WITH e AS (SELECT vec_id // 4 AS row, vec_id % 4 AS est, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)
SELECT row, {_arr('list(x ORDER BY i, est)')} AS emb FROM e GROUP BY row""")
def merge_estimators(t):
    rows = t.embeddings.select(F.floor(F.col("vec_id") / 4).alias("row"), (F.col("vec_id") % 4).alias("est"), F.col("embedding").alias("x"))
    return pooling.merge_estimators(rows, "row", "est", "x").withColumn("emb", _r(F.col("emb")))


@query("SELECT vec_id, label, " + ", ".join(f"round(CAST(embedding[{i + 1}] AS DOUBLE), 6) + 0 AS _ctx_emb_{i}" for i in range(64)) + " FROM embeddings")
def fuse_early(t):
    return rounded_floats(pooling.fuse(t.embeddings, "embedding", 64))


def rounded_floats(df):
    return rounded(df.select(*[F.col(c).cast("double").alias(c) if k == "float" else F.col(c) for c, k in df.dtypes]))
