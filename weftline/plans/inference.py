"""Relational inference as plans: relevance outward from the task, embeddings pooled inward, propagation in layers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.catalog import Database, Edge
from weftline.operators.algebra import effective_time
from weftline.operators.pooling import combine, pool, pool_as_of
from weftline.plans.graph import inference_dag, topological
from weftline.session import materialize


def relevance(db: Database, task: str, rows: DataFrame, row_id: str = "__row", shortest: bool = False) -> dict[str, DataFrame]:
    """The ids of each table's rows that the task's rows reach along the inference edges; tables without any are left out.

    One semi-join per edge, in topological order, with ids written between levels.
    """
    edges = inference_dag(db, task, shortest)
    order = topological(list(db.tables), edges) or []
    found = {task: rows.select(row_id)}
    for t in order:
        parts = []
        for e in edges:
            if e.target == t and e.source in found:
                src = db.tables[e.source].df.join(found[e.source], row_id, "left_semi").select(F.col(e.source_col).alias("__k"))
                parts.append(db.tables[t].df.join(src, F.col(e.target_col) == F.col("__k"), "left_semi").select(row_id))
        if parts:
            hit = parts[0]
            for p in parts[1:]:
                hit = hit.union(p)
            hit = materialize(hit.distinct(), "relevant")
            if not hit.isEmpty():
                found[t] = hit
    return found


def pool_edge(db: Database, edge: Edge, embeddings: DataFrame, how: str, row_id: str = "__row", future: bool = False) -> DataFrame:
    """(row, emb, cnt): the embeddings of the rows an edge leads to, pooled for each row it starts from.

    Where both sides have times, running sums by key and time; else the far
    rows are pooled by key and then meet the near ones. Either way no pair of
    rows is made.
    """
    a, b = db.tables[edge.source], db.tables[edge.target]
    timed = bool(a.times and b.times) and not future
    time = lambda r: [effective_time(list(r.times)).alias("time")] if timed else []
    near = a.df.select(F.col(row_id).alias("id"), F.col(edge.source_col).alias("key"), *time(a))
    far = b.df.select(F.col(row_id).alias("__h"), F.col(edge.target_col).alias("key"), *time(b))
    far = far.join(embeddings.select(F.col(row_id).alias("__e"), "emb"), F.col("__h") == F.col("__e")).drop("__h", "__e")
    if timed:
        out = pool_as_of(near, far, how)
    else:
        out = near.join(pool(far.where("key IS NOT NULL"), ["key"], "emb", how), "key").drop("key")
    return out.withColumnRenamed("id", row_id)


def propagate(db: Database, task: str, features: dict[str, DataFrame], how: str = "mean", weight: float = 1.0, row_id: str = "__row") -> DataFrame:
    """The task rows' embeddings after one sweep inward: each table pools its successors and combines them with its own rows' features."""
    edges = inference_dag(db, task)
    order = topological(list(db.tables), edges) or []
    done: dict[str, DataFrame] = {}
    for t in reversed(order):
        own = features[t]
        for e in (e for e in edges if e.source == t and e.target in done):
            ctx = pool_edge(db, e, done[e.target], how, row_id).select(F.col(row_id).alias("__c"), F.col("emb").alias("__ctx"))
            own = own.join(ctx, F.col(row_id) == F.col("__c"), "left").select(row_id, combine(F.col("emb"), F.col("__ctx"), how, weight).alias("emb"))
        done[t] = materialize(own, "embeddings")
    return done[task]


def message_passing(db: Database, features: dict[str, DataFrame], rounds: int = 2, how: str = "mean", weight: float = 0.5, row_id: str = "__row") -> dict[str, DataFrame]:
    """Every table pools from all its neighbours, both ways along every reference, round by round; future rows are admitted."""
    now = features
    for _ in range(rounds):
        new = {}
        for t in db.tables:
            own = now[t]
            for e in (x for y in db.edges for x in (y, y.inverse) if x.source == t):
                ctx = pool_edge(db, e, now[e.target], how, row_id, future=True).select(F.col(row_id).alias("__c"), F.col("emb").alias("__ctx"))
                own = own.join(ctx, F.col(row_id) == F.col("__c"), "left").select(row_id, combine(F.col("emb"), F.col("__ctx"), how, weight).alias("emb"))
            new[t] = materialize(own, "layer")
        now = new
    return now
