"""Prediction over a set of linked tables, end to end.

Rewrites shrink the schema; rows to learn from are sampled and join the rows
to predict; relevance goes outward from both, and each table keeps what is
relevant, up to a budget; embeddings go inward, every table's rows being
extracted from their features and what their successors' rows, as of their
time, pool to; a backbone predicts from the task's features and context.

Three kinds of fusion: ``none`` predicts from the rewritten task table alone,
``early`` puts context beside features before extraction, ``late`` combines it
with what was extracted. ``layers`` takes, in place of one pass inward, rounds
in which every table is extracted again with the last round's context from all
its neighbours.

All steps are plans over rows; tables are written where a pass needs them
twice. Keys and references carry no meaning of their own and are no features.
Rows to predict are taken together, or in batches that each have rows to learn
from of their own; context is found and extracted once for all batches.

Defined results: a row without context has null context, filled by the mean
where it is extracted; a table without relevant rows is left out; without
rows to predict the result is empty. The target of rows to predict is carried
along and never read.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from inspect import signature

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.catalog import Database, Edge, Rel, Task
from weftline.functions.scalar import log_target, unlog_target
from weftline.models import Backbone, LinearBackbone, Vectorizer, extract, reduce_estimators
from weftline.operators.algebra import numbered
from weftline.operators.metrics import binary, ranking, regression, target_coverage
from weftline.operators.pooling import combine, fuse, interleave, layer_norm, pool
from weftline.operators.sampling import batch_samples, context_sample, recency_scores, train_sample
from weftline.plans import rewrite
from weftline.plans.graph import distances, inference_dag, topological
from weftline.plans.inference import pool_edge, relevance
from weftline.session import materialize

ROW, BATCH, LEARNT = "__row", "__batch", "__learnt"


@dataclass(frozen=True)
class Settings:
    """What a run may vary."""

    fusion: str = "early"
    #: How rows of a key, of several tables, and own and context embeddings are pooled.
    key_pooling: str = "mean"
    successor_pooling: str = "mean"
    combine_pooling: str = "mean"
    successor_weight: float = 1.0
    normalize: bool = False
    #: Elements of an extracted embedding, its activation, and how early fusion reduces it.
    dim: int = 16
    activation: str | None = "relu"
    reduce: str | None = None
    reduce_dim: int = 8
    #: Extractions with projections of their own, carried side by side; whether early fusion reduces each apart.
    estimators: int = 1
    reduce_apart: bool = False
    #: Pool along shortest paths to the task alone; learn the logarithm of targets.
    shortest_paths: bool = False
    log_target: bool = False
    future: bool = False
    #: Numbers of context rows beside the features.
    counts: bool = True
    #: Rewrites: counts of references, depth of unrolled junctions.
    refcounts: str | None = "before"
    junction_depth: int = 1
    #: Rows to learn from, and of a context table, at most; None takes all.
    train_rows: int | None = 50_000
    context_rows: int | None = 50_000
    #: Rows to predict of a batch; None takes all together.
    batch_rows: int | None = None
    anchor_fraction: float = 0.0
    restrict: bool = False
    fill_from_test_keys: bool = False
    half_life_steps: float | None = None
    #: Rounds of layered propagation instead of one pass; whether they go through the task table.
    layers: int | None = None
    include_task: bool = False
    levels: int = 8
    width: int = 16
    min_hashes: int = 0
    seed: int = 0


@dataclass
class Prepared:
    """The rewritten database with row ids, the task's column names, and ids of rows to learn from and to predict."""

    db: Database
    table: str
    id_col: str
    time_col: str
    target_col: str
    split_col: str
    refs: dict[str, set[str]] = field(default_factory=dict)
    #: (batch, id): which rows to learn from and to predict are of which batch, if there are batches.
    batches: DataFrame | None = None


def prepare(task: Task, settings: Settings, evaluate: str) -> Prepared:
    """Rewrites, samples and numbers the rows of all tables; each is written once."""
    name = lambda c: f"{task.table}__{c}"
    db = rewrite.simplify(task.db, task.table, settings.refcounts, settings.junction_depth)
    rel = db.tables[task.table]
    split, id_col, time, entity = (name(c) for c in (task.split_col, task.id_col, task.time_col, task.entity_col))
    rows = materialize(rel.df, "task")
    train = rows.where(F.col(split) == "train") if evaluate == "val" else rows.where(F.col(split) != "test")
    test = rows.where(F.col(split) == evaluate)
    sample, batches = train, None
    scored = recency_scores(train, id_col, time, settings.half_life_steps, "__score", settings.seed) if settings.train_rows is not None else None
    if settings.batch_rows is not None:
        dealt = numbered(test, [id_col], "__at").withColumn(BATCH, F.floor(F.col("__at") / settings.batch_rows).cast("long"))
        dealt = materialize(dealt.select(BATCH, id_col, entity), "dealt")
        if scored is None:
            batches = dealt.select(BATCH).distinct().crossJoin(train.select(id_col))
        else:
            batches = batch_samples(scored.select(id_col, entity, "__score"), dealt, BATCH, entity, id_col, "__score", settings.train_rows, settings.anchor_fraction, settings.restrict, settings.fill_from_test_keys)
        batches = materialize(batches.select(BATCH, id_col).union(dealt.select(BATCH, id_col)), "batches")
        sample = train.join(batches.select(id_col).distinct(), id_col, "left_semi")
    elif scored is not None:
        sample = train_sample(scored, test, entity, id_col, "__score", settings.train_rows, settings.anchor_fraction, settings.restrict, settings.fill_from_test_keys).drop("__score")
    chosen = materialize(sample.withColumn(split, F.lit("train")).unionByName(test.withColumn(split, F.lit("test"))), "chosen")
    tables = {task.table: rel.with_df(chosen.withColumn(ROW, F.col(id_col)))}
    for t, r in db.tables.items():
        if t != task.table and settings.fusion != "none":
            tables[t] = r.with_df(materialize(r.df.withColumn(ROW, F.monotonically_increasing_id()), "rows"))
    refs: dict[str, set[str]] = {t: set(r.keys) for t, r in db.tables.items()}
    for e in db.edges:  # of tables that are left out too: their keys are no features either
        refs[e.source].add(e.source_col)
        refs[e.target].add(e.target_col)
    db = Database(tables, tuple(e for e in db.edges if e.source in tables and e.target in tables))
    refs[task.table] |= {entity}
    return Prepared(db, task.table, id_col, time, name(task.target_col), split, refs, batches)


def restrict_to_relevant(p: Prepared, settings: Settings) -> Database:
    """Tables with the rows that the task's rows reach, each up to the budget, shared out over the rows that refer to it."""
    found = relevance(p.db, p.table, p.db.tables[p.table].df, ROW, settings.shortest_paths)
    tables = {p.table: p.db.tables[p.table]}
    edges = [e for e in inference_dag(p.db, p.table, settings.shortest_paths) if e.source in found and e.target in found]
    for t in found:
        if t == p.table:
            continue
        rows = p.db.tables[t].df.join(found[t], ROW, "left_semi")
        into = [e for e in edges if e.target == t]
        links = None
        for e in into:
            part = rows.select(ROW, F.col(e.target_col).cast("string").alias("__key"), F.lit(e.source).alias("__from"))
            links = part if links is None else links.unionByName(part)
        if links is not None and settings.context_rows is not None and rows.count() > settings.context_rows:
            kept = context_sample(links, ["__from", "__key"], ROW, F.xxhash64(ROW, F.lit(settings.seed)), settings.context_rows)
            rows = rows.join(kept, ROW, "left_semi")
        tables[t] = p.db.tables[t].with_df(materialize(rows, "context"))
    return Database(tables, tuple(e for e in p.db.edges if e.source in tables and e.target in tables))


class Extractor:
    """Row embeddings of tables, with or without context."""

    def __init__(self, p: Prepared, settings: Settings):
        self.p, self.settings = p, settings
        self.seen: dict[str, tuple[DataFrame, list[str]]] = {}
        self.reduced = settings.reduce is not None and settings.fusion == "early"
        #: Elements of an embedding, and of those one estimator's.
        self.one = settings.reduce_dim if self.reduced else settings.dim
        self.many = 1 if self.reduced and not settings.reduce_apart else settings.estimators
        self.width = self.one * self.many

    def merged(self, column: str):
        """An embedding as the features it is fused as: by dimension first and estimator within it."""
        return interleave(F.col(column), self.many, self.one)

    def features(self, rel: Rel) -> tuple[DataFrame, list[str]]:
        """Row ids with the table's vectorized columns; fitted and written once a table."""
        if rel.name not in self.seen:
            s, p = self.settings, self.p
            own = {p.id_col, p.target_col, p.split_col} if rel.name == p.table else set()
            v = Vectorizer(s.levels, s.width, tuple(self.p.refs[rel.name] | own | {ROW}), s.min_hashes).fit(rel.df)
            keep = (ROW, *([p.target_col, p.split_col] if rel.name == p.table else []))
            out = materialize(v.transform(rel.df, keep), "features")
            self.seen[rel.name] = out, [c for c in out.columns if c not in keep]
        return self.seen[rel.name]

    def with_context(self, df: DataFrame, names: list[str], contexts: list[DataFrame]) -> tuple[DataFrame, list[str]]:
        """Context counts and, for early fusion, context elements as columns beside ``names``."""
        s = self.settings
        for i, c in enumerate(contexts):
            c = c.select(F.col(ROW).alias("__c"), F.col("emb").alias("__ctx"), F.col("cnt").alias("__cnt"))
            df = df.join(c, F.col(ROW) == F.col("__c"), "left").drop("__c")
            if s.counts:
                df = df.withColumn(f"__cnt_{i}", F.coalesce("__cnt", F.lit(0)).cast("float"))
                names = [*names, f"__cnt_{i}"]
            df = df.drop("__cnt")
            if s.fusion == "early":
                prefix = f"_ctx_emb_{i}_" if len(contexts) > 1 else "_ctx_emb_"
                df = fuse(df.withColumn("__ctx", self.merged("__ctx")), "__ctx", self.width, prefix)
                names = [*names, *[f"{prefix}{k}" for k in range(self.width)]]
            else:
                df = df.drop("__ctx")
        return df, names

    def extract(self, rel: Rel, contexts: list[DataFrame]) -> DataFrame:
        """(row, emb) of a table."""
        s = self.settings
        df, names = self.with_context(*self.features(rel), contexts)
        out = extract(df, names, s.dim, [ROW], s.seed + 1, s.activation, s.estimators)
        if contexts and s.fusion == "late":
            out = self.late(out, contexts)
        if self.reduced:
            out = reduce_estimators(materialize(out, "extracted"), "emb", s.estimators, s.dim, s.reduce, s.reduce_dim, s.seed, s.reduce_apart)
        return materialize(out, "embeddings")

    def late(self, own: DataFrame, contexts: list[DataFrame]) -> DataFrame:
        """Own embeddings combined with those of all successors."""
        s = self.settings
        every = None
        for c in contexts:
            c = c.select(ROW, self.normal("emb").alias("emb"))
            every = c if every is None else every.unionByName(c)
        pooled = pool(every, [ROW], "emb", s.successor_pooling).select(F.col(ROW).alias("__c"), self.normal("emb").alias("__ctx"))
        joined = own.join(pooled, F.col(ROW) == F.col("__c"), "left")
        joined = joined.withColumn("__sum", combine(F.col("emb"), F.col("__ctx"), s.combine_pooling, s.successor_weight))
        return joined.withColumn("emb", self.normal("__sum")).drop("__c", "__ctx", "__sum")

    def normal(self, column: str):
        return layer_norm(F.col(column), self.settings.dim) if self.settings.normalize else F.col(column)

    def contexts(self, db: Database, edges: list[Edge], done: dict[str, DataFrame], future: bool) -> list[DataFrame]:
        return [pool_edge(db, e, done[e.target], self.settings.key_pooling, ROW, future) for e in edges if e.target in done]


def one_pass(db: Database, x: Extractor) -> list[DataFrame]:
    """The task rows' context, once all tables are extracted from the outermost inward."""
    task = x.p.table
    edges = inference_dag(db, task, x.settings.shortest_paths)
    done: dict[str, DataFrame] = {}
    for t in reversed(topological(list(db.tables), edges) or []):
        if t != task:
            done[t] = x.extract(db.tables[t], x.contexts(db, [e for e in edges if e.source == t], done, x.settings.future))
    return x.contexts(db, [e for e in edges if e.source == task], done, x.settings.future)


def layered(db: Database, x: Extractor) -> list[DataFrame]:
    """The task rows' context after rounds in which every table draws on all its neighbours.

    The first round extracts without context. A table too far from the task
    for what is left of the rounds to reach it is skipped, and so is the task
    table unless it is to be passed through.
    """
    s, task = x.settings, x.p.table
    if s.fusion != "early" or not s.future:
        raise ValueError("layered propagation takes early fusion and context from the future")
    away = distances(db, task)
    both = [e for y in db.edges for e in (y, y.inverse)]
    done: dict[str, DataFrame] = {}
    for layer in range(s.layers or 0):
        left = (s.layers or 0) - 1 - layer
        new: dict[str, DataFrame] = {}
        for t in db.tables:
            if t not in away or away[t] >= left + 2 or (t == task and (left == 0 or not s.include_task)):
                continue
            contexts = x.contexts(db, [e for e in both if e.source == t], done, True)
            new[t] = x.extract(db.tables[t], contexts) if contexts or not done else done[t]
        done = new
    return x.contexts(db, [e for e in both if e.source == task and e.target != task], done, True)


def predict(task: Task, settings: Settings = Settings(), backbone: Backbone | None = None, evaluate: str = "test") -> DataFrame:  # noqa: B008
    """One row per row to predict: its id, target, ``y_pred``, and for classes ``proba``."""
    if settings.fusion not in ("none", "early", "late"):
        raise ValueError(f"unknown fusion: {settings.fusion}")
    p = prepare(task, settings, evaluate)
    x = Extractor(p, settings)
    rel = p.db.tables[p.table]
    df, names = x.features(rel)
    if settings.fusion != "none":
        if settings.layers:
            db, contexts = p.db, layered(p.db, x)
        else:
            db = restrict_to_relevant(p, settings)
            contexts = one_pass(db, x)
        if settings.fusion == "early":
            df, names = x.with_context(df, names, contexts)
        else:
            own = x.extract(rel, contexts).select(F.col(ROW).alias("__e"), x.merged("emb").alias("emb"))
            df = fuse(df.join(own, F.col(ROW) == F.col("__e")).drop("__e"), "emb", x.width, "_emb_")
            names = [*names, *[f"_emb_{i}" for i in range(x.width)]]
    target = F.col(p.target_col)
    learnt = log_target(target) if settings.log_target else target
    rows = materialize(df.withColumn(LEARNT, F.when(F.col(p.split_col) == "train", learnt)), "vectors")
    names = known(rows.where(F.col(p.split_col) == "train"), names)
    backbone = backbone or LinearBackbone(task.kind == "regression")
    out = predict_rows(backbone, rows, p, names)
    if settings.log_target:
        out = out.withColumn("y_pred", unlog_target(F.col("y_pred")))
    made = [c for c in ("y_pred", "proba") if c in out.columns]
    return out.select(F.col(ROW).alias(task.id_col), target.alias(task.target_col), *made)


def predict_rows(backbone: Backbone, rows: DataFrame, p: Prepared, names: list[str]) -> DataFrame:
    """The rows to predict with what the backbone makes of them, batch by batch if there are batches.

    A backbone that takes batches gets all at once.
    """
    parts = lambda df: [df.where(F.col(p.split_col) == s) for s in ("train", "test")]
    if p.batches is None:
        return backbone.predict(*parts(rows), names, LEARNT)
    dealt = rows.join(p.batches.select(BATCH, F.col(p.id_col).alias("__b")), F.col(ROW) == F.col("__b")).drop("__b")
    if "batch" in signature(backbone.predict).parameters:
        return backbone.predict(*parts(dealt), names, LEARNT, batch=BATCH)
    dealt, out = materialize(dealt, "dealt"), None
    for (b,) in p.batches.select(BATCH).distinct().orderBy(BATCH).collect():
        one = backbone.predict(*parts(dealt.where(F.col(BATCH) == b)), names, LEARNT)
        out = one if out is None else out.unionByName(one)
    return out if out is not None else backbone.predict(*parts(dealt), names, LEARNT)


def known(train: DataFrame, names: list[str]) -> list[str]:
    """Features that have any value to learn from."""
    found = train.agg(*[F.count(n).alias(n) for n in names]).first() if names else {}
    return [n for n in names if found[n]]


def evaluate(task: Task, predictions: DataFrame) -> DataFrame:
    """One row of metrics of predictions."""
    if task.kind == "regression":
        return regression(predictions, task.target_col, "y_pred")
    scored = predictions.withColumn("p", F.get("proba", F.lit(1)))
    return binary(predictions, task.target_col, "y_pred").crossJoin(ranking(scored, task.target_col, "p"))  # single rows


def coverage(task: Task, settings: Settings, predictions: DataFrame) -> DataFrame:
    """How the targets learnt from cover those predicted."""
    p = prepare(task, replace(settings, fusion="none"), "test")
    rows = p.db.tables[p.table].df
    train = rows.where(F.col(p.split_col) == "train").select(F.col(p.target_col).alias(task.target_col))
    return target_coverage(train, predictions, task.target_col, "y_pred")
