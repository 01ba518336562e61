"""Document quality by a generalised additive model with pairwise interactions.

Shallow trees are boosted cyclically, one measure at a time, on binned
measures of a text's form; their sum per measure is a lookup table. The pairs
of measures that explain most of what is left then get tables of their own.
Scoring adds table entries, vectorised over a batch.

Defined results: null and empty texts have all measures zero and are scored
like any other; with no labels, or labels of one kind, every score is that
kind's share (0.5 with none); ids labelled twice take the larger label;
repeated rows get equal results; an empty table gives an empty one; other
columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import held_out, labelled_sample, text_udf
from weftline.llm.style import NAMES, measure

#: Labelled documents to learn from, at most; those with the smallest id hashes.
TRAIN_DOCS = 20_000
BINS = 32
PAIR_BINS = 8
PAIRS = 6
ROUNDS = 150
PAIR_ROUNDS = 60
RATE = 0.15
LEAVES = 3
#: Rows in a leaf, at least; and the ridge on a leaf's value.
LEAST, RIDGE = 5, 1.0


class Additive:
    """Lookup tables: an intercept, one table per measure, one per chosen pair."""

    def __init__(self, edges, intercept, tables, pairs, pair_edges, pair_tables):
        self.edges, self.intercept, self.tables = edges, intercept, tables
        self.pairs, self.pair_edges, self.pair_tables = pairs, pair_edges, pair_tables

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for j, (e, t) in enumerate(zip(self.edges, self.tables)):
            out += t[np.searchsorted(e, x[:, j], side="right")]
        for (i, j), t in zip(self.pairs, self.pair_tables):
            out += t[np.searchsorted(self.pair_edges[i], x[:, i], side="right"), np.searchsorted(self.pair_edges[j], x[:, j], side="right")]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def bin_edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Distinct quantiles of each column."""
    return [np.unique(np.quantile(c, np.arange(1, bins) / bins)) for c in x.T]


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Leaf values by bin of the best tree of LEAVES leaves over one measure's bins, grown greedily."""
    parts = [(0, len(g))]
    while len(parts) < LEAVES:
        best = None
        for k, (a, b) in enumerate(parts):
            if b - a < 2:
                continue
            gl, hl, nl = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1], np.cumsum(n[a:b])[:-1]
            gt, ht, nt = g[a:b].sum(), h[a:b].sum(), n[a:b].sum()
            gain = gl**2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE)
            gain[(nl < LEAST) | (nt - nl < LEAST)] = -1
            i = int(gain.argmax())
            if gain[i] > 1e-9 and (best is None or gain[i] > best[0]):
                best = gain[i], k, a + i + 1
        if best is None:
            break
        _, k, at = best
        parts[k : k + 1] = [(parts[k][0], at), (at, parts[k][1])]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = -g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut of a pair's grid into four, its gain, and leaf values by cell."""
    def corner(m):
        c = np.zeros((m.shape[0] + 1, m.shape[1] + 1))
        c[1:, 1:] = m.cumsum(0).cumsum(1)
        return c

    cg, ch = corner(g), corner(h)
    a, b = np.meshgrid(np.arange(1, g.shape[0]), np.arange(1, g.shape[1]), indexing="ij")
    def quads(c):
        ll, l, r, t = c[a, b], c[a, -1], c[-1, b], c[-1, -1]
        return [ll, l - ll, r - ll, t - l - r + ll]

    gq, hq = quads(cg), quads(ch)
    gain = sum(x**2 / (y + RIDGE) for x, y in zip(gq, hq))
    out = np.zeros(g.shape)
    if not gain.size:
        return 0.0, out
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    v = [-x[i, j] / (y[i, j] + RIDGE) for x, y in zip(gq, hq)]
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v
    return float(gain[i, j]), out


def fit(x: np.ndarray, y: np.ndarray) -> Additive:
    """The model of labels ``y`` in measures ``x``."""
    share = float(y.mean()) if len(y) else 0.5
    edges = bin_edges(x, BINS) if len(y) else []
    if not len(y) or share in (0.0, 1.0):
        return Additive([], 30.0 if share == 1 else -30.0 if share == 0 else 0.0, [], [], [], [])
    base = float(np.log(share / (1 - share)))
    bins = [np.searchsorted(e, c, side="right") for e, c in zip(edges, x.T)]
    sizes = [len(e) + 1 for e in edges]
    counts = [np.bincount(b, minlength=s) for b, s in zip(bins, sizes)]
    tables, logit = [np.zeros(s) for s in sizes], np.full(len(y), base)

    def slopes():
        q = 1 / (1 + np.exp(-logit))
        return q - y, q * (1 - q)

    for _ in range(ROUNDS):
        for j, b in enumerate(bins):
            g, h = slopes()
            step = RATE * _tree(np.bincount(b, g, sizes[j]), np.bincount(b, h, sizes[j]), counts[j])
            tables[j] += step
            logit += step[b]
    coarse = bin_edges(x, PAIR_BINS)
    cb = [np.searchsorted(e, c, side="right") for e, c in zip(coarse, x.T)]
    cs = [len(e) + 1 for e in coarse]

    def grid(i, j, v):
        return np.bincount(cb[i] * cs[j] + cb[j], v, cs[i] * cs[j]).reshape(cs[i], cs[j])

    g, h = slopes()
    gains = sorted(((_quadrants(grid(i, j, g), grid(i, j, h))[0], i, j) for i, j in combinations(range(len(cs)), 2)), reverse=True)
    pairs = [(i, j) for _, i, j in gains[:PAIRS]]
    pair_tables = [np.zeros((cs[i], cs[j])) for i, j in pairs]
    for _ in range(PAIR_ROUNDS):
        for k, (i, j) in enumerate(pairs):
            g, h = slopes()
            step = RATE * _quadrants(grid(i, j, g), grid(i, j, h))[1]
            pair_tables[k] += step
            logit += step[cb[i], cb[j]]
    return Additive(edges, base, tables, pairs, coarse, pair_tables)


def measures(texts: list) -> np.ndarray:
    return np.array([measure(t) for t in texts]).reshape(-1, len(NAMES))


def labelled_measures(docs: DataFrame, labels: DataFrame, column: str, most: int = TRAIN_DOCS) -> tuple[np.ndarray, np.ndarray]:
    """Measures and labels of at most ``most`` documents outside the held-out fold, in an order of their own."""

    def run(batches):
        for b in batches:
            x = measures(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array(x.tolist(), pa.list_(pa.float64()))], ["doc_id", "label", "x"])

    sample = labelled_sample(docs, labels, column, most)
    sample = sample.select(F.col("doc_id").cast("string").alias("doc_id"), "text", "label")
    rows = sample.mapInArrow(run, "doc_id string, label int, x array<double>").toArrow().sort_by("doc_id")
    x = np.array(rows.column("x").to_pylist(), float).reshape(-1, len(NAMES))
    return x, rows.column("label").to_numpy().astype(int)


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> Additive:
    x, y = labelled_measures(docs, labels, "quality", most)
    return fit(x, (y > 0).astype(float))


def score_documents(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 from 0.3 on)."""
    model = train(docs, labels, most)

    def work():
        return lambda texts: pa.array(model.scores(measures(texts)))

    found = docs.select("doc_id", text_udf(work, "double")(F.col("text")).alias("score"))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
