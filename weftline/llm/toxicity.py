"""Toxic spans by a linear-chain conditional random field, aggregated to document scores.

Tokens are runs of non-space. Labels of documents become labels of tokens: a
token of a toxic document is a toxic token if its word, or a prefix of it, is
a marker, that is, occurs in more toxic documents than chance allows and
mostly there; all other tokens are not. The field learns from the whole texts
of a bounded sample of labelled documents: each round is a pass over the
sample, in which tasks run forward-backward and add up slopes. Its marginals
give spans with offsets; their maximum and their sum, against the text's
length, give a document's score by a logistic regression on the labelled
documents.

Defined results: null and tokenless texts score 0; with no toxic labels to
learn from all texts do; ids labelled twice take the larger label; repeated
rows get equal results; an empty table gives an empty one; other columns are
ignored.
"""

from __future__ import annotations

import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import held_out, labelled_sample, portions, text_udf
from weftline.session import materialize, release

#: Labelled documents to learn from, at most; those with the smallest id hashes.
TRAIN_DOCS = 10_000
#: Those of them whose whole texts the field is fitted to, at most.
FIELD_DOCS = 3_000
#: Lengths of the prefixes that are features.
PREFIXES = (3, 4, 5, 6, 7)
#: Share of a marker's documents that are toxic, at least.
PURE = 0.5
#: Buckets that the features of tokens are hashed to; their weights travel with each pass, half a MB.
BUCKETS = 1 << 17
#: Passes over the sample, and tasks of a pass; each sends its slopes to the driver, half a MB.
ROUNDS, PARTS = 40, 8
#: Chance markers to expect among all tried.
CHANCE = 0.05
#: Feature counts that a task holds before it passes them on.
HELD_COUNTS = 400_000
#: Tokens, and their letters, whose scores a task keeps; beyond, it starts anew.
CACHE, CACHE_LETTERS = 300_000, 16_000_000
#: Tokens per block of the two-level scan.
BLOCK = 32
#: Documents tagged together.
AT_ONCE = 512
#: Their letters, at most, unless one text alone has more.
AT_ONCE_LETTERS = 4_000_000
#: A token with at least this marginal belongs to a span.
SPAN = 0.5

TOKEN = re.compile(r"\S+")
EDGE = re.compile(r"^\W+|\W+$")


def normal(token: str) -> str:
    """A token in lower case without the marks around it."""
    return EDGE.sub("", token.lower())


def features(word: str) -> list[str]:
    """What the field sees of a normalised token."""
    return ["w:" + word, *(str(k) + word[:k] for k in PREFIXES), "e:" + word[-3:]]


def buckets(words: list[str]) -> np.ndarray:
    """The buckets of the features of normalised tokens, a row each."""
    hashed = [zlib.crc32(f.encode("utf-8", "surrogatepass")) for w in words for f in features(w)]
    return np.array(hashed, np.int64).reshape(-1, len(PREFIXES) + 2) % BUCKETS


def marker_features(word: str) -> list[str]:
    """What of a normalised token may be a marker."""
    return ["w:" + word, *(str(k) + word[:k] for k in PREFIXES if len(word) >= k)] if word else []


def find_markers(sample: DataFrame) -> set[str]:
    """Features of toxic documents, in by far more of them than chance allows; over (text, label) rows."""

    def count(batches):
        held: dict[str, list[int]] = {}

        def flush():
            rows = list(held.values())
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), *(pa.array([v[i] for v in rows], pa.int64()) for i in range(2))], ["feature", "clean", "toxic"])
            held.clear()
            return out

        for b in batches:
            for text, label in zip(b.column("text").to_pylist(), b.column("label").to_pylist()):
                own = {f for t in set((text or "").split()) for f in marker_features(normal(t))}
                for f in own:
                    held.setdefault(f, [0, 0])[1 if label else 0] += 1
                if len(held) > HELD_COUNTS:
                    yield flush()
        yield flush()

    counts = sample.select("text", "label").mapInArrow(count, "feature string, clean bigint, toxic bigint")
    sums = counts.groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    docs, toxic = sample.agg(F.count("*"), F.coalesce(F.sum((F.col("label") > 0).cast("int")), F.lit(0))).first()
    if not toxic or docs == toxic:
        return set()
    p = toxic / docs
    n, share = F.col("clean") + F.col("toxic"), F.col("toxic") / (F.col("clean") + F.col("toxic"))
    surprise = n * (share * F.log(share / p) + F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - p))).otherwise(0.0))
    rows = sums.where((F.col("toxic") >= 3) & (share > p) & (share >= PURE) & (surprise >= float(np.log(docs * 100 / CHANCE))))
    return set(rows.select("feature").toArrow().column("feature").to_pylist())


KINDS = {"sizes": pa.int32(), "tokens": pa.int32(), "labels": pa.int8(), "features": pa.int32()}


def sequences(sample: DataFrame, markers: set[str]) -> DataFrame:
    """The whole texts of the sample as labelled chains, a row for some documents each.

    ``sizes`` are tokens of texts, ``tokens`` places among the row's distinct
    normalised tokens, ``labels`` one a token, ``features`` the buckets of the
    distinct tokens.
    """

    def cut(batches):
        for b in batches:
            texts, marks = b.column("text").to_pylist(), b.column("label").to_pylist()
            for i, end in portions(texts, AT_ONCE, AT_ONCE_LETTERS):
                lists = [[normal(t) for t in (x or "").split()] for x in texts[i:end]]
                place = {w: k for k, w in enumerate(dict.fromkeys(chain.from_iterable(lists)))}
                hit = np.fromiter((any(f in markers for f in marker_features(w)) for w in place), np.int8, len(place))
                sizes = np.fromiter(map(len, lists), np.int32, len(lists))
                tokens = np.fromiter(map(place.__getitem__, chain.from_iterable(lists)), np.int32, sizes.sum())
                toxic = np.fromiter((bool(m) for m in marks[i:end]), np.int8, len(lists))
                row = [sizes, tokens, hit[tokens] * np.repeat(toxic, sizes), buckets(list(place)).ravel().astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, k)) for x, k in zip(row, KINDS.values())], list(KINDS))

    return sample.select("text", "label").mapInArrow(cut, "sizes array<int>, tokens array<int>, labels array<tinyint>, features array<int>")


class Field:
    """A two-label linear chain: token weights by bucket for label 1 against 0, label 1's start, transitions."""

    def __init__(self, weights: np.ndarray, bias: float, start: float, move: np.ndarray):
        self.weights, self.bias, self.start, self.move = weights, bias, start, move
        self.whole = np.array([-1.0, 1.0, 0.0, 0.0])

    def odds(self, features: np.ndarray) -> np.ndarray:
        """Log odds of label 1 against 0 from tokens alone, given the buckets of each."""
        return np.clip(self.weights[features].sum(1, dtype=float) + self.bias, -30, 30)


def slopes(field: Field, sizes: np.ndarray, tokens: np.ndarray, labels: np.ndarray, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slopes of the negative log-likelihood of some texts: of the weights; of bias, start and transitions."""
    f, g, e = forward_backward(field.odds(features)[tokens], sizes, field.start, field.move)
    p = f * g
    off = p[:, 1] / p.sum(1) - labels
    each = np.bincount(tokens, off, len(features))
    weights = np.bincount(features.ravel(), np.repeat(each, features.shape[1]), BUCKETS)
    ends = np.cumsum(sizes)
    inner = np.ones(len(tokens), bool)
    inner[ends[sizes > 0] - 1] = False
    t = np.flatnonzero(inner)
    pairs = f[t][:, :, None] * np.exp(field.move - field.move.max()) * (e[t + 1] * g[t + 1])[:, None, :]
    pairs = (pairs / pairs.sum((1, 2), keepdims=True)).sum(0)
    seen = np.bincount(2 * labels[t] + labels[t + 1], minlength=4).reshape(2, 2)
    first = (ends - sizes)[sizes > 0]
    return weights, np.concatenate([[off.sum(), off[first].sum()], (pairs - seen).ravel()])


def fit(rows: DataFrame, rounds: int = ROUNDS, rate: float = 0.5, l2: float = 0.02, parts: int = PARTS) -> Field:
    """Maximum likelihood with a small ridge, by Adagrad over ``sequences``; a pass a round, slopes added up in tasks."""
    field = Field(np.zeros(BUCKETS, np.float32), -2.0, 0.0, np.zeros((2, 2)))
    sq_w, sq = np.full(BUCKETS, 1e-6), np.full(6, 1e-6)
    rows = rows.coalesce(parts)
    for _ in range(rounds):

        def add(batches, field=field):
            weights, rest = np.zeros(BUCKETS), np.zeros(6)
            for b in batches:
                for i in range(b.num_rows):
                    sizes, tokens, labels, features = (b.column(c)[i].values.to_numpy(zero_copy_only=False).astype(np.int64) for c in KINDS)
                    if len(tokens):
                        w, r = slopes(field, sizes, tokens, labels, features.reshape(-1, len(PREFIXES) + 2))
                        weights += w
                        rest += r
            yield pa.RecordBatch.from_arrays([pa.array([weights.astype(np.float32).tobytes()], pa.binary()), pa.array([rest.tolist()], pa.list_(pa.float64()))], ["w", "r"])

        found = rows.mapInArrow(add, "w binary, r array<double>").toArrow()
        grad = sum((np.frombuffer(w, np.float32) for w in found.column("w").to_pylist()), np.zeros(BUCKETS)) + l2 * field.weights
        rest = np.sum([np.zeros(6), *found.column("r").to_pylist()], 0)
        rest[1:] += l2 * np.concatenate([[field.start], field.move.ravel()])
        sq_w += grad**2
        sq += rest**2
        step = rate * rest / np.sqrt(sq)
        weights = (field.weights - rate * grad / np.sqrt(sq_w)).astype(np.float32)
        field = Field(weights, float(field.bias - step[0]), float(field.start - step[1]), field.move - step[2:].reshape(2, 2))
    return field


def marginals(d: np.ndarray, sizes: np.ndarray, start: float, move: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Label 1's marginal of each token of consecutive texts."""
    f, g, _ = forward_backward(d, sizes, start, move, block)
    p = f * g
    return p[:, 1] / p.sum(1)


def forward_backward(d: np.ndarray, sizes: np.ndarray, start: float, move: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward vectors, each up to a factor, and label weights of each token of consecutive texts.

    Exact, in work linear in the tokens.

    Texts are cut into blocks. Transfer matrices of all blocks are built side
    by side; entry vectors run over a text's blocks; then all blocks are swept
    side by side again. So a very long text costs no long Python loop.
    """
    total = int(sizes.sum())
    if not total:
        return np.zeros((0, 2)), np.zeros((0, 2)), np.zeros((0, 2))
    blocks = -(-sizes // block)
    nb = int(blocks.sum())
    first = np.cumsum(blocks) - blocks
    text = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    row, col = first[text] + at // block, at % block
    odds = np.full((nb, block), np.nan)
    odds[row, col] = d
    real = ~np.isnan(odds)
    hot = 1 / (1 + np.exp(-np.where(real, odds, 0.0)))
    e = np.stack([1 - hot, hot], -1)
    a = np.exp(move - move.max())
    begin = np.array([1.0, np.exp(start)])
    is_first = np.zeros(nb, bool)
    is_first[first[sizes > 0]] = True

    def step(v, i):  # v: (..., 2) row vectors before token i of each block
        moved = v @ a
        if i == 0:
            moved = np.where(is_first.reshape(-1, *[1] * (v.ndim - 1)), v, moved)
        ei, keep = e[:, i], real[:, i]
        if v.ndim == 3:
            ei, keep = ei[:, None], keep[:, None]
        return np.where(keep[..., None], moved * ei, v)

    def norm(v):
        return v / v.sum(tuple(range(1, v.ndim)), keepdims=True)

    whole = np.tile(np.eye(2), (nb, 1, 1))
    for i in range(block):
        whole = norm(step(whole, i))
    enter, leave = np.zeros((nb, 2)), np.ones((nb, 2))
    enter[first[sizes > 0]] = begin / begin.sum()
    most = int(blocks.max())
    for k in range(1, most):
        r = first[blocks > k] + k
        v = np.einsum("ni,nij->nj", enter[r - 1], whole[r - 1])
        enter[r] = v / v.sum(1, keepdims=True)
    for k in range(most - 1, 0, -1):
        r = first[blocks > k] + k
        v = np.einsum("nij,nj->ni", whole[r], leave[r])
        leave[r - 1] = v / v.sum(1, keepdims=True)
    f = np.zeros((nb, block, 2))
    now = enter
    for i in range(block):
        now = norm(step(now, i))
        f[:, i] = now
    g, back = np.zeros((nb, block, 2)), leave
    for i in range(block - 1, -1, -1):
        g[:, i] = back
        new = (back * e[:, i]) @ a.T
        if i == 0:
            break
        back = norm(np.where(real[:, i, None], new, back))
    return f[row, col], g[row, col], e[row, col]


def summary(p: np.ndarray) -> list[float]:
    """Of a text's marginals: a constant, the largest one's log odds, the log of their sum, the log of the text's length."""
    top = min(1 - 1e-9, max(1e-9, float(p.max()))) if len(p) else 1e-9
    return [1.0, float(np.log(top / (1 - top))), float(np.log(p.sum() + 1e-3)), float(np.log(len(p) + 1.0))]


def calibrate(x: np.ndarray, y: np.ndarray, rounds: int = 30, l2: float = 1.0) -> np.ndarray:
    """Logistic regression of labels on summaries, by Newton's method with a ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + l2 * np.eye(len(w)), x.T @ (q - y) + l2 * w)
    return w


def spans_of(text: str, p: np.ndarray, least: float = SPAN) -> list[dict]:
    """Runs of tokens with a marginal of ``least`` or more: offsets in characters, end exclusive, and the largest marginal."""
    out: list[dict] = []
    before = -2
    for i, m in enumerate(TOKEN.finditer(text)):
        if p[i] >= least:
            if before == i - 1:
                out[-1]["stop"], out[-1]["score"] = m.end(), max(out[-1]["score"], float(p[i]))
            else:
                out.append({"start": m.start(), "stop": m.end(), "score": float(p[i])})
            before = i
    return out


RESULT = "struct<score: double, spans: array<struct<start: int, stop: int, score: double>>, facts: array<double>>"
ARROW = pa.struct([("score", pa.float64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("score", pa.float64())]))), ("facts", pa.list_(pa.float64()))])


def tagger(field: Field | None, cache: int = CACHE, at_once: int = AT_ONCE):
    """What turns a list of texts into (score, spans) structs."""

    def work():
        known: dict[str, float] = {}
        letters = 0

        def each(texts: list) -> pa.Array:
            nonlocal letters
            out = []
            if field is None:
                return pa.array([{"score": 0.0, "spans": [], "facts": []} for _ in texts], ARROW)
            for i, end in portions(texts, at_once, AT_ONCE_LETTERS):
                part = texts[i:end]
                lists = [(t or "").split() for t in part]
                if len(known) > cache or letters > CACHE_LETTERS:
                    known.clear()
                    letters = 0
                every = list(chain.from_iterable(lists))
                d = list(map(known.get, every))
                if None in d:
                    new = list({t for t, x in zip(every, d) if x is None})
                    letters += sum(map(len, new))
                    known.update(zip(new, field.odds(buckets([normal(t) for t in new])).tolist()))
                    d = list(map(known.get, every))
                sizes = np.fromiter(map(len, lists), np.int64, len(lists))
                p = marginals(np.array(d, float), sizes, field.start, field.move)
                ends = np.cumsum(sizes)
                for text, size, end in zip(part, sizes.tolist(), ends.tolist()):
                    own = p[end - size : end]
                    facts = summary(own)
                    score = float(1 / (1 + np.exp(-np.clip(np.dot(facts, field.whole), -30, 30)))) if size else 0.0
                    hit = size and own.max() >= SPAN
                    out.append({"score": score, "spans": spans_of(text, own) if hit else [], "facts": facts})
            return pa.array(out, ARROW)

        return each

    return work


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> Field | None:
    """The field, or None where no toxic label can be learnt from."""
    sample = materialize(labelled_sample(docs, labels, "toxic", most), "sample")
    markers = find_markers(sample)
    if not markers:
        return None
    ids = sample.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIELD_DOCS)
    rows = materialize(sequences(sample.join(F.broadcast(ids), "doc_id", "left_semi"), markers), "sequences")
    field = fit(rows)
    facts = tag(sample, field).select("__toxic.facts", "label").toArrow()
    field.whole = calibrate(np.array(facts.column("facts").to_pylist()), np.array(facts.column("label").to_pylist(), float) > 0)
    release(sample, rows)
    return field


def tag(docs: DataFrame, field: Field | None, name: str = "__toxic") -> DataFrame:
    """``docs`` with a struct ``name`` (score, spans)."""
    return docs.withColumn(name, text_udf(tagger(field), RESULT)(F.col("text")))


def score_documents(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 from 0.5 on), spans."""
    found = tag(docs.select("doc_id", "text"), train(docs, labels, most))
    return found.select(
        "doc_id", held_out("doc_id").alias("held_out"), F.col("__toxic.score").alias("score"), (F.col("__toxic.score") >= 0.5).cast("int").alias("predicted"), F.col("__toxic.spans").alias("spans")
    )
