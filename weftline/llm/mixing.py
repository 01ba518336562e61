"""Mixing to target weights with soft domain membership.

A softmax regression, learnt from the labelled table, gives each document a
posterior over domains: ``junk`` (quality 0), ``toxic`` (quality 1, toxic 1)
and ``prose`` (neither). Document rates from 0 to ``MOST_RATE`` are then fitted
so that the expected tokens of the domains, sum of r * tokens * posterior,
match the targets: least squares on the domains' shares, with a slight pull of
all tokens towards rate 1 that makes the fit unique, by lazy projected gradient:
the slopes gather in one number a domain, u, and the rate of a document with
posterior p is 1 - p . u projected into its bounds. Every pass tries several
lengths of a step at once, along the slope and along the slope scaled by the
second moments of the rates not at a bound, and takes the one that raises the
lower bound on the least squares most. It ends where that bound is met, so that
no rates come closer.

So each pass is one distributed sum of a bounded number of numbers, and no
rates are kept or collected.

Domains without a target are left out of the posterior.

Defined results: null and empty texts have no tokens, change no total and keep
rate 1; with no labels all posteriors are equal; targets that no rates meet end
at the closest totals, never farther than all rates 1 are; a fit that doesn't
settle raises; repeated rows get equal rates; an empty table gives an empty
one; other columns stay as they are. Copies are the rate rounded down or up by
a hash of the id and the text, so that their expectation is the rate.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import columns_of, fold, one_text_each, text_udf, unused
from weftline.llm.style import NAMES, measure
from weftline.session import materialize

DOMAINS = ("prose", "junk", "toxic")
#: Shares of the expected tokens.
TARGETS = {"prose": 0.90, "junk": 0.07, "toxic": 0.03}
#: Labelled documents to learn from, at most; those with the smallest id hashes.
TRAIN_DOCS = 12_000
#: Buckets of hashed words that the classifier sees beside the measures of form; words with the same
#: first five letters are one feature, which stands for a stem.
BUCKETS = 1 << 14
#: A document is taken so often at most; targets that need more are out of reach.
MOST_RATE = 16.0
#: Weight of the tokens' squared distance from rate 1 against that of the shares from the targets.
PULL = 1e-6
#: Passes; a fit that still moves after them raises.
STEPS = 100
#: Share of the loss that its lower bound may lack at the end.
TINY = 1e-6
#: Lengths of a step that a pass tries.
LENGTHS = (1.0, 0.5, 0.25, 0.1, 0.03, 1e-2, 1e-3, 1e-4, 1e-5)
#: Words, and their letters, whose bucket a task keeps.
CACHE, CACHE_LETTERS = 300_000, 16_000_000

_SHAPE = "struct<n: bigint, p: array<double>>"


def bucket(word: str) -> int:
    """The bucket of a word's first five letters, marks around it and case aside."""
    import zlib

    return zlib.crc32(word.strip(".,;:!?\"'()").lower()[:5].encode("utf-8", "surrogatepass")) % BUCKETS


class Buckets(dict):
    """The buckets of words met so far, within CACHE and CACHE_LETTERS."""

    letters = 0

    def __missing__(self, word: str) -> int:
        if len(self) > CACHE or self.letters > CACHE_LETTERS:
            self.clear()
            self.letters = 0
        self.letters += len(word)
        self[word] = found = bucket(word)
        return found


def examine(text: str | None, known: Buckets) -> tuple[int, np.ndarray, np.ndarray]:
    """A text's words, measures and distinct buckets."""
    words = (text or "").split()
    distinct = set(words)
    return len(words), measure(text), np.unique(np.fromiter((known[w] for w in distinct), np.int64, len(distinct)))


class Classifier:
    """Softmax over standardised measures and bucket weights."""

    def __init__(self, centre, spread, dense, sparse):
        self.centre, self.spread, self.dense, self.sparse = centre, spread, dense, sparse

    def posterior(self, form: np.ndarray, buckets: np.ndarray) -> np.ndarray:
        z = self.dense[0] + np.clip((form - self.centre) / self.spread, -6, 6) @ self.dense[1:] + self.sparse[buckets].sum(0)
        q = np.exp(z - z.max())
        return q / q.sum()


def fit_classifier(forms: np.ndarray, buckets: list[np.ndarray], y: np.ndarray, classes: int, rounds: int = 60, rate: float = 0.2, l2: float = 1.0) -> Classifier:
    """Maximum likelihood with a ridge, by Adagrad over all rows at once."""
    d = forms.shape[1]
    centre = forms.mean(0) if len(y) else np.zeros(d)
    spread = (forms.std(0) if len(y) else np.zeros(d)) + 1e-6
    dense, sparse = np.zeros((d + 1, classes)), np.zeros((BUCKETS, classes))
    if len(y):
        x = np.concatenate([np.ones((len(y), 1)), np.clip((forms - centre) / spread, -6, 6)], 1)
        sizes = np.array([len(b) for b in buckets])
        flat, owner = np.concatenate(buckets).astype(np.int64), np.repeat(np.arange(len(y)), sizes)
        goal = np.eye(classes)[y]
        sq_d, sq_s = np.full(dense.shape, 1e-3), np.full(sparse.shape, 1e-3)
        for _ in range(rounds):
            z = x @ dense
            for k in range(classes):
                z[:, k] += np.bincount(owner, sparse[flat, k], len(y))
            q = np.exp(z - z.max(1, keepdims=True))
            off = q / q.sum(1, keepdims=True) - goal
            grad = x.T @ off + l2 * dense
            sq_d += grad**2
            dense -= rate * grad / np.sqrt(sq_d)
            for k in range(classes):
                g = np.bincount(flat, off[owner, k], BUCKETS) + l2 * sparse[:, k]
                sq_s[:, k] += g**2
                sparse[:, k] -= rate * g / np.sqrt(sq_s[:, k])
    return Classifier(centre, spread, dense, sparse)


def domain_sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows (doc_id, text, y) outside the held-out fold, y the place of the domain in DOMAINS."""
    y = F.when(F.col("q") == 0, 1).when(F.col("t") > 0, 2).otherwise(0)
    ids = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull() & (fold("doc_id") != 0))
        .groupBy("doc_id")
        .agg(F.max("quality").alias("q"), F.max("toxic").alias("t"))
        .select("doc_id", y.alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    return one_text_each(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id"), "y")


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> Classifier:
    def run(batches):
        known = Buckets()
        for b in batches:
            seen = [examine(t, known) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("y"), pa.array([s[1].tolist() for s in seen], pa.list_(pa.float64())), pa.array([s[2].tolist() for s in seen], pa.list_(pa.int32()))], ["doc_id", "y", "form", "buckets"]
            )

    sample = domain_sample(docs, labels, most).select(F.col("doc_id").cast("string").alias("doc_id"), "text", "y")
    rows = sample.mapInArrow(run, "doc_id string, y int, form array<double>, buckets array<int>").toArrow().sort_by("doc_id")
    forms = np.array(rows.column("form").to_pylist(), float).reshape(-1, len(NAMES))
    return fit_classifier(forms, [np.array(b, np.int64) for b in rows.column("buckets").to_pylist()], rows.column("y").to_numpy().astype(int), len(DOMAINS))


def posteriors(model: Classifier, domains: tuple[str, ...] = DOMAINS) -> Column:
    """Of the column ``text`` a struct: n (words), p (posterior by domain, among those asked for)."""
    at = [DOMAINS.index(d) for d in domains]

    def work():
        known = Buckets()

        def each(texts: list) -> pa.Array:
            seen = [examine(t, known) for t in texts]
            p = np.array([model.posterior(form, b) for _, form, b in seen]).reshape(-1, len(DOMAINS))[:, at] + 1e-12
            p = (p / p.sum(1, keepdims=True)).tolist()
            return pa.StructArray.from_arrays([pa.array([s[0] for s in seen], pa.int64()), pa.array(p, pa.list_(pa.float64()))], ["n", "p"])

        return each

    return text_udf(work, _SHAPE)(F.col("text"))


def rate_of(p: np.ndarray, n: np.ndarray, u: np.ndarray, most: float = MOST_RATE) -> np.ndarray:
    """The rates of documents with posteriors ``p`` and lengths ``n``; 1 for those without length."""
    return np.where(n > 0, np.clip(1 - p @ u, 0.0, most), 1.0)


def rate_column(u: np.ndarray, p: Column, n: Column, most: float = MOST_RATE) -> Column:
    """The same by built-in functions."""
    dot = F.aggregate(F.zip_with(p, F.array(*[F.lit(float(x)) for x in u]), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(float(most)), 1 - dot))).otherwise(1.0)


@dataclass(frozen=True)
class State:
    """Sums over documents at ``u``, as shares of all tokens."""

    u: np.ndarray
    off: np.ndarray  # tokens by domain, less the targets
    pull: float  # squared distance of the tokens from rate 1
    free: np.ndarray  # second moments by pairs of domains, of rates not at a bound

    def loss(self) -> float:
        return float(self.off @ self.off + PULL * self.pull) / 2

    def bound(self) -> float:
        """What no rates' loss is below."""
        z = PULL * self.u
        return float(PULL * self.pull / 2 + z @ self.off - z @ z / 2)

    def slope(self) -> np.ndarray:
        return self.off - PULL * self.u


def _states(soft: DataFrame, trials: list[np.ndarray], goal: np.ndarray, most: float) -> tuple[float, list[State]]:
    """The number of tokens, and the state at each of ``trials``, in one pass over rows (n, p)."""
    k = len(goal)
    size = k + 1 + k * k

    def run(batches):
        out = np.zeros(1 + size * len(trials))
        for b in batches:
            n = np.asarray(b.column("n").to_numpy(zero_copy_only=False), float)
            p = np.array(b.column("p").flatten().to_numpy(zero_copy_only=False)).reshape(-1, k)
            out[0] += n.sum()
            for i, u in enumerate(trials):
                r = rate_of(p, n, u, most)
                free = n * ((r > 0) & (r < most))
                out[1 + i * size : 1 + (i + 1) * size] += np.concatenate([(r * n) @ p, [n @ (r - 1) ** 2], ((p * free[:, None]).T @ p).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out)), pa.int64()), pa.array(out)], ["i", "v"])

    out = np.zeros(1 + size * len(trials))
    for i, v in soft.mapInArrow(run, "i bigint, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[i] = v
    sums = out[1:].reshape(-1, size) / max(out[0], 1.0)
    return out[0], [State(u, x[:k] - goal, float(x[k]), x[k + 1 :].reshape(k, k)) for u, x in zip(trials, sums)]


def fit_rates(soft: DataFrame, targets: dict[str, float] = TARGETS, steps: int = STEPS, most: float = MOST_RATE) -> State:
    """The state at the fitted rates, over rows (n, p)."""
    goal = np.array([float(w) for w in targets.values()])
    goal = goal / goal.sum()
    tokens, (state,) = _states(soft, [np.zeros(len(goal))], goal, most)
    if tokens <= 0:
        return state
    first, unit = state, np.eye(len(goal))
    longest = float(np.linalg.eigvalsh(state.free)[-1]) + PULL
    for _ in range(steps):
        if state.loss() - max(state.bound(), 0.0) <= TINY * state.loss():
            return min(first, state, key=State.loss)
        scaled = np.linalg.solve(state.free + PULL * unit, state.slope())
        trials = [state.u + x * scaled for x in LENGTHS] + [state.u + x / longest * state.slope() for x in (1.0, 8.0, 64.0)]
        state = max(_states(soft, trials, goal, most)[1], key=State.bound)
    raise RuntimeError(f"rates still move after {steps} passes, {np.abs(state.off).max():.5f} from a target")


def _rated(docs: DataFrame, labels: DataFrame, train_docs: DataFrame, targets: dict[str, float], most: int, length: Column | None, keep: list[Column], name: str) -> DataFrame:
    """``keep`` of ``docs`` with a struct ``name``: n, p, draw, rate, copies; what is written between passes is no more than that."""
    draw = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text", F.lit(6)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    own = F.col(name)
    soft = docs.withColumn(name, posteriors(train(train_docs, labels, most), tuple(targets)))
    n = own["n"] if length is None else length
    rows = materialize(soft.select(*keep, F.struct(n.alias("n"), own["p"].alias("p"), draw.alias("draw")).alias(name)), "mix")
    fitted = fit_rates(rows.select(own["n"].alias("n"), own["p"].alias("p")), targets)
    rows = rows.withColumn(name, own.withField("rate", rate_column(fitted.u, own["p"], own["n"])))
    return rows.withColumn(name, own.withField("copies", F.floor(own["rate"] + own["draw"]).cast("int")))


def rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, most: int = TRAIN_DOCS, length: Column | None = None, name: str = "n_words") -> DataFrame:
    """One row per document: doc_id, its length as ``name``, domains (posterior by name), rate, copies.

    Lengths are words unless ``length`` gives them, as ``tokens.length`` does.
    """
    rows = _rated(docs.select("doc_id", "text"), labels, docs, targets, most, length, [F.col("doc_id")], "__mix")
    domains = F.map_from_arrays(F.array(*[F.lit(d) for d in targets]), "__mix.p")
    return rows.select("doc_id", F.col("__mix.n").alias(name), domains.alias("domains"), "__mix.rate", "__mix.copies")


def mix(docs: DataFrame, labels: DataFrame, train_docs: DataFrame, targets: dict[str, float] = TARGETS, most: int = TRAIN_DOCS, length: Column | None = None) -> DataFrame:
    """The rows of ``docs``, each as often as its copies say; lengths are words unless ``length`` gives them."""
    name, copy = unused("__mix", docs.columns), unused("__copy", docs.columns)
    rows = _rated(docs, labels, train_docs, targets, most, length, columns_of(docs), name)
    rows = rows.where(F.col(name)["copies"] > 0)
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(name)["copies"]))).select(*columns_of(docs))
