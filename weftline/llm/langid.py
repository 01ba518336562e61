"""Language identification by segmentation-marginalised unigrams.

A word's probability in a language is the sum, over all ways to cut it into
pieces of a fixed public vocabulary, of the product of that language's piece
probabilities; a forward pass over the word computes it. A text's
log-likelihood is the sum over its words.

Defined results: a null text or one without letters is ``und`` with score 0;
with no labelled rows every text is; ties go to the first language in
alphabetical order; repeated rows get equal results; an empty table gives an
empty one; other columns are ignored; of documents that share an id, the text
with the smallest hash is learnt from. Words are runs of letters, lower-cased,
of any length: runs beyond ``SHORT`` letters, as in scripts without spaces, go
through the same sums in logarithms, position by position.
"""

from __future__ import annotations

from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import TOKENIZERS, fold, held_out, portions, text_udf

#: Documents to learn from, at most; those with the smallest id hashes.
TRAIN_DOCS = 1000
#: Letters up to which a word's sums stay within doubles: each letter counts 1e-9 at least.
SHORT = 28
#: Rounds of expectation maximisation.
ROUNDS = 2
#: Probability of a letter that is no piece.
UNKNOWN = 1e-9
#: Words, and their letters, whose scores a task keeps; beyond, it starts anew.
CACHE, CACHE_LETTERS = 300_000, 16_000_000
#: Documents whose words are looked up together.
AT_ONCE = 512
#: Their letters, at most, unless one text alone has more.
AT_ONCE_LETTERS = 4_000_000

#: Marks that end a token; a token with others is taken apart when it is first met.
MARKS = ".,;:!?\"()"
LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def vocabulary(path: str = f"{TOKENIZERS}/piece_bpe_32k.model") -> list[str]:
    """The ordinary pieces of a tokenizer's vocabulary that are made of letters, word starts marked by ``\\u2581``."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i)))
    return sorted({p for p in pieces if p.lstrip("▁").isalpha() and p.rfind("▁") <= 0})


def tokens_of(text: str | None) -> list[str]:
    """The lower-cased text cut at white space and common marks."""
    text = (text or "").lower()
    for mark in MARKS:
        text = text.replace(mark, " ")
    return text.split()


def words_in(token: str) -> list[str]:
    """A token's runs of letters."""
    return [token] if token.isalpha() else LETTERS.findall(token)


def words_of(text: str | None) -> list[str]:
    """All words of a text."""
    return [w for t in tokens_of(text) for w in words_in(t)]


class Lattice:
    """All matches of the vocabulary in a list of words, laid out for passes over word positions."""

    def __init__(self, automaton, lengths: np.ndarray, words: list[str]):
        line = "▁" + "\n▁".join(words) + "\n"
        self.sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        self.begin = np.cumsum(self.sizes + 1) - self.sizes - 1
        self.finish = self.begin + self.sizes
        self.size = len(line) + 1
        got = np.fromiter(chain.from_iterable(automaton.iter(line)), np.int64).reshape(-1, 2)
        self.end, self.piece = got[:, 0] + 1, got[:, 1]
        self.start = self.end - lengths[self.piece]
        self.word = np.repeat(np.arange(len(words)), self.sizes + 1)[self.end - 1]

    def forward(self, p: np.ndarray) -> np.ndarray:
        """Sum over segmentations of what lies before each position, by language."""
        return self._sweep(p, self.begin, 1, self.end - self.begin[self.word], self.end, self.start)

    def backward(self, p: np.ndarray) -> np.ndarray:
        """Sum over segmentations of what lies after each position, by language."""
        return self._sweep(p, self.finish, -1, self.finish[self.word] - self.start, self.start, self.end)

    def _sweep(self, p, origin, step, level, to, from_) -> np.ndarray:
        held = np.zeros((self.size, p.shape[1]))
        held[origin] = 1
        order = np.argsort(level.astype(np.uint8), kind="stable") if step > 0 else np.lexsort((to, level))
        level, to, from_, piece = level[order], to[order], from_[order], self.piece[order]
        cuts = np.searchsorted(level, np.arange(1, self.sizes.max() + 2))
        for depth, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]), 1):
            here = origin[self.sizes >= depth] + step * depth
            held[here] = held[here - step] * p[-1]
            if a < b:
                first = np.flatnonzero(np.diff(to[a:b], prepend=-1))
                held[to[a:b][first]] += np.add.reduceat(held[from_[a:b]] * p[piece[a:b]], first, axis=0)
        return held


class LongWord:
    """The same sums for one word of any length, as logarithms by position and language."""

    def __init__(self, automaton, lengths: np.ndarray, word: str):
        word = "▁" + word
        self.n = len(word)
        got = np.fromiter(chain.from_iterable(automaton.iter(word)), np.int64).reshape(-1, 2)
        self.end, self.piece = got[:, 0] + 1, got[:, 1]
        self.start = self.end - lengths[self.piece]

    def forward(self, p: np.ndarray) -> np.ndarray:
        """Log sum over segmentations of what lies before each position."""
        return self._sweep(p, self.end, self.start, range(1, self.n + 1), -1)

    def backward(self, p: np.ndarray) -> np.ndarray:
        """Log sum over segmentations of what lies after each position."""
        return self._sweep(p, self.start, self.end, range(self.n - 1, -1, -1), 1)

    def _sweep(self, p, to, from_, places, before) -> np.ndarray:
        held = np.zeros((self.n + 1, p.shape[1]))
        order = np.argsort(to, kind="stable")
        from_, piece = from_[order], self.piece[order]
        cuts = np.searchsorted(to[order], np.arange(self.n + 2)).tolist()
        for i in places:
            near = held[i + before]
            a, b = cuts[i], cuts[i + 1]
            ways = p[-1] if a == b else p[-1] + (np.exp(held[from_[a:b]] - near) * p[piece[a:b]]).sum(0)
            held[i] = near + np.log(ways)
        return held


def word_logs(automaton, lengths: np.ndarray, words: list[str], p: np.ndarray) -> np.ndarray:
    """Log probabilities of words by language."""
    out = np.empty((len(words), p.shape[1]))
    short = [i for i, w in enumerate(words) if len(w) <= SHORT]
    if short:
        lattice = Lattice(automaton, lengths, [words[i] for i in short])
        out[short] = np.log(lattice.forward(p)[lattice.finish])
    for i, w in enumerate(words):
        if len(w) > SHORT:
            out[i] = LongWord(automaton, lengths, w).forward(p)[-1]
    return out


def build_automaton(pieces: list[str]):
    found = ahocorasick.Automaton()
    for i, p in enumerate(pieces):
        found.add_word(p, i)
    found.make_automaton()
    return found, np.fromiter(map(len, pieces), np.int64, len(pieces))


def fit(counts: dict[str, dict[str, int]], pieces: list[str], rounds: int = ROUNDS, at_once: int = 20_000) -> tuple[list[str], np.ndarray]:
    """Piece probabilities by language, from word counts by language; the last row is of unknown letters."""
    langs = sorted(counts)
    automaton, lengths = build_automaton(pieces)
    words = sorted({w for c in counts.values() for w in c})
    long, words = [w for w in words if len(w) > SHORT], [w for w in words if len(w) <= SHORT]
    weigh = lambda ws: np.array([[counts[k].get(w, 0) for k in langs] for w in ws], float)
    weight, long_weight = weigh(words), weigh(long)
    long = [LongWord(automaton, lengths, w) for w in long]
    p = np.full((len(pieces) + 1, len(langs)), UNKNOWN)
    p[:-1] = 10.0 ** -(5.0 - 0.35 * lengths.clip(max=6))[:, None]
    for _ in range(rounds):
        expected = np.full(p.shape, 0.05)
        for i in range(0, len(words), at_once):
            part = Lattice(automaton, lengths, words[i : i + at_once])
            alpha, beta = part.forward(p), part.backward(p)
            whole = alpha[part.finish]
            share = alpha[part.start] * p[part.piece] * beta[part.end] / whole[part.word] * weight[i : i + at_once][part.word]
            for k in range(len(langs)):
                expected[:, k] += np.bincount(part.piece, share[:, k], len(p))
        for w, n in zip(long, long_weight):
            alpha, beta = w.forward(p), w.backward(p)
            np.add.at(expected, w.piece, np.exp(alpha[w.start] + np.log(p[w.piece]) + beta[w.end] - alpha[-1]) * n)
        p = expected / expected[:-1].sum(0)
        p[-1] = UNKNOWN
    return langs, p


def training_counts(docs: DataFrame, most: int = TRAIN_DOCS) -> dict[str, dict[str, int]]:
    """Word counts by language over at most ``most`` documents outside the held-out fold."""
    ids = (
        docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("doc_id") != 0))
        .select(F.col("doc_id").alias("i"))
        .distinct()
        .orderBy(F.xxhash64("i"), "i")
        .limit(most)
    )
    found = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull()).join(F.broadcast(ids), docs["doc_id"] == ids["i"], "left_semi")
    one = F.min(F.struct(F.xxhash64("text").alias("h"), "lang", "text")).alias("one")
    found = found.where(F.col("text").isNotNull()).groupBy("doc_id").agg(one).select("one.text", "one.lang")

    def count(batches):
        for b in batches:
            sums: dict[tuple[str, str], int] = {}
            for t, k in zip(b.column("text").to_pylist(), b.column("lang").to_pylist()):
                for w in words_of(t):
                    sums[k, w] = sums.get((k, w), 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in sums], pa.string()), pa.array([w for _, w in sums], pa.string()), pa.array(list(sums.values()), pa.int64())], ["lang", "word", "n"])

    rows = found.mapInArrow(count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow()
    counts: dict[str, dict[str, int]] = {}
    for k, w, n in zip(*(rows.column(c).to_pylist() for c in ("lang", "word", "n"))):
        counts.setdefault(k, {})[w] = n
    return counts


def scorer(langs: list[str], p: np.ndarray, pieces: list[str], at_once: int = AT_ONCE, cache: int = CACHE):
    """What turns a list of texts into (lang, score) structs."""
    def work():
        automaton, lengths = build_automaton(pieces)
        known: dict[str, int] = {}
        letters = 0
        table = np.zeros((1024, len(langs) + 1))

        def learn(tokens: list[str]) -> None:
            nonlocal table
            for i in range(0, len(tokens), 8192):
                part = tokens[i : i + 8192]
                lists = list(map(words_in, part))
                words = list({w for x in lists for w in x})
                while len(known) + len(part) > len(table):
                    table = np.concatenate([table, np.zeros_like(table)])
                rows = table[len(known) : len(known) + len(part)]
                rows[:] = 0
                if words:
                    logs = word_logs(automaton, lengths, words, p)
                    place = dict(zip(words, range(len(words))))
                    owner = np.repeat(np.arange(len(part)), list(map(len, lists)))
                    np.add.at(rows[:, :-1], owner, logs[[place[w] for x in lists for w in x]])
                rows[:, -1] = list(map(len, lists))  # 0 for a token without letters
                known.update(zip(part, range(len(known), len(known) + len(part))))

        def each(texts: list) -> pa.Array:
            nonlocal letters
            lang, score = [], []
            for i, end in portions(texts, at_once, AT_ONCE_LETTERS):
                lists = [tokens_of(t) for t in texts[i:end]]
                if len(known) > cache or letters > CACHE_LETTERS:
                    known.clear()
                    letters = 0
                every = list(chain.from_iterable(lists))
                at = list(map(known.get, every))
                if None in at:
                    new = list({w for w, a in zip(every, at) if a is None})
                    letters += sum(map(len, new))
                    learn(new)
                    at = list(map(known.get, every))
                ends = np.cumsum([0, *map(len, lists)])
                totals = np.zeros((len(lists), table.shape[1]))
                some = np.diff(ends) > 0
                if some.any():
                    totals[some] = np.add.reduceat(table[np.array(at, np.int64)], ends[:-1][some], axis=0)
                for total in totals:
                    if not langs or not total[-1]:
                        lang.append("und")
                        score.append(0.0)
                        continue
                    best = int(total[:-1].argmax())
                    lang.append(langs[best])
                    score.append(float(1 / np.exp(total[:-1] - total[best]).sum()))
            return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["lang", "score"])

        return each

    return work


def predict(docs: DataFrame, train: DataFrame | None = None, path: str = f"{TOKENIZERS}/piece_bpe_32k.model", most: int = TRAIN_DOCS, name: str = "__lang") -> DataFrame:
    """``docs`` with a struct ``name`` (lang, score), learnt from ``train`` (by default from ``docs``)."""
    pieces = vocabulary(path)
    langs, p = fit(training_counts(docs if train is None else train, most), pieces)
    return docs.withColumn(name, text_udf(scorer(langs, p, pieces), "struct<lang: string, score: double>")(F.col("text")))


def identify(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    found = predict(docs.select("doc_id", "text", "lang"), **options)
    return found.select("doc_id", held_out("doc_id").alias("held_out"), F.col("__lang.lang").alias("lang_pred"), F.col("__lang.score").alias("score"))
