"""Token counts of a unigram tokenizer, without building its tokens.

The tokenizer: pieces and scores of a public vocabulary, spaces as ``\\u2581``
before each word, bytes for letters that are no piece, best total score wins.
An Aho-Corasick automaton lists all pieces in a word; one pass over its
positions carries the best score and that path's number of tokens.

Ties are broken as the tokenizer does: of paths to a position with equal
scores the one whose last piece starts first. Scores are doubles added from
left to right. A letter that is no piece costs the smallest score less 10 and
counts as many tokens as it has bytes.

Defined results: null and empty texts have no tokens; repeated rows get equal
counts; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import TOKENIZERS, portions, text_udf

VOCABULARY = f"{TOKENIZERS}/piece_bpe_32k.model"
#: What an unknown letter scores below the worst piece.
PENALTY = 10.0
#: Words, and their letters, whose counts a task keeps; beyond, it starts anew.
CACHE, CACHE_LETTERS = 400_000, 16_000_000
AT_ONCE = 512
#: Their letters, at most, unless one text alone has more.
AT_ONCE_LETTERS = 4_000_000
SPACE = "▁"
NEVER = float("-inf")
#: A letter in no piece, between words that are matched together; words from this length on are counted alone.
STOP, LONG = "\x00", 120


def load(path: str = VOCABULARY) -> dict[str, float]:
    """Pieces and scores of a vocabulary file, its control and byte pieces left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return {model.id_to_piece(i): float(model.get_score(i)) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}


def words_of(text: str) -> list[str]:
    """The words that the tokenizer cuts by itself, without their mark."""
    found = text.replace(SPACE, " ").split(" ")
    return found[1:] if not found[0] and len(found) > 1 else found if text else []


class Counter:
    """Counts the tokens of words."""

    def __init__(self, scores: dict[str, float]):
        self.automaton, self.plain = ahocorasick.Automaton(), ahocorasick.Automaton()
        for i, (piece, score) in enumerate(scores.items()):
            self.automaton.add_word(piece, (len(piece), score))
            self.plain.add_word(piece, i)
        self.automaton.make_automaton()
        self.plain.make_automaton()
        self.lengths = np.fromiter(map(len, scores), np.int64, len(scores))
        self.scores = np.fromiter(scores.values(), float, len(scores))
        self.unknown = min(scores.values(), default=0.0) - PENALTY

    def count(self, word: str) -> int:
        """Tokens of a word, given without the mark before it."""
        word = SPACE + word
        n = len(word)
        best, tokens = [NEVER] * (n + 1), [0] * (n + 1)
        best[0] = 0.0

        def unknown(upto: int) -> None:
            s = best[upto - 1] + self.unknown
            if s > best[upto]:
                best[upto], tokens[upto] = s, tokens[upto - 1] + len(word[upto - 1].encode("utf-8", "surrogatepass"))

        at, single = 0, True  # the position now reached; whether its letter is a piece
        for last, (length, score) in self.automaton.iter(word):  # longest first at each end
            if last >= at:
                if not single:
                    unknown(at)
                for e in range(at + 1, last + 1):
                    unknown(e)
                at, single = last + 1, False
            s = best[at - length] + score
            if s > best[at]:
                best[at], tokens[at] = s, tokens[at - length] + 1
            if length == 1:
                single = True
        if not single:
            unknown(at)
        for e in range(at + 1, n + 1):
            unknown(e)
        return tokens[n]


    def count_all(self, words: list[str]) -> list[int]:
        """Tokens of many words: one matching run over all, then their positions side by side; long words one by one."""
        out = [0 if len(w) < LONG else self.count(w) for w in words]
        at = [i for i, w in enumerate(words) if len(w) < LONG]
        if at:
            for i, n in zip(at, self._sweep([words[i] for i in at])):
                out[i] = n
        return out

    def _sweep(self, words: list[str]) -> list[int]:
        line = SPACE + (STOP + SPACE).join(words) + STOP
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        begin = np.cumsum(sizes + 1) - sizes - 1
        letters = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)
        weight = 1 + (letters >= 0x80) + (letters >= 0x800) + (letters >= 0x10000)
        got = np.fromiter(chain.from_iterable(self.plain.iter(line)), np.int64).reshape(-1, 2)
        end, length, score = got[:, 0] + 1, self.lengths[got[:, 1]], self.scores[got[:, 1]]
        single = np.zeros(len(line) + 1, bool)
        single[end[length == 1]] = True
        depth = end - np.repeat(begin, sizes + 1)[end - 1]
        order = np.argsort(depth.astype(np.uint8), kind="stable")  # longest first at each end, as found
        depth, end, score = depth[order], end[order], score[order]
        start = end - length[order]
        cuts = np.searchsorted(depth, np.arange(1, sizes.max() + 2))
        best, tokens = np.full(len(line) + 1, NEVER), np.zeros(len(line) + 1, np.int64)
        best[begin] = 0.0
        for d, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]), 1):
            if a < b:
                value, to = best[start[a:b]] + score[a:b], end[a:b]
                first = np.flatnonzero(np.diff(to, prepend=-1))
                top = np.maximum.reduceat(value, first)
                hit = np.flatnonzero(value == np.repeat(top, np.diff(np.append(first, b - a))))
                hit = hit[np.flatnonzero(np.diff(to[hit], prepend=-1))]  # of equals the one that starts first
                best[to[hit]], tokens[to[hit]] = value[hit], tokens[start[a:b][hit]] + 1
            here = begin[sizes >= d] + d
            here = here[~single[here]]
            value = best[here - 1] + self.unknown
            here, value = here[value > best[here]], value[value > best[here]]
            best[here], tokens[here] = value, tokens[here - 1] + weight[here - 1]
        return tokens[begin + sizes].tolist()


def counter(scores: dict[str, float], cache: int = CACHE, at_once: int = AT_ONCE):
    """What turns a list of texts into their numbers of tokens."""

    def work():
        count = Counter(scores).count_all
        known: dict[str, int] = {}
        letters = 0

        def each(texts: list) -> pa.Array:
            nonlocal letters
            out: list[int] = []
            for i, end in portions(texts, at_once, AT_ONCE_LETTERS):
                lists = [words_of(t or "") for t in texts[i:end]]
                if len(known) > cache or letters > CACHE_LETTERS:
                    known.clear()
                    letters = 0
                every = list(chain.from_iterable(lists))
                n = list(map(known.get, every))
                if None in n:
                    new = list({w for w, x in zip(every, n) if x is None})
                    letters += sum(map(len, new))
                    for j in range(0, len(new), 8192):
                        known.update(zip(new[j : j + 8192], count(new[j : j + 8192])))
                    n = list(map(known.get, every))
                ends = np.cumsum([0, *n])[np.cumsum([0, *map(len, lists)])]
                out += np.diff(ends).tolist()
            return pa.array(out, pa.int64())

        return each

    return work


def length(path: str = VOCABULARY) -> Column:
    """The tokens of the column ``text``."""
    return text_udf(counter(load(path)), "bigint")(F.col("text"))


def count_tokens(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """One row per document: doc_id, n_tokens."""
    return docs.select("doc_id", length(path).alias("n_tokens"))
