"""Runs: maximal periodic stretches of words, found in linear time over an ordered alphabet.

A run's period is the length of its Lyndon root, which is the longest Lyndon
word at some place in one of two orders of the alphabet. The longest Lyndon
word at a place ends where the next smaller suffix begins, so two Lyndon
arrays give all runs. Suffixes are compared symbol by symbol, never by hashes
or a suffix structure. What a comparison has matched is used again:

- places that wait for a smaller suffix know how far they agree with the one
  below them, so that a comparison goes on where the last one ended;
- inside a stretch that repeats an earlier one, the results of the earlier
  places are taken over, and symbols are compared from the stretch's end on.

So every symbol is matched once, however periodic a text is.

Defined results: a null, empty or wordless text has no runs, no words and an
empty collapsed text; repeated rows get equal results; runs that tie in length
are ordered by start, then period; an empty table gives an empty one; other
columns stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import columns_of, text_udf, unused
from weftline.llm.rules import SPACE, words_of

#: A run has at least so many words and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: How often what is left between rare symbols is cut again.
ROUNDS = 20

_SHAPE = "struct<runs: array<struct<start: bigint, length: bigint, period: bigint>>, kept: string>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def lyndon(a: list[int]) -> tuple[list[int], list[int]]:
    """For each place of ``a`` that of the next smaller suffix, and the length on which the two agree.

    The text ends in a sentinel below all symbols. Places wait on a chain, each
    below the ones after it, until a smaller suffix comes.
    """
    n = len(a)
    a = [*a, min(a, default=0) - 1]
    after, agree = [n] * n, [0] * n
    below, shared = [-1] * n, [0] * n  # the previous smaller suffix, and the length on which it agrees
    shift = end = first = 0  # a[i] == a[i - shift] for first <= i < end, the stretch that repeats an earlier one
    for i in range(1, n):
        j, same = i - 1, 0
        if i < end:  # take over what the place ``shift`` before found, as far as it lies in the stretch
            twin, room = i - shift, end - i
            settled = False
            while j >= first:
                k = j - shift
                known = agree[k] if after[k] == twin else shared[twin] if below[twin] == k else -1
                if known < 0:
                    break
                if known >= room:
                    same = room
                    break
                if after[k] == twin:
                    after[j], agree[j] = i, known
                    j = below[j]
                else:
                    below[i], shared[i] = j, known
                    settled = True
                    break
            if settled:
                continue
            if j < 0:
                continue
        while True:
            x, y = a[j + same], a[i + same]
            if x == y:
                same += 1
                while a[j + same] == a[i + same]:
                    same += 1
                x, y = a[j + same], a[i + same]
            if same and i + same >= end and (i + same > end or first < i):
                first, shift, end = i, i - j, i + same
            if x < y:
                below[i], shared[i] = j, same
                break
            after[j], agree[j] = i, same
            k = below[j]
            while k >= 0 and shared[j] > same:  # agrees with j for longer than j does with i: smaller or larger as j is
                after[k], agree[k] = i, same
                j, k = k, below[k]
            if k < 0:
                break
            if shared[j] < same:
                below[i], shared[i] = k, shared[j]
                break
            j = k
    return after, agree


def runs(a: list[int], periods: int = 2, least: int = 2) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of ``a`` with at least so many periods (two or more) and symbols, in order of start and period."""
    found = set()
    for symbols in (a, [-x for x in a]):
        after, agree = lyndon(symbols)
        place = np.arange(len(a))
        period = np.asarray(after, np.int64) - place
        right = np.asarray(agree, np.int64)
        # from a run's first root on, all but less than a period is left
        root = place[(right > 0) & (right + 2 * period > periods * period)]
        reach: dict[int, int] = {}  # by period, the end of the run found last
        for i in root.tolist():
            p = int(period[i])
            end = i + p + int(right[i])
            if reach.get(p) == end:
                continue  # a later root of that run
            start = i
            while start and a[start - 1] == a[start - 1 + p]:
                start -= 1
            reach[p] = end
            if end - start >= max(least, periods * p):
                found.add((start, end - start, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def stretches(a: np.ndarray, periods: int, least: int) -> list[tuple[int, int]]:
    """Places (first, end) between which all runs of so many periods lie.

    A symbol of such a run occurs ``periods`` times in it. So no run holds a
    symbol that occurs less often, and the text is cut there, and its parts
    again; after ``ROUNDS`` of this parts stay as they are, wider than need be.
    """
    out, todo = [], [(0, len(a), 0)]
    while todo:
        first, end, cuts = todo.pop()
        if end - first < least:
            continue
        part = a[first:end]
        _, place, often = np.unique(part, return_inverse=True, return_counts=True)
        rare = np.flatnonzero(often[place] < periods)
        if not len(rare) or cuts == ROUNDS:
            out.append((first, end))
            continue
        edges = np.concatenate([[-1], rare, [len(part)]])
        wide = np.flatnonzero(np.diff(edges) > least)
        todo += [(first + int(edges[k]) + 1, first + int(edges[k + 1]), cuts + 1) for k in wide]
    return sorted(out)


def text_runs(words: list[bytes], periods: int = LEAST_PERIODS, least: int = LEAST_WORDS) -> list[tuple[int, int, int]]:
    """The runs (start, length, period) of ``words``, numbered in order of first occurrence for an alphabet."""
    numbers: dict[bytes, int] = {}
    a = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    found = []
    for first, end in stretches(a, periods, least):
        found += [(first + s, length, p) for s, length, p in runs(a[first:end].tolist(), periods, least)]
    return found


def kept_words(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``n`` words no run holds after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change)[:n] == 0


def detect(text: Column, periods: int = LEAST_PERIODS, least: int = LEAST_WORDS) -> Column:
    """Of a text a struct: its runs (start, length, period in words) by start and period, and the text with each run collapsed to its first period."""

    def each(texts: list) -> pa.Array:
        all_runs, kept = [], []
        for t in texts:
            words = (t or "").encode("utf-8", "surrogatepass").split()
            found = text_runs(words, periods, least)
            if found:
                words = [words[i] for i in np.flatnonzero(kept_words(len(words), found)).tolist()]
            all_runs.append([{"start": s, "length": n, "period": p} for s, n, p in found])
            kept.append(b" ".join(words).decode("utf-8", "replace"))
        return pa.StructArray.from_arrays([pa.array(all_runs, pa.list_(_RUN)), pa.array(kept, pa.string())], ["runs", "kept"])

    return text_udf(lambda: each, _SHAPE)(text)


def collapse(docs: DataFrame, periods: int = LEAST_PERIODS, least: int = LEAST_WORDS, name: str = "periodic") -> DataFrame:
    """``docs`` with a struct ``name``: runs and kept, as ``detect`` gives them."""
    return docs.select(*columns_of(docs), detect(F.col("text"), periods, least).alias(name))


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every tenth document, by its id's crc32, repeats a stretch of its words to its end; a null id's doesn't."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    w, x = unused("__words", docs.columns), unused("__plan", docs.columns)
    chosen = F.coalesce(h % 10 == 0, F.lit(False))
    df = docs.withColumn(w, F.when(chosen, words_of(F.col("text").cast("string"))))
    g, n = F.floor(h / 10).cast("long"), F.size(w)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    df = df.withColumn(x, F.when(chosen & (n > 0), F.struct(n.alias("n"), a.alias("a"), p.alias("p"))))
    n, a, p = (F.col(x)[c] for c in "nap")
    again = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(F.col(w), F.when(i < a, i).otherwise(a + (i - a) % p)))
    return df.select("doc_id", F.when(F.col(x).isNotNull(), F.array_join(again, " ")).otherwise(F.col("text").cast("string")).alias("text"))


def digests(docs: DataFrame) -> DataFrame:
    """One row per document, of its words with planted repeats: doc_id, n_runs, the longest run, and hashes of all runs and of what is kept."""
    made = collapse(planted(docs.select("doc_id", "text")))
    found, kept = F.col("periodic.runs"), F.col("periodic.kept")
    order = F.transform(found, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")))
    lines = F.transform(found, lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    made = made.select("doc_id", F.size(found).cast("long").alias("n_runs"), F.array_max(order).alias("most"), F.concat(F.array_join(lines, "\n"), F.when(F.size(lines) > 0, "\n").otherwise("")).alias("lines"), kept.alias("kept"))
    most = F.col("most")
    return made.select(
        "doc_id", "n_runs", (-most["start"]).alias("start"), most["length"].alias("length"), (-most["period"]).alias("period"),
        F.floor(1000 * most["length"] / -most["period"]).cast("long").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"), F.sha2("kept", 256).alias("collapsed_sha256"),
    )


#: crc32 of the decimal id, bit by bit.
_CRC = (
    "xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), "
    "lambda a, c: list_reduce([xor(a, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), CAST(4294967295 AS BIGINT))"
)

#: Runs as stretches of equal words a period apart, of all periods; of equal stretches the smallest period.
ORACLE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACE}+'), lambda x: x <> '') AS o, CASE WHEN doc_id IS NOT NULL THEN {_CRC} END AS h FROM documents
), g AS (
  SELECT *, CAST(len(o) AS BIGINT) AS n, h // 10 AS g FROM d
), p AS (
  SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a, CASE WHEN h % 10 = 0 AND n > 0 THEN 1 + (n - g % n) // (3 + g % 8) END AS p FROM g
), w AS (
  SELECT r, doc_id, n, CASE WHEN a IS NULL THEN o ELSE list_transform(range(n), lambda i: CASE WHEN i < a THEN o[i + 1] ELSE o[a + (i - a) % p + 1] END) END AS ws FROM p
), t AS (
  SELECT r, n, unnest(range(n)) AS i, unnest(ws) AS k FROM w
), m AS (
  SELECT x.r, y.i - x.i AS q, x.i FROM t x JOIN t y ON x.r = y.r AND x.k = y.k AND y.i > x.i AND {LEAST_PERIODS} * (y.i - x.i) <= x.n
), s AS (
  SELECT r, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS b FROM m) GROUP BY r, q, b
), f AS (
  SELECT r, start, length, min(q) AS period FROM s WHERE length >= greatest({LEAST_WORDS}, {LEAST_PERIODS} * q) GROUP BY r, start, length
), e AS (
  SELECT r, count(*) AS n_runs, max(struct_pack(length := length, s := -start, p := -period)) AS most, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM f GROUP BY r
), c AS (
  SELECT r, sha256(coalesce(string_agg(k, ' ' ORDER BY i), '')) AS kept FROM t
  WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.r = t.r AND t.i >= f.start + f.period AND t.i < f.start + f.length) GROUP BY r
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, CAST(-most.s AS BIGINT) AS start, CAST(most.length AS BIGINT) AS length, CAST(-most.p AS BIGINT) AS period,
       CAST(1000 * most.length // -most.p AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, coalesce(kept, sha256('')) AS collapsed_sha256
FROM w LEFT JOIN e USING (r) LEFT JOIN c USING (r)
"""
