"""Cross-document line rules, by DataFrame functions alone.

Base measures come from a text's words and lines. Then the normalised lines of
all documents are counted by host (``source``): in how many of the host's
documents each occurs. Lines of more than ``MOST_DOCS`` documents, in hosts of
any size, are removed, and a document that keeps too few of its words is
rejected.

Defined results: a null text has no words and fails the base rules; documents
without a source form one host with those whose source is empty; repeated rows
are documents of their own and get equal results; a document counts once per
line however often it repeats it; an empty table gives an empty one; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.session import materialize

#: A line is common if more of its host's documents have it.
MOST_DOCS = 20
#: What must be left of a document: words, and percent of its words.
LEAST_WORDS, LEAST_PERCENT = 20, 40
#: Common lines of more than one in so many of all lines go to the documents by broadcast; there can be no more of them.
MOST_HOT = 10_000
#: Words of a window whose repetition counts.
WINDOW = 8

SPACE = r"[\x20\x09-\x0D]"
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; an empty array for null."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(bare, SPACE + "+"))


def line_hash(line: Column) -> Column:
    """A line's hash in lower case, digits as 0, runs of space as one."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]", "0"), SPACE + "+", " ")
    return F.xxhash64(F.btrim(plain, F.lit(BLANKS)))


def _repeated(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words from ``__words``: words in windows that occur twice or more.

    Windows are hashes of word hashes. Only where they aren't distinct are
    (hash, place) sorted, so that equal windows become neighbours; the places
    of those, in order, cover min(WINDOW, distance to the one before) words.
    """
    starts = F.sequence(F.lit(0), F.size("__hashes") - WINDOW)
    window = lambda i: F.xxhash64(*[F.get("__hashes", i + k) for k in range(WINDOW)])
    df = df.withColumn("__hashes", F.transform("__words", lambda w: F.xxhash64(w)))
    df = df.withColumn("__windows", F.when(F.size("__hashes") >= WINDOW, F.transform(starts, window)))
    df = df.withColumn(
        "__ordered",
        F.when(
            F.size(F.array_distinct("__windows")) < F.size("__windows"),
            F.array_sort(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    twin = lambda x, k: F.coalesce(F.get("__ordered", k)["h"] == x["h"], F.lit(False))
    places = F.transform("__ordered", lambda x, k: F.when(twin(x, k - 1) | twin(x, k + 1), x["i"]))
    df = df.withColumn("__places", F.array_sort(F.array_compact(places)))
    start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    step = lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last"))
    return df.withColumn("n_repeat_words", F.coalesce(F.aggregate("__places", start, step, lambda a: a["n"]), F.lit(0)).cast("long"))


def base_measures(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, __host, the base measures, base_failed, and its lines as (hash, words)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split("__text", "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "")
    df = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("__host"), text.alias("__text"))
    df = df.withColumn("__words", words_of(F.col("__text"))).withColumn("__lines", lines)
    df = df.select(
        "doc_id",
        "__host",
        F.size("__words").cast("long").alias("n_words"),
        (F.length("__text") - F.regexp_count("__text", F.lit(SPACE))).cast("long").alias("word_chars"),
        F.regexp_count("__text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.transform("__lines", lambda x: F.struct(line_hash(x).alias("h"), F.size(words_of(x)).alias("n"))).alias("__hashed"),
        "__words",
    )
    df = _repeated(df).drop("__words", "__hashes", "__windows", "__ordered", "__places")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return df.withColumn("base_failed", failed)


def common_lines(measured: DataFrame, most_docs: int = MOST_DOCS) -> DataFrame:
    """(__host, h, __n): the hashes of each host's common lines, and in how many documents they are."""
    lines = measured.select("__host", F.explode(F.array_distinct(F.transform("__hashed", lambda x: x["h"]))).alias("h"))
    return lines.groupBy("__host", "h").agg(F.count("*").alias("__n")).where(F.col("__n") > most_docs)


def judge(docs: DataFrame, most_docs: int = MOST_DOCS) -> DataFrame:
    """One row per document: doc_id, the base measures, base_failed, words_removed, kept.

    Lines that hold a large share of all rows, which would land in one task,
    meet the documents by broadcast; the rest, each a small share, by a join.
    """
    measured = materialize(base_measures(docs).withColumn("__row", F.monotonically_increasing_id()), "lines")
    lines = measured.select("__row", "__host", F.explode("__hashed").alias("x")).select("__row", "__host", "x.h", "x.n")
    common = materialize(common_lines(measured, most_docs), "common")
    total = measured.agg(F.coalesce(F.sum(F.size("__hashed")), F.lit(0))).first()[0]
    is_hot = F.col("__n") > max(64, total // MOST_HOT)
    hot = F.broadcast(common.where(is_hot).select("__host", "h"))
    met = lines.join(hot, ["__host", "h"]).unionByName(lines.join(hot, ["__host", "h"], "left_anti").join(common.where(~is_hot).select("__host", "h"), ["__host", "h"]))
    gone = met.groupBy("__row").agg(F.sum("n").alias("__gone"))
    df = measured.drop("__hashed", "__host").join(gone, "__row", "left").withColumn("words_removed", F.coalesce("__gone", F.lit(0)).cast("long"))
    left = F.col("n_words") - F.col("words_removed")
    kept = ~F.col("base_failed") & (left >= LEAST_WORDS) & (100 * left >= LEAST_PERCENT * F.col("n_words"))
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "words_removed")


ORACLE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, list_filter(regexp_split_to_array(t, '{SPACE}+'), lambda x: x <> '') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d
), win AS (
  SELECT r, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS k
  FROM w, unnest(range(1, len(ws) - {WINDOW - 2})) AS u(i) WHERE len(ws) >= {WINDOW}
), twice AS (
  SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, k) > 1
), covered AS (
  SELECT r, sum(n) AS n_repeat_words FROM (
    SELECT r, least({WINDOW}, coalesce(i - lag(i) OVER (PARTITION BY r ORDER BY i), {WINDOW})) AS n FROM twice
  ) GROUP BY r
), lines AS (
  SELECT r, host, trim(regexp_replace(regexp_replace(lower(l), '[0-9]', '0', 'g'), '{SPACE}+', ' ', 'g')) AS l,
         len(list_filter(regexp_split_to_array(l, '{SPACE}+'), lambda x: x <> '')) AS n
  FROM (SELECT r, host, unnest(ls) AS l FROM w)
), common AS (
  SELECT host, l FROM lines GROUP BY host, l HAVING count(DISTINCT r) > {MOST_DOCS}
), gone AS (
  SELECT r, sum(n) AS words_removed FROM lines SEMI JOIN common USING (host, l) GROUP BY r
), m AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(t) - length(regexp_replace(t, '[^\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(words_removed, 0) AS BIGINT) AS words_removed
  FROM w LEFT JOIN covered USING (r) LEFT JOIN gone USING (r)
), f AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_words - words_removed >= {LEAST_WORDS}
         AND 100 * (n_words - words_removed) >= {LEAST_PERCENT} * n_words AS kept,
       words_removed
FROM f
"""
