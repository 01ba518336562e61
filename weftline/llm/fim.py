"""Fill-in-the-middle: texts cut at unit boundaries and rearranged around sentinels.

A unit grammar says which characters may stand on either side of a cut. It is
translated to a zero-width regular expression, a lookbehind for the class
before and a lookahead for the class after, so that Spark's ``split`` gives
the units and loses no character.

A prefix, a middle and a suffix are drawn from a document's units by the hash
of its id, and put in prefix-suffix-middle or suffix-prefix-middle order.

Defined results: null and empty texts have no units and stay as they are
(plain, an empty output), as do texts that hold a sentinel already; a null id
is hashed as the word null; repeated rows get equal results, and equal texts
of different ids are cut in places of their own; an empty table gives an empty
one; other columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import columns_of, unused

SPACE, WORD, ANY = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]", r"[\s\S]"
#: Per unit grammar, the classes (before, after) between which a unit ends.
UNITS = {
    "lines": [(r"\n", ANY)],  # [^\n]*\n|[^\n]+
    "words": [(WORD, SPACE)],  # space before a word is the word's
    "words_first": [(SPACE, WORD)],  # space after a word is the word's
    "runs": [(WORD, SPACE), (SPACE, WORD)],
    "sentences": [(r"[.!?]", SPACE)],
    "code_points": [(ANY, r"[^\uDC00-\uDFFF]")],  # never between the halves of a surrogate pair
}
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 7
#: Percent of the texts that are rearranged, and percent of those in suffix-prefix-middle order.
RATE, SPM = 100, 50


def boundary(unit: str) -> str:
    """The zero-width regular expression that matches where a unit ends and another begins."""
    return "|".join(f"(?<={before})(?={after})" for before, after in UNITS[unit])


def units(text: Column, unit: str = "lines") -> Column:
    """The units of a text in order; joined, they are the text. None for null and empty texts."""
    pieces = F.split(text, boundary(unit), -1)
    return F.when(F.coalesce(text, F.lit("")) == "", F.expr("cast(array() as array<string>)")).otherwise(pieces)


def draws(doc_id: Column, seed: int = SEED) -> Column:
    """Four numbers below 2^32 from the hash of the seed and the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)])


def transform(docs: DataFrame, unit: str = "lines", rate: int = RATE, spm: int = SPM, seed: int = SEED, name: str = "fim") -> DataFrame:
    """``docs`` with a struct ``name``: n (units), form (plain, psm or spm), output, prefix_chars, middle_chars."""
    own, work = columns_of(docs), unused("__fim", [*docs.columns, name])
    at = lambda f: F.col(work)[f]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = docs.withColumn(work, F.struct(units(text, unit).alias("u"), draws(F.col("doc_id"), seed).alias("h"), text.alias("text")))
    n = F.size(at("u")).cast("long")
    cut = lambda i: at("h")[i] % (n + 1)
    held = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        held = held | F.contains(at("text"), F.lit(mark))
    plain = (at("text") == "") | held | (at("h")[2] % 100 >= rate)
    form = F.when(plain, "plain").when(at("h")[3] % 100 < spm, "spm").otherwise("psm")
    df = df.withColumn(
        work,
        F.struct(at("u").alias("u"), at("text").alias("text"), n.alias("n"), form.alias("form"), F.least(cut(0), cut(1)).cast("int").alias("a"), F.greatest(cut(0), cut(1)).cast("int").alias("b")),
    )
    part = lambda first, last: F.array_join(F.slice(at("u"), first + 1, last - first), "")
    df = df.withColumn(
        work,
        F.struct(
            at("n").alias("n"), at("form").alias("form"), at("text").alias("text"),
            F.when(at("form") != "plain", F.struct(part(F.lit(0), at("a")).alias("p"), part(at("a"), at("b")).alias("m"), part(at("b"), at("n").cast("int")).alias("s"))).alias("cut"),
        ),
    )
    p, m, s = (at("cut")[x] for x in "pms")
    output = (
        F.when(at("form") == "psm", F.concat(F.lit(PREFIX), p, F.lit(SUFFIX), s, F.lit(MIDDLE), m))
        .when(at("form") == "spm", F.concat(F.lit(SUFFIX), s, F.lit(PREFIX), p, F.lit(MIDDLE), m))
        .otherwise(at("text"))
    )
    made = F.struct(at("n").alias("n"), at("form").alias("form"), output.alias("output"), F.length(p).cast("long").alias("prefix_chars"), F.length(m).cast("long").alias("middle_chars"))
    return df.select(*own, made.alias(name))


def restore(output: Column, form: Column) -> Column:
    """The text that ``transform`` made ``output`` of.

    No sentinel occurs in a rearranged text, and none can arise across a
    piece's end, as only a sentinel's first character is ``<``.
    """
    parts = F.split(output, "|".join((PREFIX, SUFFIX, MIDDLE)), -1)
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)


def digests(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n, form, prefix_chars, middle_chars, and hashes of the output and of the text rebuilt from it."""
    made = transform(docs.select("doc_id", "text"))
    x = lambda f: F.col("fim")[f]
    sha = lambda c: F.sha2(c, 256)
    return made.select(
        "doc_id", x("n").alias("n"), x("form").alias("form"), x("prefix_chars").alias("prefix_chars"), x("middle_chars").alias("middle_chars"),
        sha(x("output")).alias("output_sha256"), sha(restore(x("output"), x("form"))).alias("restored_sha256"),
    )


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents
), u AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS us,
         CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
         CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
  FROM d
), c AS (
  SELECT *, CAST(len(us) AS BIGINT) AS n, least(h1 % (len(us) + 1), h2 % (len(us) + 1)) AS a, greatest(h1 % (len(us) + 1), h2 % (len(us) + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR h3 % 100 >= {RATE} THEN 'plain'
              WHEN h4 % 100 < {SPM} THEN 'spm' ELSE 'psm' END AS form
  FROM u
), p AS (
  SELECT *, coalesce(array_to_string(us[1:a], ''), '') AS prefix, coalesce(array_to_string(us[a + 1:b], ''), '') AS middle, coalesce(array_to_string(us[b + 1:], ''), '') AS suffix FROM c
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle
                        WHEN 'spm' THEN '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle ELSE t END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
