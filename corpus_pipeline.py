"""A corpus from documents: language, toxicity, near-duplicates, mixture, packing.

Every stage takes (spark, docs, sf_dir) and works on all its predecessor kept.
Models learn from the labelled documents of ``sf_dir``, outside the held-out
fold. All stages but the last return the columns of documents, whatever those
are named. Lengths are words.

Defined results, for all stages: an empty table gives an empty one; a null id
is a document like any other; rows that repeat are judged alike; with no labels
to learn from, a stage judges as its docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import langid, mixing, packing, simhash, toxicity
from weftline.llm.common import columns_of, unused
from weftline.session import materialize, release, table

#: A document whose language is less sure than this is rejected.
LEAST_SURE = 0.5
#: A document this likely to be toxic is rejected.
MOST_TOXIC = 0.5
#: Shares of words; toxic documents are gone before, so their domain has no target.
TARGETS = {"prose": 0.93, "junk": 0.07}


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language.

    Null texts, texts without letters, and texts less sure than ``LEAST_SURE``
    go; if no document has a language to learn, all do.
    """
    name = unused("__lang", docs.columns)
    found = F.col(name)
    judged = langid.predict(docs, table(spark, sf_dir, "documents"), name=name)
    return judged.where((found["lang"] != "und") & (found["score"] >= LEAST_SURE)).select(*columns_of(docs))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't toxic; null and empty texts aren't, and without toxic labels none is."""
    name = unused("__toxic", docs.columns)
    field = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.tag(docs, field, name).where(F.col(name)["score"] < MOST_TOXIC).select(*columns_of(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component, that with the smallest id; null and wordless texts are copies of one another."""
    return simhash.deduplicate(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target mixture of words asks for; without labels all have equal rates, and null texts have no words."""
    return mixing.mix(docs, table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents"), TARGETS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Placed parts of documents: bin_id, slot, doc_id, part, n_words; null texts take a slot and no room."""
    return packing.pack(docs, cluster=packing.text_cluster(F.col("text")))  # near copies are gone, repeats of a row are not


STAGES = [("language ID", language_id), ("toxicity", toxic), ("SimHash near-dedup", near_dedup), ("mixing to target weights", mixture), ("best-fit packing", pack)]

#: Learnt models decide; no SQL gives the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), "stage")
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
