"""What the corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.session import gathered, materialize

#: Texts of an Arrow batch that a worker holds as Python strings.
TEXTS_AT_ONCE = 512
#: Where the vocabulary files of public tokenizers lie.
TOKENIZERS = "/opt/tokenizers"


def fold(doc_id: Column | str) -> Column:
    """crc32 of the id as text, modulo 5; null for a null id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % 5


def held_out(doc_id: Column | str) -> Column:
    """True where the fold is 0. A row without an id is not held out; no label can reach it either."""
    return F.coalesce(fold(doc_id) == 0, F.lit(False))


def text_udf(work: Callable[[], Callable[[list], pa.Array]], kind: str) -> Callable[[Column], Column]:
    """A column function over whole texts, one Arrow batch at a time.

    ``work`` is called once per task and returns what turns a list of texts
    (None for null) into an Arrow array; it may keep bounded caches. Only the
    text column crosses to Python, other columns stay in the JVM. Marked
    nondeterministic so that Catalyst never evaluates it twice for a filter
    and a projection.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        each = work()
        for batch in batches:  # a few texts at a time become Python's
            yield pa.concat_arrays([each(batch.slice(i, TEXTS_AT_ONCE).to_pylist()) for i in range(0, max(1, len(batch)), TEXTS_AT_ONCE)])
            pa.default_memory_pool().release_unused()

    return F.arrow_udf(run, kind).asNondeterministic()


def portions(texts: list, rows: int, letters: int) -> Iterator[tuple[int, int]]:
    """Places (first, end) that cut ``texts`` into portions of at most so many rows and letters; a longer text is one of its own."""
    first = size = 0
    for i, text in enumerate(texts):
        n = len(text or "")
        if i > first and (i - first >= rows or size + n > letters):
            yield first, i
            first, size = i, 0
        size += n
    if texts:
        yield first, len(texts)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for what is run within: for rows so wide that the usual number fills a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def unused(name: str, taken: Iterable[str]) -> str:
    """``name``, with marks after it until no column of ``taken`` has it."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name += "_"
    return name


def columns_of(df: DataFrame) -> list[Column]:
    """All columns of ``df`` as they are, whatever signs their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


#: A key of more rows than this, and than a ten-thousandth of all, is looked up by broadcast.
LEAST_HOT, MOST_HOT = 64, 10_000


def look_up(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """``rows`` with the columns of ``facts``, null where it has none; one row a key in ``facts``, any number in ``rows``.

    A key that holds over 1 / MOST_HOT of the rows would land in one task, so
    the facts of those keys are broadcast: there can be MOST_HOT of them at
    most, whatever the data. The rest, which no key dominates, is shuffled.
    ``rows`` are read more than once and should be written.
    """
    n = rows.count()
    hot = rows.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") > max(LEAST_HOT, n // MOST_HOT)).select(key)
    hot = gathered(hot, n)
    hot_facts = materialize(facts.join(F.broadcast(hot), key, "left_semi").withColumn("__hot", F.lit(True)), "hot")
    names = [c for c in facts.columns if c != key]
    marked = rows.join(F.broadcast(hot_facts), key, "left")
    cold = marked.where("__hot IS NULL").select(*rows.columns).join(facts, key, "left")
    return cold.select(*rows.columns, *names).unionByName(marked.where("__hot").select(*rows.columns, *names))


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, most: int) -> DataFrame:
    """At most ``most`` rows (doc_id, text, label) to learn from.

    The labelled ids with the smallest hashes, a top-k over ids that moves no
    text, held-out fold and null labels left out. An id that is labelled more
    than once takes its largest label. The bound makes the broadcast safe.
    """
    ids = (
        labels.select("doc_id", F.col(column).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & (fold("doc_id") != 0))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    return one_text_each(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id"), "label")


def one_text_each(sample: DataFrame, *also: str) -> DataFrame:
    """One row per id of a sample (doc_id, text, and columns that follow from the id): the text with the smallest hash."""
    text = F.min(F.struct(F.xxhash64("text").alias("h"), F.col("text").alias("t"))).alias("__first")
    return sample.groupBy("doc_id", *also).agg(text).select("doc_id", F.col("__first.t").alias("text"), *also)
