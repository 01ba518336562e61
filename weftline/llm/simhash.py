"""SimHash near-duplicates: block join on pigeonhole keys, Hamming verification, components.

Defined results: a null or wordless text has fingerprint zero and links like
any other; fewer than three words are one shingle; repeated rows get equal
fingerprints and one component; a null id takes part in linking but is never a
component's id (null if a component has no other); an empty table gives an
empty one. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import columns_of, look_up, text_udf, unused
from weftline.llm.graph import connected_components
from weftline.session import gathered, materialize, settle

#: Fingerprints link at this many differing bits or fewer.
DISTANCE = 3
#: A fingerprint's bits in so many blocks; BLOCKS - DISTANCE of them agree for any linked pair.
BLOCKS = 6
#: Members of one block key that are compared in memory; larger groups are blocked once more.
MOST_TOGETHER = 4096
#: Keys of documents to drop that are broadcast, at most: longs and flags, some 100 MB as a hash table.
MOST_BROADCAST = 2_000_000
#: Shingles hashed at a time, so that a very long text needs no more memory than that.
SHINGLES_AT_ONCE = 1 << 16


def fingerprint_bits(text: str | None, width: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a text's word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    hashed = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = ends[width - 1 :] if len(words) >= width else ends[-1:]
    ones = np.zeros(64, np.int64)
    for i in range(0, n, SHINGLES_AT_ONCE):
        spans = zip(starts[i : i + SHINGLES_AT_ONCE][: n - i].tolist(), last[i : i + SHINGLES_AT_ONCE].tolist())
        h = np.array([hashed(joined[a:b], seed) for a, b in spans], "<u8")
        ones += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text as a signed long."""

    def work():
        return lambda texts: pa.array(np.array([fingerprint_bits(t) for t in texts], np.uint64).view(np.int64))

    return text_udf(work, "bigint")(text)


def _masks(bits: int, parts: int, free: int) -> list[int]:
    """Signed masks over the ``bits`` set bits of ``free``: each keeps all but DISTANCE of ``parts`` blocks, and what isn't free."""
    at = [i for i in range(64) if free >> i & 1]
    edges = [bits * i // parts for i in range(parts + 1)]
    blocks = [sum(1 << at[j] for j in range(edges[i], edges[i + 1])) for i in range(parts)]
    kept = [sum(c) for c in combinations(blocks, parts - DISTANCE)]
    signed = [(k | ~free) & ((1 << 64) - 1) for k in kept]
    return [m - (1 << 64) if m >> 63 else m for m in signed]


def _levels() -> list[list[list[int]]]:
    """For each level of blocking and each mask before it, the masks that refine it.

    The first level keeps 3 of 6 blocks; each later one splits the bits that
    are still free into 4 blocks and keeps 1, until at most 13 bits are free,
    so that no group of distinct fingerprints exceeds 2^13.
    """
    first = _masks(64, BLOCKS, (1 << 64) - 1)
    levels, now = [[first]], first
    while True:
        free = [~m & ((1 << 64) - 1) for m in now]
        if max(f.bit_count() for f in free) <= 13:
            return levels
        finer = [_masks(f.bit_count(), 4, f) for f in free]
        levels.append(finer)
        now = [m for ms in finer for m in ms]


def _stars(fps: np.ndarray) -> list[tuple[int, int]]:
    """(member, smallest of its component) within one group, without listing all close pairs."""
    left, out = np.sort(fps), []
    while len(left):
        root, front, left = left[0], left[:1], left[1:]
        while len(front) and len(left):
            near = np.zeros(len(left), bool)
            for i in range(0, len(front), 256):
                near |= (np.bitwise_count((front[i : i + 256, None] ^ left[None, :]).view(np.uint64)) <= DISTANCE).any(0)
            front, left = left[near], left[~near]
            out += [(int(x), int(root)) for x in front]
    return out


def _link_groups(most: int):
    """Streams rows (key, mask, fp) sorted by key; gives edges, and the rows of groups beyond ``most``."""

    def rows(a, b, mask) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(mask, pa.int32())], ["a", "b", "over"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held, passed_on = ("key", "fp", "mask"), None, None
        for batch in chain(batches, [None]):
            if batch is not None:
                new = [batch.column(n).to_numpy(zero_copy_only=False) for n in names]
                held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            if held is None or not len(held[0]):
                continue
            key = held[0]
            cut = len(key)
            if batch is not None:  # the last group may go on in the next batch
                last = int(np.searchsorted(key, key[-1]))
                if cut - last > most or key[-1] == passed_on:
                    passed_on = key[-1]
                else:
                    cut = last
            (key, fp, mask), held = [x[:cut] for x in held], [x[cut:] for x in held]
            if not cut:
                continue
            starts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1])
            sizes = np.diff(np.append(starts, cut))
            big = sizes > most
            if passed_on is not None:
                big |= key[starts] == passed_on
            every = np.repeat(big, sizes)
            yield rows(key[every], fp[every], mask[every])
            two = starts[(sizes == 2) & ~big]
            two = two[np.bitwise_count((fp[two] ^ fp[two + 1]).view(np.uint64)) <= DISTANCE]
            yield rows(fp[two], fp[two + 1], np.full(len(two), -1))
            edges = [e for i in np.flatnonzero((sizes > 2) & ~big) for e in _stars(fp[starts[i] : starts[i] + sizes[i]])]
            yield rows([x for x, _ in edges], [y for _, y in edges], np.full(len(edges), -1))

    return run


def link(fps: DataFrame, most_together: int = MOST_TOGETHER) -> DataFrame:
    """Edges (a, b) that connect all of the distinct fingerprints ``fps`` (fp) within DISTANCE bits.

    Each fingerprint goes under 20 keys of at least 31 agreeing bits. A group
    of a key is compared in memory, streamed in key order, and gives a spanning
    forest, not all its pairs. A group beyond ``most_together`` is passed on and
    blocked by more bits, at the last level by so many that its size is bounded
    by the bits left.
    """
    found = None
    rows, at_level = fps, None
    levels = _levels()
    for depth, choices in enumerate(levels):
        if depth == 0:
            masks = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(m).alias("m")) for i, m in enumerate(choices[0])])
        else:
            each = [F.array(*[F.struct(F.lit(j * len(c) + i).alias("i"), F.lit(m).alias("m")) for i, m in enumerate(c)]) for j, c in enumerate(choices)]
            masks = F.element_at(F.array(*each), F.col("mask") + 1)
        keyed = (
            rows.select("fp", F.explode(masks).alias("x"))
            .select(F.xxhash64(F.col("x.i"), F.col("fp").bitwiseAND(F.col("x.m"))).alias("key"), F.col("x.i").alias("mask"), "fp")
            .repartition("key")
            .sortWithinPartitions("key", "fp")
        )
        most = most_together if depth + 1 < len(levels) else 1 << 62
        made = materialize(keyed.mapInArrow(_link_groups(most), "a bigint, b bigint, over int"), "links")
        edges = made.where("over < 0").select("a", "b")
        found = edges if found is None else found.union(edges)
        rows = made.where("over >= 0").select(F.col("b").alias("fp"), F.col("over").alias("mask"))
        if rows.isEmpty():
            break
    return found


def components(prints: DataFrame, most_together: int = MOST_TOGETHER) -> DataFrame:
    """(fp, component_id) for each distinct fingerprint of ``prints`` (doc_id, fp)."""
    reps = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "reps")
    roots = materialize(connected_components(link(reps.select("fp"), most_together)), "roots")
    joined = roots.join(reps, roots["node"] == reps["fp"]).select("node", "root", "least")
    named = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = joined.join(named, "root").select("node", "component_id", F.lit(True).alias("linked"))
    return reps.join(linked, reps["fp"] == linked["node"], "left").select(
        "fp", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("least")).alias("component_id")
    )


def near_duplicates(docs: DataFrame, most_together: int = MOST_TOGETHER) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    prints = materialize(docs.select("doc_id", fingerprint(F.col("text")).alias("fp")), "prints")
    found = look_up(prints, settle(lambda: components(prints, most_together), "components"), "fp")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def clusters(prints: DataFrame) -> DataFrame:
    """(fp, root) for the fingerprints of ``prints`` (t, fp) that are linked to others, root naming the component.

    Fingerprints link within DISTANCE bits, and where rows share their ``t``.
    """
    pairs = materialize(gathered(prints.select("t", "fp").distinct(), prints.count()), "pairs")
    least = pairs.groupBy("t").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a != b").select("t", "a")
    same = pairs.join(least, "t").where("fp != a").select("a", F.col("fp").alias("b"))
    found = link(pairs.select("fp").distinct()).union(same)
    return connected_components(found).select(F.col("node").alias("fp"), "root")


def deduplicate(docs: DataFrame, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """The rows of ``docs`` with one document of each component: that with its smallest id.

    Rows with equal ids and texts are one document. In a component without any
    id, the text with the smallest hash stays.

    Decisions are made on ids and hashes. What is to go is one long a document;
    up to ``most_broadcast`` of them meet the documents by broadcast, so no text
    is shuffled but of rows that repeat one that stays. Beyond, they are joined.
    """
    key_of = lambda t: F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), t)
    text = F.xxhash64("text")
    prints = materialize(docs.select("doc_id", text.alias("t"), key_of(text).alias("k"), fingerprint(F.col("text")).alias("fp")), "prints")
    roots = settle(lambda: connected_components(link(prints.select("fp").distinct())), "roots")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t", "k").alias("first")
    reps = prints.groupBy("fp").agg(F.min(order).alias("first"))
    whole = reps.join(roots, reps["fp"] == roots["node"], "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first"))
    stay = whole.select(F.col("first.k").alias("k"), F.lit(True).alias("stays"))
    rows = prints.groupBy("k").agg(F.count("*").alias("n"))
    treat = rows.join(stay, "k", "left").where("n > 1 OR stays IS NULL").select("k", F.col("stays").isNotNull().alias("repeats"))
    k, repeats = unused("__k", docs.columns), unused("__repeats", docs.columns)
    treat = materialize(treat.select(F.col("k").alias(k), F.col("repeats").alias(repeats)), "treat")
    few = treat.limit(most_broadcast + 1).count() <= most_broadcast
    marked = docs.withColumn(k, key_of(text)).join(F.broadcast(treat) if few else treat, k, "left")
    own = columns_of(docs)
    return marked.where(F.col(repeats).isNull()).select(*own).union(marked.where(F.col(repeats)).dropDuplicates([k]).select(*own))
