"""Conflict-constrained best-fit packing of documents into token windows.

Documents go in decreasing length into the open bin with the least room that
takes them; a bin takes no second document of one source and none of one
duplicate cluster. Bins lie in order of the room they have, in a tree whose
nodes hold bitmaps of their bins; what bins hold of a source or a cluster are
bitmaps too. So the search for a successor passes over any number of bins that
conflict at once, and ends at the tightest bin that fits, or opens one.

A document longer than a bin is cut: its full parts fill bins of their own and
its rest is packed as a document. Rows are numbered and dealt to shards by a
hash of their number, a number of shards in proportion to the rows, and every
shard is packed by itself; so rows that repeat lie in all shards, memory is
bounded, and no bin spans two tasks.

Clusters are the components of near copies: texts whose SimHash fingerprints
link, as in ``simhash``, or that differ in case and spacing only.

Defined results: a null or wordless text has length 0 and is packed with that;
a null source or cluster conflicts with nothing; rows that repeat are packed
each, and conflict as one cluster; an empty table gives an empty one; other
columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm import simhash
from weftline.llm.common import look_up
from weftline.session import materialize, settle

#: Words, or what else lengths count, in a bin.
CAPACITY = 2048
#: Rows of a shard, on average.
SHARD_ROWS = 8192

PLACED = pa.schema([("bin_id", pa.int64()), ("slot", pa.int32()), ("doc_id", pa.int64()), ("part", pa.int32()), ("n", pa.int64())])


def best_fit(items: list[tuple[int, object, object]], capacity: int) -> list[int]:
    """The bin of each item (length, source, cluster), in the given order; lengths are at most ``capacity``."""
    base = 1 << capacity.bit_length()  # the leaf of room r is base + r, the parent of a node half its number
    tree: dict[int, int] = {}
    held: dict[tuple[bool, object], int] = {}  # by source, and by cluster, the bins that hold it
    rooms: list[int] = []
    out = []
    for length, source, cluster in items:
        keys = [(kind, x) for kind, x in ((False, source), (True, cluster)) if x is not None]
        free = -1
        for key in keys:
            free &= ~held.get(key, 0)
        node = base + length
        fit = tree.get(node, 0) & free
        while not fit and node > 1:  # up, to the first subtree of more room that holds a bin without conflict
            if not node & 1:
                fit = tree.get(node + 1, 0) & free
            node = node + 1 if fit else node >> 1
        while fit and node < base:  # and down to the least room in it
            node <<= 1
            fit = tree.get(node, 0) & free
            if not fit:
                node += 1
                fit = tree[node] & free
        if fit:
            found = (fit & -fit).bit_length() - 1
        else:
            found, node = len(rooms), base + capacity
            rooms.append(capacity)
            for k in range(node.bit_length()):
                tree[node >> k] = tree.get(node >> k, 0) | 1 << found
        rooms[found] -= length
        bit, new = 1 << found, base + rooms[found]
        while node != new:
            tree[node] ^= bit
            tree[new] = tree.get(new, 0) | bit
            node, new = node >> 1, new >> 1
        for key in keys:
            held[key] = held.get(key, 0) | bit
        out.append(found)
    return out


def least_bins(placed: DataFrame, name: str, capacity: int = CAPACITY) -> tuple[int, int]:
    """Bins that ``placed`` takes, and those that its length would fill if nothing conflicted."""
    bins, total = placed.agg(F.count_distinct("bin_id"), F.coalesce(F.sum(name), F.lit(0))).first()
    return bins, -(-total // capacity)


def pack_shard(rows: pa.Table, capacity: int) -> pa.Table:
    """One shard's rows (shard, doc_id, n, source, cluster, tie) as placed parts; ids stay the longs they are."""
    parts = []
    columns = [rows.column(c).to_pylist() for c in ("doc_id", "n", "source", "cluster", "tie")]
    for doc, n, source, cluster, tie in zip(*columns):
        full, rest = divmod(n, capacity)
        parts += [(capacity, doc, i, source, cluster, tie) for i in range(full)]
        if rest or not full:
            parts.append((rest, doc, full, source, cluster, tie))
    parts.sort(key=lambda p: (-p[0], p[1] is None, p[1] or 0, p[5], p[2]))
    bins = best_fit([(p[0], p[3], p[4]) for p in parts], capacity)
    seen: dict[int, int] = {}
    base = rows.column("shard")[0].as_py() << 32
    slots = []
    for b in bins:
        seen[b] = seen.get(b, -1) + 1
        slots.append(seen[b])
    made = [[base + b for b in bins], slots, [p[1] for p in parts], [p[2] for p in parts], [p[0] for p in parts]]
    return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(made, PLACED)], schema=PLACED)


def word_count(text: Column) -> Column:
    """Words of a text, none for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def text_cluster(text: Column) -> Column:
    """A hash that texts share if they differ in case and spacing only."""
    return F.xxhash64(F.trim(F.regexp_replace(F.lower(text), r"[\x20\x09-\x0D]+", " ")))


def pack(docs: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS, length: Column | None = None, cluster: Column | None = None, name: str = "n_words") -> DataFrame:
    """One row per part of a document: bin_id, slot in the bin, doc_id, part, and its length as ``name``.

    Lengths are words unless ``length`` gives them, as ``tokens.length`` does.
    ``cluster`` takes the place of the components of near copies.
    """
    length = word_count(F.col("text")) if length is None else length
    near = cluster is None
    cluster = text_cluster(F.col("text")) if near else cluster
    items = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), length.alias("n"), F.col("source").cast("string").alias("source"),
        F.when(F.col("text").isNotNull(), cluster).alias("cluster"), F.xxhash64("text", "source").alias("tie"),
        *([simhash.fingerprint(F.col("text")).alias("fp")] if near else []),
    )
    items = materialize(items.withColumn("row", F.monotonically_increasing_id()), "items")
    shards = max(1, -(-items.count() // shard_rows))
    if near:
        texts = items.where("cluster IS NOT NULL").select(F.col("cluster").alias("t"), "fp")
        items = look_up(items, settle(lambda: simhash.clusters(texts), "roots"), "fp").withColumn("cluster", F.when(F.col("cluster").isNotNull(), F.coalesce("root", "fp")))
    shard = F.pmod(F.xxhash64("row", F.lit(8)), F.lit(shards)).alias("shard")
    items = items.select(shard, "doc_id", "n", "source", "cluster", "tie")

    def run(rows: pa.Table) -> pa.Table:
        return pack_shard(rows, capacity)

    return items.groupBy("shard").applyInArrow(run, "bin_id bigint, slot int, doc_id bigint, part int, n bigint").withColumnRenamed("n", name)
