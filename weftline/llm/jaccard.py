"""N-gram Jaccard join: documents whose sets of word shingles overlap by four fifths, by prefix trees.

A document's set is its distinct 5-word shingles as 62-bit hashes in one
global order: by hash, with shingles that many documents share at the end, the
commonest last. Two sets link if their intersection is PERCENT of their union
or more. Then they share a shingle among the first n - ceil(PERCENT n) + 1 of
either, its prefix.

Equal sets are one from the start. Sets that may link meet in groups, and a
group is a prefix tree over whole ordered sets: a set walks down it, so that
sets which begin alike share the overlap counted so far, and leaves a subtree
when what is left of either side can't bring the overlap to what its smallest
set needs. A group gives a spanning forest of its links, not all of them.

Groups are made in three rounds, each leaving out what the ones before joined:
sets that share one of their KEYS smallest hashes, compared until few links
come; one set of each component for every shingle that prefixes of several
components share; and all sets for such shingles that are left. The last round
alone is exact, the others keep it small. Before its sets are made, a group is
sifted by bitmaps of a few bits a shingle: the bits in which two differ are
fewer than the shingles in which their sets do, so who differs from all others
in too many has no link there. Sets are made of the texts of those that are
left; of all others only prefixes and bitmaps are ever written.

Defined results: null and wordless texts have empty sets, which link with
nothing and are components of their own; fewer than five words are one
shingle; repeated rows and equal sets are one component; a null id takes part
and is never a component's id (null if it has no other); an empty table gives
an empty one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import batches_of, look_up, text_udf
from weftline.llm.graph import connected_components
from weftline.session import gathered, materialize, release

#: Words of a shingle, and the least percent of a union that an intersection is.
WIDTH, PERCENT = 5, 80
#: Smallest hashes of a set under which it meets others in the first round.
KEYS = 4
#: Shingles that are looked through together for common ones, and how many of those are put last, at most.
SHINGLES_AT_ONCE, MOST_COMMON = 1 << 20, 1 << 16
#: A shingle of fewer sightings is not common.
LEAST_COMMON = 16
#: Sets of one key in the first round; larger groups are dealt out by hash.
TOGETHER = 512
#: Shingles of a group in one task's memory; larger groups are split, each part meeting each.
BLOCK = 1 << 21
#: In the first round, sets in a row without a link after which a group is left to the later rounds.
PATIENCE = 16
#: Rows that are broadcast, at most: two longs each.
MOST_BROADCAST = 2_000_000
#: Groups of more sets than this aren't sifted in the first round, which compares no such group whole.
MOST_SIFTED = 256
#: Texts or sets in an Arrow batch.
WIDE_ROWS = 1000

_TOP = 1 << 62
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """The distinct shingles of a text, A-Z in lower case, as ascending numbers below 2^62."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.int64)
    hashed = xxhash.xxh64_intdigest
    w = np.fromiter(map(hashed, words), np.uint64, len(words))
    if len(w) < WIDTH:
        h = np.bitwise_xor.reduce(_mixed(w * _ODD[: len(w)]), keepdims=True) + np.uint64(len(w))
    else:
        n = len(w) - WIDTH + 1
        h = w[:n] * _ODD[0]
        for k in range(1, WIDTH):
            h += w[k : k + n] * _ODD[k]
    return np.unique((_mixed(h) >> np.uint64(2)).view(np.int64))


def common_shingles(docs: DataFrame, most: int = MOST_COMMON, least: int = LEAST_COMMON) -> np.ndarray:
    """Shingles that many documents share, the rarest first; at most ``most``.

    Counted where a million shingles lie together hold one twice or more. Any
    choice gives the same links, so a shingle that is missed costs time only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def count() -> pa.RecordBatch:
            v, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(v[n > 1]), pa.array(n[n > 1].astype(np.int64))], ["v", "n"])

        for batch in batches:
            for text in batch.column("text").to_pylist():
                held.append(shingles(text))
                size += len(held[-1])
                if size > SHINGLES_AT_ONCE:
                    yield count()
                    held, size = [], 0
        if held:
            yield count()

    seen = docs.select("text").mapInArrow(run, "v bigint, n bigint").groupBy("v").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    with batches_of(docs.sparkSession, WIDE_ROWS):
        seen = materialize(seen, "common")
    size = F.floor(F.log2("n") * 8).alias("size")
    bar, above = None, 0
    for x, n in seen.groupBy(size).count().orderBy(F.desc("size")).collect():
        above += n
        if above > most:
            break
        bar = x
    if bar is None:
        return np.zeros(0, np.int64)
    rows = seen.select("v", "n", size).where(F.col("size") >= bar).toArrow()
    release(seen)
    v, n = (rows.column(c).to_numpy() for c in "vn")
    return v[np.lexsort((v, n))]


def parities(v: np.ndarray) -> bytes:
    """A bitmap of twice as many bits as shingles or more, a power of two: whether an odd number of them falls on a bit."""
    size = max(64, 1 << int(2 * len(v) - 1).bit_length())
    return np.packbits(np.bincount(v & (size - 1), minlength=size) & 1, bitorder="little").tobytes()


def sift(n: np.ndarray, comp: np.ndarray, bits: list[np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """Which sets may link with one of another component, by their sizes, in ascending order, and bitmaps of 64-bit words."""
    keep = np.zeros(len(n), bool)
    words = np.array([len(b) for b in bits])
    plain = {w: np.stack([b for b in bits if len(b) == w]) for w in np.unique(words)}
    first = {w: int(np.searchsorted(words, w)) for w in plain}  # bitmaps grow with sizes, so those of one width lie together
    folded = {w: plain[2 * w][:, :w] ^ plain[2 * w][:, w:] for w in plain if 2 * w in plain}
    for i in range(len(n) - 1):
        end = int(np.searchsorted(n, 100 * n[i] // percent, "right"))
        w = int(words[i])
        for rows, start in ((plain[w], first[w]), (folded.get(w), first.get(2 * w, 0))):
            if rows is None:
                continue
            lo, hi = max(i + 1, start), min(end, start + len(rows))
            if lo >= hi:
                continue
            differ = np.bitwise_count(rows[lo - start : hi - start] ^ bits[i]).sum(1, dtype=np.int64)
            both = n[i] + n[lo:hi]
            near = (differ <= both - 2 * -(-percent * both // (100 + percent))) & (comp[lo:hi] != comp[i])
            keep[lo:hi] |= near
            keep[i] |= near.any()
    return keep


def _sifted(most: int | None):
    """Streams rows (key, n, row, comp, bits) sorted by key and n; passes on those that may link within their group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, rows, comps, bits = None, [], [], [], []

        def passed() -> pa.RecordBatch:
            keep = np.ones(len(n), bool) if most is not None and len(n) > most else sift(np.array(n), np.array(comps), bits)
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (np.full(int(keep.sum()), key), np.array(rows)[keep], np.array(comps)[keep])], ["key", "row", "comp"])

        for batch in batches:
            for k, size, row, comp, b in zip(*(batch.column(c).to_pylist() for c in ("key", "n", "row", "comp", "bits"))):
                if k != key and rows:
                    if len(rows) > 1:
                        yield passed()
                    n, rows, comps, bits = [], [], [], []
                key = k
                n.append(size)
                rows.append(row)
                comps.append(comp)
                bits.append(np.frombuffer(b, np.uint64))
        if len(rows) > 1:
            yield passed()

    return run


def _facts(text: Column, common: np.ndarray, whole: bool) -> Column:
    """Of a text a struct: n, s (a digest of its set, null if empty), bits, keys (its smallest hashes), and its set in the global order or, unless ``whole``, its prefix."""
    by_value = np.argsort(common, kind="stable")
    sorted_common = common[by_value]

    def ordered(v: np.ndarray) -> np.ndarray:
        if not len(common):
            return v
        at = np.minimum(np.searchsorted(sorted_common, v), len(common) - 1)
        last = sorted_common[at] == v
        return np.concatenate([v[~last], np.sort(_TOP + by_value[at[last]])]) if last.any() else v

    def each(texts: list) -> pa.Array:
        found = [shingles(t) for t in texts]
        digests = []
        for v in found:
            u = v.view(np.uint64)
            digests.append(np.array([_mixed(u + _ODD[1]).sum(), _mixed(u * _ODD[2] + _ODD[3]).sum()], np.uint64).tobytes() if len(v) else None)
        lists = lambda parts: pa.LargeListArray.from_arrays(np.cumsum([0, *map(len, parts)]), pa.array(np.concatenate([np.zeros(0, np.int64), *parts]))).cast(pa.list_(pa.int64()))
        end = lambda v: len(v) if whole else len(v) - -(-PERCENT * len(v) // 100) + 1
        columns = [pa.array([len(v) for v in found], pa.int64()), pa.array(digests, pa.binary()), pa.array([parities(v) for v in found], pa.binary()), lists([v[:KEYS] for v in found]), lists([ordered(v)[: end(v)] for v in found])]
        return pa.StructArray.from_arrays(columns, ["n", "s", "bits", "keys", "set"])

    return text_udf(lambda: each, "struct<n: bigint, s: binary, bits: binary, keys: array<bigint>, set: array<bigint>>")(text)


def _identity() -> Column:
    """A hash of a row's id and text."""
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("text").cast("string"))


def _whole_sets(docs: DataFrame, common: np.ndarray, wanted: DataFrame) -> DataFrame:
    """(row, set) for ``wanted`` (row, k, s), made again of the texts of those rows; of rows that repeat one is read."""
    texts = _met(docs.select(_identity().alias("k"), F.col("text").cast("string").alias("text")), wanted, "k")
    one = texts.groupBy("row").agg(F.first("s").alias("s"), F.first("text").alias("text"))
    made = one.select("row", "s", _facts(F.col("text"), common, True).alias("x")).where(F.col("s") == F.col("x.s")).select("row", "x.set")
    with batches_of(docs.sparkSession, WIDE_ROWS):
        return materialize(made, "whole")


class Branch:
    """A node of the tree: the stretch of values that leads to it, what follows, and the sets that end here."""

    __slots__ = ("values", "next", "ends", "up", "least", "most", "live")

    def __init__(self, values: np.ndarray, up: Branch | None):
        self.values, self.up = values, up
        self.next: dict[int, Branch] = {}
        self.ends: list[int] = []
        self.least = self.most = self.live = 0


class PrefixTree:
    """Ordered sets, stored once for what they begin with alike."""

    def __init__(self, sets: list[np.ndarray], percent: int = PERCENT):
        self.sets, self.percent = sets, percent
        self.root = Branch(sets[0][:0], None)
        self.home = [self._insert(i, s) for i, s in enumerate(sets)]
        for i, s in enumerate(sets):
            node = self.home[i]
            while node is not None:
                node.least = min(node.least, len(s)) if node.live else len(s)
                node.most = max(node.most, len(s))
                node.live += 1
                node = node.up

    def _insert(self, i: int, s: np.ndarray) -> Branch:
        node, at = self.root, 0
        while at < len(s):
            child = node.next.get(int(s[at]))
            if child is None:
                child = node.next[int(s[at])] = Branch(s[at:], node)
                at = len(s)
            else:
                k = min(len(child.values), len(s) - at)
                off = np.flatnonzero(child.values[:k] != s[at : at + k])
                k = int(off[0]) if len(off) else k
                if k < len(child.values):  # a new node between, where the two part
                    between = node.next[int(s[at])] = Branch(child.values[:k], node)
                    child.values, child.up = child.values[k:], between
                    between.next[int(child.values[0])] = child
                    child = between
                at += k
            node = child
        node.ends.append(i)
        return node

    def drop(self, i: int) -> None:
        """Takes a set out."""
        node = self.home[i]
        node.ends.remove(i)
        while node is not None:
            node.live -= 1
            node = node.up

    def linked(self, r: np.ndarray) -> list[int]:
        """The sets in the tree that ``r`` links with."""
        n, percent = len(r), self.percent
        out, walk = [], [(self.root, 0, 0)]
        while walk:
            node, depth, same = walk.pop()
            for i in node.ends:
                if 100 * same >= percent * (n + len(self.sets[i]) - same):
                    out.append(i)
            for child in node.next.values():
                if not child.live or 100 * child.most < percent * n or 100 * n < percent * child.least:
                    continue
                least = max(child.least, -(-percent * n // 100))
                need = -(-percent * (n + least) // (100 + percent))
                values, here, at, width = child.values, same, 0, 64
                while at < len(values):
                    part = values[at : at + width]
                    place = np.searchsorted(r, part)
                    hits = r[np.minimum(place, n - 1)] == part
                    here += int(np.count_nonzero(hits))
                    at, width = at + len(part), 2 * width
                    left = min(n - int(place[-1]) - int(hits[-1]), child.most - depth - at)
                    if here + left < need:
                        break
                else:
                    walk.append((child, depth + len(values), here))
        return out


def forest(sets: list[np.ndarray], groups: list[int], percent: int = PERCENT, patience: int | None = None) -> list[tuple[int, int]]:
    """Links (i, j) that join all sets which links and equal ``groups`` connect; a link within a group is not looked for.

    A group's sets look for others together; whoever is found joins them with
    all of its group. Ends after ``patience`` groups in a row that found none.
    """
    tree = PrefixTree(sets, percent)
    members: dict[int, list[int]] = {}
    for i, g in enumerate(groups):
        members.setdefault(g, []).append(i)
    out, missed = [], 0
    for g in sorted(members, key=lambda g: len(members[g])):
        if g not in members:
            continue
        front, before = members.pop(g), len(out)
        for i in front:
            tree.drop(i)
        while front and tree.root.live:
            i = front.pop()
            for j in tree.linked(sets[i]):
                out.append((i, j))
                if groups[j] in members:
                    joined = members.pop(groups[j])
                    front += joined
                    for k in joined:
                        tree.drop(k)
        missed = 0 if len(out) > before else missed + 1
        if not tree.root.live or (patience is not None and missed >= patience):
            break
    return out


def _forests(patience: int | None):
    """Streams rows (key, row, comp, set) sorted by key; gives each group's links (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, comps, sets = None, [], [], []

        def links() -> pa.RecordBatch:
            found = forest(sets, comps, PERCENT, patience) if len(sets) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([rows[x[k]] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            arrays = batch.column("set")
            flat, edges = arrays.values.to_numpy(), arrays.offsets.to_numpy()
            for i, (k, row, comp) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("key", "row", "comp")))):
                if k != key and rows:
                    yield links()
                    rows, comps, sets = [], [], []
                key = k
                rows.append(row)
                comps.append(comp)
                sets.append(flat[edges[i] : edges[i + 1]].copy())
        if rows:
            yield links()

    return run


def _met(rows: DataFrame, facts: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """A join with ``facts``, which are written; by broadcast if they are at most MOST_BROADCAST rows."""
    few = facts.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    return rows.join(F.broadcast(facts) if few else facts, key, how)


def _links(keyed: DataFrame, prints: DataFrame, read: Callable[[DataFrame], DataFrame], label: str, patience: int | None = None) -> DataFrame:
    """Links (a, b) within the groups of ``keyed`` (key, row, comp, n) that hold several components.

    ``prints`` has a row's n, bits, k and s; ``read`` makes the sets of some.

    Keys with the same rows are one group. With ``patience`` large groups are
    dealt out, and what lies in different parts is not compared; without, every
    part of a large group meets every other.
    """
    keyed = materialize(keyed, f"{label}-keyed")
    n = keyed.count()
    member = F.xxhash64("row")
    groups = keyed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("many"), F.sum(F.col("n")).alias("size"), F.sum(member.bitwiseAND(F.lit((1 << 40) - 1))).alias("g"))
    groups = materialize(gathered(groups.where("lo < hi").select("key", "g", "many", "size"), n), f"{label}-groups")
    rows = look_up(keyed, groups, "key").where("g IS NOT NULL")
    if patience is None:
        parts = F.ceil(F.col("size") / BLOCK).cast("int")
        own = F.pmod(member, parts).cast("int")
        other = F.when(parts > 1, F.filter(F.sequence(F.lit(0), parts - 1), lambda j: j != F.col("own"))).otherwise(F.array(F.lit(0)))
        rows = rows.withColumn("own", own).withColumn("other", F.explode(other))
        rows = rows.withColumn("key", F.xxhash64("g", "many", F.least("own", "other"), F.greatest("own", "other")))
    else:
        parts = F.greatest(F.ceil(F.col("many") / TOGETHER), F.ceil(F.col("size") / BLOCK)).cast("int")
        rows = rows.withColumn("key", F.xxhash64("g", "many", F.pmod(F.xxhash64("key", "row"), parts)))
    rows = materialize(gathered(rows.select("key", "row", "comp").distinct(), n), f"{label}-rows")
    small = _met(prints.select("row", "n", "bits"), rows, "row").repartition("key").sortWithinPartitions("key", "n")
    before, rows = rows, materialize(small.mapInArrow(_sifted(None if patience is None else MOST_SIFTED), "key bigint, row bigint, comp bigint"), f"{label}-sifted")
    release(before)
    wanted = materialize(_met(prints.select("row", "k", "s"), materialize(gathered(rows.select("row").distinct(), n), f"{label}-left"), "row"), f"{label}-wanted")
    sets = read(wanted)
    whole = _met(sets, rows, "row").repartition("key").sortWithinPartitions("key", F.size("set"))
    with batches_of(prints.sparkSession, WIDE_ROWS):
        found = materialize(whole.select("key", "row", "comp", "set").mapInArrow(_forests(patience), "a bigint, b bigint").distinct().transform(gathered, n), f"{label}-links")
    release(keyed, groups, rows, wanted, sets)
    return found


def _several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams rows (token, n, row, comp) sorted by token and n; passes on those of tokens that several components share.

    A token's rows fall apart where sizes part by more than linked sets' can.
    """
    held = None

    def passed(cols: list[np.ndarray]) -> pa.RecordBatch:
        token, n, row, comp = cols
        starts = np.flatnonzero(np.concatenate([[True], (np.diff(token) != 0) | (100 * n[:-1] < PERCENT * n[1:])]))
        sizes = np.diff(np.append(starts, len(token)))
        many = np.minimum.reduceat(comp, starts) < np.maximum.reduceat(comp, starts)
        key = np.repeat(_mixed(token[starts].view(np.uint64) + n[starts].view(np.uint64) * _ODD[4]).view(np.int64), sizes)
        keep = np.repeat(many, sizes)
        return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (key, row, comp, n)], ["key", "row", "comp", "n"])

    for batch in batches:
        new = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("token", "n", "row", "comp")]
        held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
        if not len(held[0]):
            continue
        cut = int(np.searchsorted(held[0], held[0][-1]))  # the last token may go on in the next batch
        if cut:
            yield passed([x[:cut] for x in held])
            held = [x[cut:] for x in held]
    if held is not None and len(held[0]):
        yield passed(held)


def _roots(links: DataFrame) -> DataFrame:
    return materialize(connected_components(links).select(F.col("node").alias("row"), "root"), "roots")


def join(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles (size of its set), component_id."""
    common = common_shingles(docs)
    found = docs.select("doc_id", _identity().alias("k"), _facts(F.col("text"), common, False).alias("x")).withColumn("row", F.monotonically_increasing_id())
    with batches_of(docs.sparkSession, WIDE_ROWS):
        prints = materialize(found.select("row", "doc_id", "k", "x.n", "x.s", "x.bits", "x.keys", F.col("x.set").alias("prefix")), "prints")
    known = prints.where("s IS NOT NULL")
    many = known.count()
    reps = materialize(gathered(known.groupBy("s").agg(F.min("row").alias("row"), F.min("doc_id").alias("least")), many), "reps")
    again = materialize(look_up(known.select("s", F.col("row").alias("this")), reps.select("s", "row"), "s").where("this != row").select(F.col("this").alias("row")), "again")
    sets = _met(known, again, "row", "left_anti")

    def read(wanted: DataFrame) -> DataFrame:
        return _whole_sets(docs, common, wanted)

    first = sets.select(F.explode("keys").alias("key"), "row", F.col("row").alias("comp"), "n")
    links = _links(first, sets, read, "near", PATIENCE)
    roots = _roots(links)
    comp = F.coalesce("root", "row")
    posted = _met(sets.select("row", "n", "prefix"), roots, "row", "left").select(F.explode("prefix").alias("token"), "n", "row", comp.alias("comp"))
    shared = materialize(posted.repartition("token").sortWithinPartitions("token", "n").mapInArrow(_several, "key bigint, row bigint, comp bigint, n bigint"), "shared")
    if not shared.isEmpty():
        one = shared.groupBy("key", "comp").agg(F.min(F.struct("row", "n")).alias("x")).select("key", "comp", "x.row", "x.n")
        more = _links(one, sets, read, "few")
        before, roots = roots, roots if more.isEmpty() else _roots(links.union(more))
        rest = _met(shared.drop("comp"), roots, "row", "left").select("key", "row", comp.alias("comp"), "n")
        last = _links(rest, sets, read, "all")
        if before is not roots:
            release(before)
        if not last.isEmpty():
            before, roots = roots, _roots(links.union(more).union(last))
            release(before)
    named = materialize(_met(reps, roots, "row", "left").select("s", "least", comp.alias("root")), "named")
    least = materialize(gathered(named.groupBy("root").agg(F.min("least").alias("component_id")), many), "least")
    ids = materialize(look_up(named.select("s", "root"), least, "root").select("s", "component_id"), "ids")
    out = look_up(known.select("doc_id", "n", "s"), ids, "s").select("doc_id", "n", "component_id")
    alone = prints.where("s IS NULL").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return out.union(alone).withColumnRenamed("n", "n_shingles")


ORACLE = rf"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), g AS (
  SELECT r, doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {WIDTH} THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - {WIDTH - 2}), lambda i: array_to_string(ws[i:i + {WIDTH - 1}], ' ')) END) AS gs
  FROM w
), t AS (
  SELECT r, unnest(gs) AS k FROM g
), o AS (
  SELECT a.r AS a, b.r AS b, count(*) AS n FROM t a JOIN t b ON a.k = b.k AND a.r < b.r GROUP BY ALL
), l AS (
  SELECT a, b FROM o JOIN g x ON x.r = a JOIN g y ON y.r = b WHERE 100 * n >= {PERCENT} * (len(x.gs) + len(y.gs) - n)
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), reach AS (
  SELECT r AS a, r AS b FROM g UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b
)
SELECT x.doc_id, CAST(len(any_value(x.gs)) AS BIGINT) AS n_shingles, min(y.doc_id) AS component_id
FROM reach JOIN g x ON x.r = reach.a JOIN g y ON y.r = reach.b GROUP BY reach.a, x.doc_id
"""
