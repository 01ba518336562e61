import random

import numpy as np
import xxhash
from tests.llm.conftest import EDGE, make_docs, prose

from weftline.llm import simhash


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps):
    """Smallest member of each fingerprint's component, by comparing all pairs."""
    u = sorted(set(fps))
    up = {f: f for f in u}

    def root(f):
        while up[f] != f:
            f = up[f]
        return f

    for i, a in enumerate(u):
        for b in u[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                up[max(root(a), root(b))] = min(root(a), root(b))
    return {f: root(f) for f in u}


def check(df, rows):
    fps = [plain_fingerprint(t) for _, t, *_ in rows]
    roots = plain_components(fps)
    ids = {}
    for (i, *_), f in zip(rows, fps):
        if i is not None:
            ids[roots[f]] = min(i, ids.get(roots[f], i))
    want = sorted(((i, f"{f:016x}", ids.get(roots[f])) for (i, *_), f in zip(rows, fps)), key=str)
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in df.collect()), key=str)
    assert got == want


def test_edge_rows(spark, edge_docs):
    check(simhash.near_duplicates(edge_docs), EDGE)


def test_empty(spark, empty_docs):
    assert simhash.near_duplicates(empty_docs).collect() == []
    assert simhash.deduplicate(empty_docs).collect() == []


def test_near_copies_against_all_pairs(spark):
    r = random.Random(5)
    rows = []
    for g in range(12):
        base = prose(g, 400).split(" ")
        for k in range(15):
            words = list(base)
            for _ in range(r.choice([0, 0, 1, 2])):
                words[r.randrange(len(words))] = f"w{r.randrange(99)}"
            rows.append((1000 - (g * 15 + k), " ".join(words), "en", "s"))
    docs = make_docs(spark, rows)
    check(simhash.near_duplicates(docs), rows)
    check(simhash.near_duplicates(docs, most_together=3), rows)  # groups beyond the limit are blocked once more
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(x.doc_id for x in kept.collect()) == sorted({x.component_id for x in simhash.near_duplicates(docs).collect()})


def test_links_of_a_dense_group_without_its_pairs(spark):
    """A subcube of 12 free bits: all are linked, by fewer edges than members per key."""
    base = 0x0123456789ABCDEF
    fps = [base ^ sum(((i >> k) & 1) << (5 * k) for k in range(12)) for i in range(4096)]
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    for most in (4096, 100):
        edges = simhash.link(df, most)
        assert edges.count() < 4096 * 80  # of 8 million pairs
        from weftline.llm.graph import connected_components

        assert connected_components(edges).select("root").distinct().count() == 1


def test_components(spark):
    from weftline.llm.graph import connected_components

    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 103), (103, 101), (200, 200)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 103: 100, 200: 200}


def test_dedup_edge_rows(spark, edge_docs):
    kept = [r.doc_id for r in simhash.deduplicate(edge_docs).collect()]
    assert kept.count(1) == 1 and kept.count(7) == 0 and kept.count(2) == 1 and 3 not in kept
    assert kept.count(None) == 1  # the one with a text of its own


def test_components_in_few_rounds(spark, monkeypatch):
    from weftline.llm import graph

    written = []
    monkeypatch.setattr(graph, "materialize", lambda df, label, keep=graph.materialize: written.append(keep(df, label)) or written[-1])
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(300)] + [(500 + r.randrange(300), 500 + r.randrange(300)) for _ in range(200)] + [(900, 900), (0, 0)]
    r.shuffle(edges)
    least = {x: x for e in edges for x in e}
    for _ in edges:
        before = dict(least)
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
        if least == before:
            break
    for at_once in (1 << 20, 7):
        monkeypatch.setattr(graph, "EDGES_AT_ONCE", at_once)
        written.clear()
        out = graph.connected_components(spark.createDataFrame(edges, "a long, b long").coalesce(1))
        assert {x.node: x.root for x in out.collect()} == least and out.count() == len(least)
        assert at_once == 7 or len(written) == 2  # what is left of the edges, and their nearest neighbours


def test_clusters_of_few_rows_are_written_by_few_tasks(spark):
    from weftline import session

    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    written = len(session._written)
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        prints = spark.createDataFrame([(i, i % 8 << 40 | 1 << i % 3) for i in range(400)], "t long, fp long")
        roots = {x.fp: x.root for x in simhash.clusters(prints).collect()}
        files = [spark.read.parquet(p).inputFiles() for _, p in session._written[written:] if "-pairs-" in p or "-nearest-" in p]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(roots) == 24 and set(roots.values()) == {1}
    assert len(files) >= 2 and all(len(f) <= spark.sparkContext.defaultParallelism for f in files)
