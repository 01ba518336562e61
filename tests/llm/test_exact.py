"""Large ids, long words, huge components, hot keys, bounded archives, closest mixtures: against plain versions."""

import io
import os
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.conftest import EDGE, make_docs, prose
from tests.llm.test_operators import plain_best_fit, plain_topk

from weftline.llm import common, langid, mixing, packing, simhash, tokens, topk, warc
from weftline.llm.common import look_up, unused
from weftline.session import materialize, scratch_path

BIG = 2**60


def test_packing_query_against_trying_all_bins(spark):
    """Ids beyond doubles, null ids, texts, sources and clusters, cut documents: the whole placement, by brute force."""
    r = random.Random(3)
    rows = [(BIG + 2 * i + 1, " ".join("w" * r.randint(1, 9) for _ in range(r.randint(0, 90))), r.choice(["a", "b", "c", None]), BIG + r.randint(0, 9) if i % 3 else None) for i in range(60)]
    rows += [(None, None, "a", None), (BIG, "w " * 250, None, None), (None, "x y", "b", BIG + 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, c long")
    got = sorted(((x.bin_id, x.slot), x.doc_id, x.part, x.n_words) for x in packing.pack(df, capacity=100, cluster=F.col("c")).collect())
    ties = {(x.doc_id, x.text): x.h for x in df.select("doc_id", "text", F.xxhash64("text", "source").alias("h")).collect()}
    parts = []
    for i, t, s, c in rows:
        n = len((t or "").split())
        full, rest = divmod(n, 100)
        sizes = [100] * full + ([rest] if rest or not full else [])
        parts += [(-size, i is None, i or 0, ties[i, t], k, i, s, None if t is None else c) for k, size in enumerate(sizes)]
    parts.sort(key=lambda p: p[:5])
    bins = plain_best_fit([(-p[0], p[6], p[7]) for p in parts], 100)
    slots: Counter = Counter()
    want = []
    for p, b in zip(parts, bins):
        want.append(((b, slots[b]), p[5], p[4], -p[0]))
        slots[b] += 1
    assert got == sorted(want)
    assert {x[1] for x in got} == {x[0] for x in rows}
    placed = packing.pack(df, capacity=100, cluster=F.col("c"))
    taken, least = packing.least_bins(placed, "n_words", 100)
    assert least <= taken == len(set(bins))


def test_equal_rows_fill_several_shards_fast(spark):
    """A third and more of all rows may be copies of one: no task gets them all, and none tries all bins for each."""
    n = 200_000
    docs = spark.range(n).select(F.lit(7).cast("long").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("s").alias("source"))
    placed = materialize(packing.pack(docs, cluster=F.lit(1)), "placed")
    assert placed.count() == placed.select("bin_id").distinct().count() == n
    sizes = [x["count"] for x in placed.groupBy(F.floor(F.col("bin_id") / 2**32)).count().collect()]
    assert len(sizes) == -(-n // packing.SHARD_ROWS) and max(sizes) < 2 * packing.SHARD_ROWS
    began = time.perf_counter()
    assert packing.best_fit([(3, "s", 1)] * 40_000, 2048) == list(range(40_000))
    assert time.perf_counter() - began < 20


def test_copies_among_others_against_trying_all_bins():
    r = random.Random(4)
    for capacity in (1, 7, 64, 2048):
        items = [(r.randint(0, capacity), r.choice(["a", "b", None]), 1) for _ in range(100)] + [(r.randint(0, capacity), r.choice("abcdef"), r.choice([1, 2, None])) for _ in range(200)]
        items.sort(key=lambda x: -x[0])
        assert packing.best_fit(items, capacity) == plain_best_fit(items, capacity)


def test_packing_keeps_near_copies_of_large_ids_apart(spark):
    text = prose(1, 300)
    docs = make_docs(spark, [(BIG + 1, text, "en", "a"), (BIG + 3, text.replace("a", "A", 1), "en", "b"), (None, "other words here", "en", "c"), (5, None, None, None)])
    got = packing.pack(docs).collect()
    assert sorted((x.doc_id for x in got), key=str) == sorted([BIG + 1, BIG + 3, None, 5], key=str)
    bins = {x.doc_id: x.bin_id for x in got}
    assert bins[BIG + 1] != bins[BIG + 3]


def test_packing_by_tokens(spark):
    docs = make_docs(spark, [(i, prose(i, 30), "en", f"s{i}") for i in range(6)])
    want = {x.doc_id: x.n_tokens for x in tokens.count_tokens(docs).collect()}
    assert {x.doc_id: x.n_tokens for x in packing.pack(docs, length=tokens.length(), name="n_tokens").collect()} == want


def plain_logs(pieces, p, word, k):
    """Log probability of a word in one language, by sums of logarithms position by position."""
    word = "▁" + word
    held = [0.0] + [-np.inf] * len(word)
    for i in range(1, len(word) + 1):
        ways = [held[i - 1] + np.log(p[-1, k])]
        ways += [held[i - len(x)] + np.log(p[j, k]) for j, x in enumerate(pieces) if i >= len(x) and word[i - len(x) : i] == x]
        held[i] = np.logaddexp.reduce(ways)
    return held[-1]


def test_long_words_sum_all_segmentations():
    pieces = ["▁a", "▁ab", "b", "bc", "c", "▁", "a", "abca"]
    automaton, lengths = langid.build_automaton(pieces)
    p = np.random.default_rng(1).random((len(pieces) + 1, 2)) / 5
    p[-1] = langid.UNKNOWN
    r = random.Random(0)
    words = ["".join(r.choice("abcz") for _ in range(n)) for n in (1, 5, 24, 25, 28, 29, 100, 10_000)] + ["z" * 28, "z" * 3000]
    got = langid.word_logs(automaton, lengths, words, p)
    np.testing.assert_allclose(got, [[plain_logs(pieces, p, w, k) for k in (0, 1)] for w in words], rtol=1e-9)
    short = [w for w in words if len(w) <= langid.SHORT]  # both ways agree
    np.testing.assert_allclose([langid.LongWord(automaton, lengths, w).forward(p)[-1] for w in short], langid.word_logs(automaton, lengths, short, p), rtol=1e-9)
    for w in words[:7]:
        x = langid.LongWord(automaton, lengths, w)
        np.testing.assert_allclose(x.forward(p)[-1], x.backward(p)[0], rtol=1e-9)


def test_scripts_without_spaces(spark):
    """Lines of many letters without spaces, learnt from and told apart."""
    r = random.Random(4)
    line = lambda letters: "".join(r.choice(letters) for _ in range(r.randint(30, 90)))
    rows = [(i, "\n".join(line("日本語文字処理" if i % 2 else "中国汉字处理法") for _ in range(4)), "ja" if i % 2 else "zh", "s") for i in range(120)]
    got = langid.identify(make_docs(spark, rows)).collect()
    assert np.mean([x.lang_pred == ("ja" if x.doc_id % 2 else "zh") for x in got if x.held_out]) > 0.95


def test_language_query_against_plain_sums(spark):
    """The whole query: learnt counts, forward sums, the posterior, by plain Python on the same pieces."""
    rows = [(i, prose(i, 12, "abcdefg" if i % 2 else "opqrstu") + " " + ("ab" if i % 2 else "op") * 20, "xx" if i % 2 else "yy", "s") for i in range(40)]
    docs = make_docs(spark, rows)
    pieces = langid.vocabulary()
    langs, p = langid.fit(langid.training_counts(docs), pieces)
    places = {x: j for j, x in enumerate(pieces)}
    longest = max(map(len, pieces))

    def logs(word, k):
        word = "▁" + word
        held = [0.0]
        for i in range(1, len(word) + 1):
            ways = [held[i - 1] + np.log(p[-1, k])]
            ways += [held[j] + np.log(p[places[word[j:i]], k]) for j in range(max(0, i - longest), i) if word[j:i] in places]
            held.append(np.logaddexp.reduce(ways))
        return held[-1]

    got = {x.doc_id: x for x in langid.identify(docs).collect()}
    for i, text, *_ in rows[:12]:
        sums = np.array([sum(logs(w, k) for w in langid.words_of(text)) for k in range(len(langs))])
        assert got[i].lang_pred == langs[int(sums.argmax())]
        np.testing.assert_allclose(got[i].score, 1 / np.exp(sums - sums.max()).sum(), rtol=1e-6)


def test_repeated_ids_are_learnt_from_once(spark):
    rows = [(1, "alpha beta", "xx", "s"), (1, "alpha beta", "xx", "s"), (1, "gamma", "xx", "s"), (2, "delta", "yy", "s")]
    counts = langid.training_counts(make_docs(spark, rows))
    assert sum(sum(c.values()) for c in counts.values()) in (2, 3)


def test_topk_of_huge_and_mixed_components(spark):
    r = np.random.default_rng(5)
    rows = [(i, [float(x) for x in r.normal(0, 1, 4) * 10.0 ** r.integers(-300, 16, 4)]) for i in range(250)]
    rows += [(1000, [1e308, -1e308, 1e-308, 1.0]), (1100, [-1.7e308, 1.0, 2.0, 3.0]), (1101, [1e308, 1e308, 0.5, -0.5]), (1200, [2.0**52 + 1, 0.3, -0.3, 0.0]), (1300, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    cut = lambda s: max(-(2**63), min(2**63 - 1, s))
    for block in (None, 40):
        got = sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in topk.search(df, block_rows=block, query_rows=block).collect())
        by_query: dict = {}
        for q, _, v, s in got:
            by_query.setdefault(q, []).append((s, v))
        exact = [(i, [int(v) * 1024 if abs(v) >= 2**52 else int(np.floor(1024 * v)) for v in (*e, 0.0, 0.0, 0.0, 0.0)[:4]]) for i, e in rows]
        for i, q in exact:
            if i % 100 == 0:
                scored = sorted((-cut(sum(a * b for a, b in zip(q, e))), j) for j, e in exact if j != i)[:10]
                assert sorted(by_query[i]) == sorted((-s, j) for s, j in scored)
    small = [(i, e) for i, e in rows if i < 250 and max(map(abs, e)) < 1e6]
    got = sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in topk.search(spark.createDataFrame(small, "vec_id long, embedding array<double>")).collect())
    assert got == plain_topk(small)


def test_topk_of_very_different_widths(spark, monkeypatch):
    """A vector of many components among short ones makes no block of them all as wide."""
    r = np.random.default_rng(6)
    rows = [(i, [float(x) for x in r.normal(0, 1, w)]) for i, w in enumerate([4] * 300 + [0, 1, 7, 4000, 9] + [5] * 99)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(topk, "BLOCK_COMPONENTS", 512)
    plain = topk.padded
    got = sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in topk.search(df).collect())
    wide = [(i, e + [0.0] * (4000 - len(e))) for i, e in rows]
    assert got == plain_topk(wide)
    import pyarrow as pa

    column = pa.chunked_array([pa.array([[1.0, 2.0, 3.0], [], [4.0]], pa.list_(pa.float64()))])
    assert plain(column, 2).tolist() == [[1, 2], [0, 0], [4, 0]] and plain(column, 4).tolist() == [[1, 2, 3, 0], [0] * 4, [4, 0, 0, 0]]


def test_portions_are_bounded_by_letters():
    texts = ["a" * 10, None, "b" * 95, "c" * 300, "", "d" * 5] + ["e"] * 10
    got = list(common.portions(texts, 4, 100))
    assert [x for a, b in got for x in texts[a:b]] == texts
    assert all(b - a <= 4 and (b - a == 1 or sum(len(t or "") for t in texts[a:b]) <= 100) for a, b in got)
    assert list(common.portions([], 4, 100)) == []


def test_look_up_of_hot_keys(spark):
    keys = [1] * 700 + [2] * 300 + list(range(10, 300)) + [None] * 40
    rows = materialize(spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i long, k long"), "t")
    facts = spark.createDataFrame([(k, k * 2, None) for k in range(0, 200)], "k long, v long, w string")
    got = {x.i: x.v for x in look_up(rows, facts, "k").collect()}
    assert got == {i: (k * 2 if k is not None and k < 200 else None) for i, k in enumerate(keys)}
    assert look_up(rows.limit(0), facts, "k").columns == ["i", "k", "v", "w"]
    assert unused("__K", ["__k", "__k_"]) == "__K__"


@pytest.mark.parametrize("few", [2_000_000, 0])
def test_dedup_by_broadcast_and_by_join(spark, edge_docs, few):
    rows = [(i, prose(i // 3, 80), "en", "s") for i in range(60)] + [(0, prose(0, 80), "en", "s")] * 3
    docs = make_docs(spark, rows).union(edge_docs).withColumn("__k", F.lit(5)).withColumn("a.b", F.lit(6))
    kept = simhash.deduplicate(docs, few)
    assert kept.columns == docs.columns
    found = kept.collect()
    ids = [x.doc_id for x in found]
    assert sorted(i for i in ids if i is not None and 10 < i < 60) == list(range(12, 60, 3)) and ids.count(0) == 1
    assert {x["__k"] for x in found} == {5} and {x["a.b"] for x in found} == {6}
    assert simhash.deduplicate(docs.limit(0), few).collect() == []


def test_archives_are_bounded_in_bytes(spark):
    r = random.Random(1)
    rows = [(i, "u", "".join(r.choice("0123456789abcdef") for _ in range(20_000))) for i in range(40)]
    rows.append((99, "u", "".join(r.choice("0123456789abcdef") for _ in range(300_000))))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    path = scratch_path(spark, "w")
    warc.write(pages, path, file_bytes=50_000)
    sizes = [os.path.getsize(f"{path}/{f}") for f in os.listdir(path) if f.startswith("part-")]
    assert len(sizes) > 8 and sum(s > 65_000 for s in sizes) == 1  # only the record that is larger by itself
    assert sorted(x.page_id for x in warc.read(spark, path).collect()) == sorted(x[0] for x in rows)


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_revisits_by_broadcast_and_by_join(spark, few):
    pages = spark.createDataFrame([(i, "u", f"text {i % 7}" if i % 3 else None) for i in range(60)], "page_id long, url string, html string")
    path = scratch_path(spark, "w")
    warc.write(pages, path, most_broadcast=few)
    got = warc.read(spark, path)
    warc.check_revisits(got)
    least: dict = {}
    for i in range(59, -1, -1):
        least[i % 7 if i % 3 else None] = i
    assert {x.page_id: x.refers_to for x in got.collect()} == {i: None if least[i % 7 if i % 3 else None] == i else least[i % 7 if i % 3 else None] for i in range(60)}


def test_revisits_are_checked_against_what_was_read(spark):
    kinds = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    good = [(1, 4, "A", "response", None), (2, 4, "A", "revisit", 1)]
    warc.check_revisits(spark.createDataFrame(good, kinds))
    for bad in ([(2, 5, "A", "revisit", 1)], [(2, 4, "B", "revisit", 1)], [(2, 4, "A", "revisit", 7)]):
        with pytest.raises(warc.BadArchive):
            warc.check_revisits(spark.createDataFrame([good[0], *bad], kinds))
    assert len(list(warc.read_records(io.BytesIO(warc.make_record(1, "u", b"x", None))))) == 1


def plain_closest(p, n, goal, most):
    """Least squares with the pull, by many plain projected-gradient steps over all rates, each with its momentum."""
    a = (p * n[:, None]).T / n.sum()
    w, pull = n / n.sum(), mixing.PULL
    long = np.linalg.eigvalsh(a @ p)[-1] + pull
    r = ahead = np.ones(len(n))
    for k in range(200_000):
        slope = p @ (a @ ahead - goal) + pull * (ahead - 1)
        new = np.clip(ahead - slope / long, 0, most)
        if slope @ (w * (new - r)) > 0:
            ahead = r = new
        else:
            ahead, r = new + k / (k + 3) * (new - r), new
    off = a @ r - goal
    return (off @ off + pull * (w @ (r - 1) ** 2)) / 2


def test_mixture_ends_at_the_closest_totals(spark):
    """On targets within reach and out of it."""
    r = np.random.default_rng(2)
    for alpha, goal in (([2, 1, 0.5], [0.5, 0.3, 0.2]), ([9, 8, 0.2], [0.05, 0.05, 0.9]), ([5, 5, 5], [0.98, 0.01, 0.01])):
        p, n = r.dirichlet(alpha, 80), r.integers(0, 300, 80)
        if goal[0] == 0.98:
            p = p * 0.4 + 0.2  # no document is mostly of one domain
        p = p / p.sum(1, keepdims=True)
        soft = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p)], "n long, p array<double>")
        for most in (mixing.MOST_RATE, 2.0):
            fitted = mixing.fit_rates(soft, dict(zip("abc", goal)), most=most)
            rates = mixing.rate_of(p, n, fitted.u, most)
            np.testing.assert_allclose((rates * n) @ p / n.sum() - goal, fitted.off, atol=1e-9)
            loss = (fitted.off @ fitted.off + mixing.PULL * (n @ (rates - 1) ** 2) / n.sum()) / 2
            assert loss <= plain_closest(p, n.astype(float), np.array(goal), most) * 1.001 + 1e-9


def test_mixing_query_against_plain_rates(spark, edge_docs, edge_labels):
    """The whole query: posteriors by the model on each text, rates by replayed steps, copies by the draw."""
    docs = edge_docs.union(make_docs(spark, [(100 + i, prose(i, 40), "en", "s") for i in range(50)]))
    model = mixing.train(docs, edge_labels)
    got = mixing.rates(docs, edge_labels).collect()
    texts = {i: t for i, t, *_ in EDGE} | {100 + i: prose(i, 40) for i in range(50)}
    for x in got:
        if x.doc_id is None:
            continue
        n, form, found = mixing.examine(texts[x.doc_id], mixing.Buckets())
        assert x.n_words == n == len((texts[x.doc_id] or "").split())
        np.testing.assert_allclose([x.domains[d] for d in mixing.DOMAINS], model.posterior(form, found), atol=1e-9)
        assert x.copies in (int(x.rate), int(x.rate) + 1)
