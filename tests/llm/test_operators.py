"""Token counts, WARC, line rules, packing, top-k, the pipeline: brute force, round trips, defined results."""

import gzip
import io
import os
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from tests.llm.conftest import EDGE, make_docs, prose

from weftline.llm import packing, rules, tokens, topk, warc
from weftline.session import scratch_path

# tokens


def plain_best(scores, word, unknown):
    """Best segmentations by plain dynamic programming over starts, as the tokenizer goes."""
    best, n = [(0.0, 0)] + [None] * len(word), len(word)
    for i in range(n):
        single = False
        for j in range(i + 1, n + 1):
            if word[i:j] in scores:
                single |= j == i + 1
                s = best[i][0] + scores[word[i:j]]
                if best[j] is None or s > best[j][0]:
                    best[j] = s, best[i][1] + 1
        if not single:
            s = best[i][0] + unknown
            if best[i + 1] is None or s > best[i + 1][0]:
                best[i + 1] = s, best[i][1] + len(word[i].encode())
    return best[n][1]


def test_counts_with_many_ties():
    r = random.Random(1)
    scores = {"▁": -1.0, "a": -2.0, "b": -2.0, "ab": -4.0, "ba": -3.0, "aab": -5.0, "▁a": -3.0, "bb": -4.0}
    c = tokens.Counter(scores)
    words = ["".join(r.choice("abcé") for _ in range(r.randint(1, 12))) for _ in range(500)] + ["ab" * 100]
    want = [plain_best(scores, "▁" + w, c.unknown) for w in words]
    assert [c.count(w) for w in words] == want
    assert c.count_all(words) == want


@pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no public vocabulary here")
def test_counts_equal_a_tokenizer_library(spark, edge_docs):
    from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

    import sentencepiece

    scores = tokens.load()
    model = sentencepiece.SentencePieceProcessor(model_file=tokens.VOCABULARY)
    marks = [(model.id_to_piece(i), float(model.get_score(i))) for i in range(model.get_piece_size()) if model.is_byte(i)]  # what unknown letters fall back on
    t = Tokenizer(models.Unigram([("<unk>", 0.0), *scores.items(), *marks], 0, True))
    t.normalizer = normalizers.Replace(" ", "▁")
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    texts = ["", " ", "  a b", "a\nb c", "▁x▁▁y", "hello world  ", "isn't it 1,000?", prose(3, 300), *[x for _, x, *_ in EDGE if x]]
    assert tokens.counter(scores)()(texts).to_pylist() == [len(t.encode(x).ids) for x in texts]
    assert not {p for p, _ in marks} & set(scores) and tokens.counter(scores)()(["<0x41>"]).to_pylist()[0] > 1  # a byte's name is plain text
    got = {r.doc_id: r.n_tokens for r in tokens.count_tokens(edge_docs).collect()}
    assert got[2] == 0 and got[3] == 0 and got[9] == len(t.encode("x" * 50_000).ids)


# WARC


def test_warc_round_trip(spark):
    big = "".join(random.Random(0).choice("0123456789abcdef") for _ in range(300_000))
    rows = [(1, "http://a/b c", "same"), (2, None, "same"), (3, "u", None), (4, "u", ""), (5, "é\nx", big), (6, "u", "ünï\x00\r\n\r\nWARC/1.1"), (None, "u", "same"), (1, "again", "same"), (None, "u", "alone")]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, payload string, hash int")
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect())
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        to = first.get(h or "")
        revisit = to is not None and i != to
        want.append((str(i), len(data), warc.base32_sha1(data), "revisit" if revisit else "response", to if revisit else None))
    assert got == sorted(want)
    assert [r.record_type for r in warc.round_trip(pages, least_bytes=5).where("page_id = 2").collect()] == ["response"]
    assert warc.round_trip(pages.limit(0)).collect() == []


def test_archives_are_plain_gzip_members(spark):
    pages = spark.createDataFrame([(i, "u", f"text {i}") for i in range(20)], "page_id long, url string, html string")
    path = scratch_path(spark, "w")
    warc.write(pages.coalesce(1), path)
    seen = 0
    for f in os.listdir(path):
        if f.startswith("part-"):
            data = open(f"{path}/{f}", "rb").read()
            assert gzip.decompress(data).count(b"WARC/1.1\r\n") == len(list(warc.read_records(io.BytesIO(data))))
            for head, n, digest, payload in warc.read_records(io.BytesIO(data), keep_payload=True):
                assert head["warc-type"] == "response" and n == len(payload) and digest == warc.base32_sha1(payload)
                seen += 1
    assert seen == 20


def test_reader_finds_damage():
    good = warc.make_record(1, "u", b"payload" * 1000, None)
    assert [n for _, n, _, _ in warc.read_records(io.BytesIO(good * 3))] == [7000] * 3
    text = gzip.decompress(good)
    for bad in (text.replace(b"payloadp", b"payloadq", 1), text.replace(b"Content-Length: 70", b"Content-Length: 69"), text[:-2], text + b"x", text.replace(b"WARC/1.1", b"HTTP/1.1", 1)):
        with pytest.raises(warc.BadArchive):
            list(warc.read_records(io.BytesIO(gzip.compress(bad))))
    with pytest.raises(warc.BadArchive):
        list(warc.read_records(io.BytesIO(good[:-30])))
    huge = warc.make_record(1, "u", bytes(17 << 20), None)
    assert huge[-1] == 0 and [n for _, n, _, _ in warc.read_records(io.BytesIO(huge))] == [17 << 20]


# line rules


def test_rules_against_sql_and_edges(spark, edge_docs, empty_docs):
    rows = [(i, "\n".join([f"Shared  line {i % 10} of many words here", prose(i, 60)] + ["again and again a b c d e f g h i"] * (i % 3)), "en", "h" if i % 4 else "k") for i in range(200, 320)]
    docs = make_docs(spark, rows).union(edge_docs)
    got = rules.judge(docs)
    c = duckdb.connect()
    documents = docs.select("doc_id", "text", "source").toArrow()  # noqa: F841
    want = c.execute(rules.ORACLE)
    names = [d[0] for d in want.description]
    assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r[n] for n in names)) for r in got.collect())
    assert got.where("words_removed > 0").count() > 50
    assert rules.judge(empty_docs).collect() == []
    null = got.where("doc_id = 2").first()
    assert (null.n_words, null.base_failed, null.kept) == (0, True, False)


def plain_repeats(words):
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = set()
    for i in range(len(words) - 7):
        if seen[tuple(words[i : i + 8])] > 1:
            hit |= set(range(i, i + 8))
    return len(hit)


def test_repeated_words(spark):
    r = random.Random(4)
    rows = [(i, " ".join(r.choice("ab") for _ in range(r.randint(0, 60))), "en", "s") for i in range(80)]
    got = {x.doc_id: x.n_repeat_words for x in rules.judge(make_docs(spark, rows)).collect()}
    assert got == {i: plain_repeats(t.split()) for i, t, *_ in rows}


# packing


def plain_best_fit(items, capacity):
    bins, out = [], []
    for n, s, c in items:
        fit = [(b["room"], i) for i, b in enumerate(bins) if b["room"] >= n and (s is None or s not in b["s"]) and (c is None or c not in b["c"])]
        i = min(fit)[1] if fit else len(bins)
        if not fit:
            bins.append({"room": capacity, "s": set(), "c": set()})
        bins[i]["room"] -= n
        bins[i]["s"].add(s)
        bins[i]["c"].add(c)
        out.append(i)
    return out


def test_best_fit_against_trying_all_bins():
    for seed in range(20):
        r = random.Random(seed)
        items = [(r.randint(0, 50), r.choice(["a", "a", "a", "b", "c", None]), r.choice([1, 2, 3, 4, None])) for _ in range(150)]
        items.sort(key=lambda x: -x[0])
        assert packing.best_fit(items, 50) == plain_best_fit(items, 50)


def test_packing(spark, edge_docs, empty_docs):
    rows = packing.pack(edge_docs, capacity=100, shard_rows=5).collect()
    sizes, sources = Counter(), Counter()
    words = {}
    by_id = {i: s for i, _, _, s in EDGE if i is not None}
    for x in rows:
        sizes[x.bin_id] += x.n_words
        words[x.doc_id] = words.get(x.doc_id, 0) + x.n_words
        if by_id.get(x.doc_id):
            sources[x.bin_id, by_id[x.doc_id]] += 1
    assert max(sizes.values()) <= 100 and max(sources.values()) == 1
    assert words[8] == len(EDGE[8][1].split()) and words[2] == 0 and words[9] == 1
    assert sum(x.part == 0 for x in rows) == len(EDGE)
    assert packing.pack(empty_docs).collect() == []


# top-k


def plain_topk(rows, k=10):
    good = [(i, [int(np.floor(1024 * float(v))) for v in e]) for i, e in rows if i is not None and e is not None and all(v is not None and np.isfinite(v) for v in e)]
    out = []
    for i, q in good:
        if i % 100 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, e)), j) for j, e in good if j != i)[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored)]
    return sorted(out)


def test_topk_against_all_pairs(spark):
    r = np.random.default_rng(0)
    rows = [(i, [float(x) for x in np.round(r.normal(0, 1, 6), 1)]) for i in range(700)]  # many ties
    rows += [(800, None), (900, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1000, [float("nan")] * 6), (1100, [float("inf")] + [0.0] * 5), (None, [1.0] * 6), (1200, [0.0] * 6), (1300, [1e30] + [0.0] * 5)]
    df = spark.createDataFrame([(i, e, 7, 8) for i, e in rows if i != 1300], "vec_id long, embedding array<double>, label int, b int")
    want = plain_topk([x for x in rows if x[0] != 1300])
    for blocks, queries in ((2048, 1024), (50, 3)):
        got = sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in topk.search(df, block_rows=blocks, query_rows=queries).collect())
        assert got == want
    assert topk.search(df.limit(0)).collect() == []
    big = spark.createDataFrame([(0, [1e30, 1.0]), (1, [1e30, 0.0]), (2, [1.0])], "vec_id long, embedding array<double>")
    assert [(x.vec_id, x.score) for x in topk.search(big).orderBy("rank").collect()] == [(1, 2**63 - 1), (2, 2**63 - 1)]


def test_threshold_stops_early():
    x = np.random.default_rng(0).integers(-1000, 1000, (3000, 2)).astype(float)
    lists = topk.Lists(x / topk.SCALE, np.arange(3000), False)
    q = np.array([900.0, -800.0])
    scores, ids = lists.top(q, -1)
    want = np.lexsort((np.arange(3000), -(x @ q)))[:10]
    assert list(ids) == list(want) and list(scores) == list((x @ q)[want])


# all together


def test_pipeline(spark, edge_labels, tmp_path):
    import corpus_pipeline
    from weftline.llm.queries import QUERIES

    r = random.Random(9)
    rows = [(i, prose(i, 80, "abcdefg" if i % 2 else "opqrstu"), "xx" if i % 2 else "yy", f"s{i % 5}") for i in range(20, 170)]
    rows += [(1000 + i, rows[i][1], rows[i][2], rows[i][3]) for i in range(10)] + EDGE
    rows += [(2000 + i, prose(500 + i, 60) + " zorgle zorgling" * r.randint(1, 3), "xx", "s1") for i in range(60)]
    labels = [(i, 1, int(i is not None and i >= 2000)) for i, *_ in rows] + [(None, None, None)]
    make_docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path))
        path = scratch_path(spark, "stage")
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
    ids = [x.doc_id for x in docs.collect()]
    assert len(ids) - ids.count(None) == len(set(ids) - {None}) and not any(i is not None and i >= 1000 for i in ids)
    assert set(range(20, 170)) <= set(ids)
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["bin_id", "slot", "doc_id", "part", "n_words"] and out.count() > 100
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
