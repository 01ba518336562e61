"""Language, quality, toxicity, mixing: held-out accuracy, brute force, defined results."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.conftest import EDGE, make_docs, prose

from weftline.llm import langid, mixing, quality, toxicity


def test_forward_sums_all_segmentations():
    pieces = ["▁a", "▁ab", "b", "bc", "c", "▁", "a"]
    automaton, lengths = langid.build_automaton(pieces)
    p = np.random.default_rng(1).random((len(pieces) + 1, 2)) / 5
    p[-1] = langid.UNKNOWN

    def total(word, k):
        if not word:
            return 1.0
        out = p[-1, k] * total(word[1:], k)
        return out + sum(p[i, k] * total(word[len(x) :], k) for i, x in enumerate(pieces) if word.startswith(x))

    words = ["abc", "a", "cab", "zzb"]
    lattice = langid.Lattice(automaton, lengths, words)
    got, back = lattice.forward(p)[lattice.finish], lattice.backward(p)[lattice.begin]
    want = np.array([[total("▁" + w, k) for k in (0, 1)] for w in words])
    np.testing.assert_allclose(got, want)
    np.testing.assert_allclose(back, want)


def languages(spark, n=240):
    rows = [(i, prose(i, 40, "abcdefg" if i % 2 else "opqrstu"), "xx" if i % 2 else "yy", f"s{i % 3}") for i in range(n)]
    return make_docs(spark, rows)


def test_language_held_out(spark):
    got = langid.identify(languages(spark)).collect()
    assert len(got) == 240
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1
    assert np.mean([r.lang_pred == ("xx" if r.doc_id % 2 else "yy") for r in got if r.held_out]) > 0.95


def test_language_edges(spark, edge_docs, empty_docs):
    got = langid.identify(edge_docs).collect()
    assert len(got) == len(EDGE)
    by = {r.doc_id: r for r in got}
    for i in (2, 3, 4, 6):
        assert by[i].lang_pred == "und" and by[i].score == 0
    assert all(r.lang_pred in ("en", "de", "und") for r in got)
    assert langid.identify(empty_docs).collect() == []
    assert {r.lang_pred for r in langid.identify(edge_docs.withColumn("lang", edge_docs["lang"].substr(0, 0)).where("false")).collect()} == set()


def test_additive_tables_sum_to_the_score():
    r = np.random.default_rng(0)
    x = r.random((800, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x, y)
    assert np.mean((model.scores(x) > 0.5) == y) > 0.95  # only a pair can tell
    z = model.intercept
    for j, (e, t) in enumerate(zip(model.edges, model.tables)):
        z += t[sum(v <= x[7, j] for v in e)]
    for (i, j), t in zip(model.pairs, model.pair_tables):
        z += t[sum(v <= x[7, i] for v in model.pair_edges[i]), sum(v <= x[7, j] for v in model.pair_edges[j])]
    assert abs(z - model.logits(x)[7]) < 1e-9


def test_quality_held_out(spark):
    rows = [(i, prose(i, 60) if i % 3 else " ".join(w + "###" for w in prose(i, 60).split()), "en", "s") for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(400)], "doc_id long, quality int, toxic int")
    got = quality.score_documents(make_docs(spark, rows), labels).collect()
    assert np.mean([r.predicted == int(r.doc_id % 3 > 0) for r in got if r.held_out]) > 0.95
    assert all(r.predicted == int(r.score >= 0.3) for r in got)


def test_quality_edges(spark, edge_docs, empty_docs, edge_labels):
    got = quality.score_documents(edge_docs, edge_labels).collect()
    assert len(got) == len(EDGE) and all(0 <= r.score <= 1 for r in got)
    assert quality.score_documents(empty_docs, edge_labels).collect() == []
    assert {r.score for r in quality.score_documents(edge_docs, edge_labels.limit(0)).collect()} == {0.5}


def plain_marginals(d, start, move):
    """By summing over all label sequences."""
    n, out, total = len(d), np.zeros(len(d)), 0.0
    for code in range(2**n):
        y = [code >> i & 1 for i in range(n)]
        s = sum(v for v, k in zip(d, y) if k) + start * y[0] + sum(move[a, b] for a, b in zip(y, y[1:]))
        total += np.exp(s)
        out += np.exp(s) * np.array(y)
    return out / total


def test_marginals_against_enumeration():
    r = np.random.default_rng(3)
    sizes = np.array([9, 0, 1, 11, 4])
    d = r.normal(0, 2, sizes.sum())
    start, move = 0.3, r.normal(0, 1, (2, 2))
    ends = np.cumsum(sizes)
    for block in (3, 4, 32):
        p = toxicity.marginals(d, sizes, start, move, block)
        for n, e in zip(sizes, ends):
            if n:
                np.testing.assert_allclose(p[e - n : e], plain_marginals(d[e - n : e], start, move), atol=1e-9)


def plain_loss(field, sizes, tokens, labels, features):
    """Negative log-likelihood, by summing over all label sequences."""
    d, out, at = field.odds(features)[tokens], 0.0, 0
    for n in sizes:
        x, y = d[at : at + n], labels[at : at + n]
        score = lambda y: sum(v for v, k in zip(x, y) if k) + field.start * y[0] + sum(field.move[a, b] for a, b in zip(y, y[1:]))  # noqa: B023, E731
        if n:
            out += np.logaddexp.reduce([score([c >> i & 1 for i in range(n)]) for c in range(2**n)]) - score(y)
        at += n
    return out


def test_slopes_against_differences():
    r = np.random.default_rng(4)
    sizes, words = np.array([6, 0, 1, 9]), ["ab", "abc", "zorgle", "", "b"]
    tokens, labels = r.integers(0, 5, 16), r.integers(0, 2, 16)
    features = toxicity.buckets(words)
    weights = np.zeros(toxicity.BUCKETS)
    weights[np.unique(features)] = r.normal(0, 0.5, len(np.unique(features)))
    field = toxicity.Field(weights, -0.3, 0.4, r.normal(0, 1, (2, 2)))
    w, rest = toxicity.slopes(field, sizes, tokens, labels, features)
    h = 1e-5

    def moved(i=None, j=None, by=0.0):
        new = toxicity.Field(field.weights.copy(), field.bias, field.start, field.move.copy())
        if i is not None:
            new.weights[i] += by
        elif j == 0:
            new.bias += by
        elif j == 1:
            new.start += by
        else:
            new.move[divmod(j - 2, 2)] += by
        return plain_loss(new, sizes, tokens, labels, features)

    for i in np.unique(features)[::3]:
        np.testing.assert_allclose(w[i], (moved(i, by=h) - moved(i, by=-h)) / (2 * h), atol=1e-5)
    for j in range(6):
        np.testing.assert_allclose(rest[j], (moved(j=j, by=h) - moved(j=j, by=-h)) / (2 * h), atol=1e-5)


def test_toxicity_query_against_enumeration(spark):
    """The whole query on short texts: marginals by all label sequences, then the logistic score."""
    rows = [(i, " ".join(["zorgle" if i % 4 == 0 and k == 2 else f"w{(i * 7 + k) % 23}" for k in range(2 + i % 7)]), "en", "s") for i in range(400)]
    docs = make_docs(spark, rows + [(1000, "", "en", "s"), (1001, None, "en", "s")])
    labels = spark.createDataFrame([(i, 1, int("zorgle" in t)) for i, t, *_ in rows], "doc_id long, quality int, toxic int")
    field = toxicity.train(docs, labels)
    got = {x.doc_id: x for x in toxicity.score_documents(docs, labels).collect()}
    for i, text, *_ in rows[:60]:
        d = field.odds(toxicity.buckets([toxicity.normal(t) for t in text.split()]))
        p = plain_marginals(d, field.start, field.move)
        z = np.clip(np.dot(toxicity.summary(p), field.whole), -30, 30)
        np.testing.assert_allclose(got[i].score, 1 / (1 + np.exp(-z)), rtol=1e-6)
        spans = [text[x.start : x.stop] for x in got[i].spans]
        words = text.split()
        runs, before = [], -2
        for k in range(len(words)):
            if p[k] >= toxicity.SPAN:
                runs[-1:] = [runs[-1] + " " + words[k]] if before == k - 1 else [*runs[-1:], words[k]]
                before = k
        assert spans == runs
    assert got[1000].score == got[1001].score == 0


def test_toxicity_held_out_and_spans(spark):
    r = random.Random(2)
    rows, labels = [], []
    for i in range(900):
        words = prose(i, 50).split(" ")
        bad = i % 6 == 0
        if bad:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(["zorgle", "zorgling", "Zorgles!"]))
        rows.append((i, " ".join(words), "en", "s"))
        labels.append((i, 1, int(bad)))
    docs, marks = make_docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.score_documents(docs, marks).collect()
    held = [x for x in got if x.held_out]
    assert np.mean([x.predicted == int(x.doc_id % 6 == 0) for x in held]) > 0.97
    texts = {i: t for i, t, *_ in rows}
    hit = [texts[x.doc_id][s.start : s.stop] for x in held for s in x.spans]
    assert hit and all("zorgl" in h.lower() for h in hit)


def test_toxicity_edges(spark, edge_docs, empty_docs, edge_labels):
    got = toxicity.score_documents(edge_docs, edge_labels).collect()
    assert len(got) == len(EDGE) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score_documents(empty_docs, edge_labels).collect() == []
    assert {r.predicted for r in toxicity.score_documents(edge_docs, edge_labels.limit(0)).collect()} == {0}


def test_rates_match_targets(spark):
    r = np.random.default_rng(0)
    p = r.dirichlet([2, 0.5], 600)
    n = r.integers(1, 500, 600)
    soft = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p)], "n long, p array<double>")
    rates = mixing.rate_of(p, n, mixing.fit_rates(soft, {"prose": 0.6, "junk": 0.4}).u)
    share = (rates * n) @ p / n.sum()
    assert (rates >= 0).all()
    np.testing.assert_allclose(share, [0.6, 0.4], atol=1e-5)
    # of all rates that meet the targets those nearest to 1, found here by a plain solution
    a = (p * n[:, None]).T / n.sum()
    nearest = 1 + p @ np.linalg.solve(a @ p, np.array([0.6, 0.4]) - a.sum(1))
    assert (nearest > 0).all()
    np.testing.assert_allclose(rates, nearest, atol=1e-3)


def test_unreachable_targets_stay_finite(spark):
    soft = spark.createDataFrame([(10, [1.0, 0.0]), (0, [0.5, 0.5])], "n long, p array<double>")
    fitted = mixing.fit_rates(soft, {"prose": 0.5, "junk": 0.5})
    np.testing.assert_allclose(mixing.rate_of(np.array([[1.0, 0.0], [0.5, 0.5]]), np.array([10, 0]), fitted.u), [0.5, 1.0], atol=1e-5)
    assert mixing.fit_rates(soft.limit(0), {"prose": 1.0}).u.tolist() == [0]


@pytest.mark.parametrize("rare", [0.1, 0.01, 0.001, 0.0001, 0.0])
def test_a_rare_domain_takes_no_rates_away(spark, rare):
    """However rare a domain is, the totals end no farther from the targets than they start, and rates stay small."""
    r = np.random.default_rng(1)
    junk, n = r.random(1000) * rare, r.integers(0, 900, 1000)
    p = np.stack([1 - junk, junk], 1)
    soft = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p)], "n long, p array<double>")
    goal = np.array([0.93, 0.07])
    fitted = mixing.fit_rates(soft, dict(zip("pj", goal)))
    rates = mixing.rate_of(p, n, fitted.u)
    assert (rates[n == 0] == 1).all() and rates.max() <= mixing.MOST_RATE
    start, end = n @ p / n.sum() - goal, (rates * n) @ p / n.sum() - goal
    np.testing.assert_allclose(end, fitted.off, atol=1e-9)
    assert np.linalg.norm(end) <= np.linalg.norm(start) + 1e-12
    if rare == 0.1:
        assert np.abs(end).max() < 1e-4
    whole = spark.createDataFrame([(float(x), [float(v) for v in q], int(w)) for x, q, w in zip(rates, p, n)], "r double, p array<double>, n long")
    assert whole.where(F.abs(mixing.rate_column(fitted.u, F.col("p"), F.col("n")) - F.col("r")) > 1e-9).count() == 0


def test_mixing_edges(spark, edge_docs, empty_docs, edge_labels):
    got = mixing.rates(edge_docs, edge_labels).collect()
    assert len(got) == len(EDGE) and all(r.rate >= 0 and r.copies in (int(r.rate), int(r.rate) + 1) for r in got)
    assert mixing.rates(empty_docs, edge_labels).collect() == []
    mixed = mixing.mix(edge_docs, edge_labels, edge_docs)
    assert mixed.columns == edge_docs.columns
    assert mixed.count() == sum(r.copies for r in got)
