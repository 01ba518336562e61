"""The additive model against a plain version, and its query against both on a small table."""

import zlib
from itertools import combinations

import numpy as np
import pytest
from tests.llm.conftest import make_docs, prose

from weftline.llm import quality
from weftline.llm.style import NAMES, measure


@pytest.fixture
def short(monkeypatch):
    """Few rounds, so that the plain version ends soon."""
    for name, value in (("ROUNDS", 6), ("PAIR_ROUNDS", 4), ("PAIRS", 2), ("BINS", 8), ("PAIR_BINS", 4)):
        monkeypatch.setattr(quality, name, value)


def leaf(rows, g, h):
    return -sum(g[r] for r in rows) / (sum(h[r] for r in rows) + quality.RIDGE)


def gain(rows, g, h):
    return sum(g[r] for r in rows) ** 2 / (sum(h[r] for r in rows) + quality.RIDGE)


def plain_tree(b, g, h):
    """Steps of all rows by trying every cut of every leaf, LEAVES - 1 times."""
    leaves = [list(range(len(b)))]
    spans = [(0, max(b) + 1)]
    while len(leaves) < quality.LEAVES:
        best = None
        for k, rows in enumerate(leaves):
            for cut in range(spans[k][0] + 1, spans[k][1]):
                left, right = [r for r in rows if b[r] < cut], [r for r in rows if b[r] >= cut]
                if min(len(left), len(right)) >= quality.LEAST:
                    won = gain(left, g, h) + gain(right, g, h) - gain(rows, g, h)
                    if won > 1e-9 and (best is None or won > best[0] + 1e-12):
                        best = won, k, cut, left, right
        if best is None:
            break
        _, k, cut, left, right = best
        leaves[k : k + 1] = [left, right]
        spans[k : k + 1] = [(spans[k][0], cut), (cut, spans[k][1])]
    out = np.zeros(len(b))
    for rows in leaves:
        for r in rows:
            out[r] = leaf(rows, g, h)
    return out


def plain_quadrants(a, b, g, h, sizes):
    """Gain and steps of the best cut of a pair's grid in four, by trying all."""
    best = (0.0, np.zeros(len(a)))
    for i in range(1, sizes[0]):
        for j in range(1, sizes[1]):
            parts = [[r for r in range(len(a)) if (a[r] < i, b[r] < j) == side] for side in ((True, True), (True, False), (False, True), (False, False))]
            won = sum(gain(p, g, h) for p in parts)
            if won > best[0] + 1e-12:
                out = np.zeros(len(a))
                for p in parts:
                    for r in p:
                        out[r] = leaf(p, g, h)
                best = won, out
    return best


def plain_logits(x, y):
    """Logits of the rows learnt from."""
    binned = lambda c, n: [sum(v >= e for e in sorted(set(np.quantile(c, [k / n for k in range(1, n)])))) for v in c]
    logit = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    slopes = lambda: (1 / (1 + np.exp(-logit)) - y, (q := 1 / (1 + np.exp(-logit))) * (1 - q))
    fine, coarse = [binned(c, quality.BINS) for c in x.T], [binned(c, quality.PAIR_BINS) for c in x.T]
    for _ in range(quality.ROUNDS):
        for b in fine:
            logit = logit + quality.RATE * plain_tree(b, *slopes())
    size = lambda c: len(set(np.quantile(c, [k / quality.PAIR_BINS for k in range(1, quality.PAIR_BINS)]))) + 1
    sizes = [size(c) for c in x.T]
    step = lambda i, j: plain_quadrants(coarse[i], coarse[j], *slopes(), (sizes[i], sizes[j]))
    pairs = sorted(((step(i, j)[0], i, j) for i, j in combinations(range(x.shape[1]), 2)), reverse=True)[: quality.PAIRS]
    for _ in range(quality.PAIR_ROUNDS):
        for _, i, j in pairs:
            logit = logit + quality.RATE * step(i, j)[1]
    return logit


def test_fit_against_trying_all_cuts(short):
    r = np.random.default_rng(3)
    x = np.round(r.normal(0, 1, (150, 4)), 1)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3) | (r.random(150) < 0.1)).astype(float)
    np.testing.assert_allclose(quality.fit(x, y).logits(x), plain_logits(x, y), atol=1e-9)


def test_query_against_plain_measures_and_tables(spark, short):
    """Learnt from labelled rows outside the fold; every row scored by its own measures."""
    rows = [(i, prose(i, 15 + i % 40) + (" ###" * (i % 9) if i % 3 == 0 else ""), "en", "s") for i in range(160)] + [(900, None, None, None), (901, "", None, None)]
    marks = [(i, int(i % 3 > 0)) for i in range(160)] + [(3, 0), (5, 1), (None, 1), (7, None)]
    labels = spark.createDataFrame([(i, q, 0) for i, q in marks], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in quality.score_documents(make_docs(spark, rows), labels).collect()}
    texts = {i: t for i, t, *_ in rows}
    learnt = sorted((i for i in range(160) if zlib.crc32(str(i).encode()) % 5), key=str)
    x = np.array([measure(texts[i]) for i in learnt])
    y = np.array([float(i % 3 > 0) for i in learnt])
    assert x.shape[1] == len(NAMES)
    want = 1 / (1 + np.exp(-plain_logits(x, y)))
    np.testing.assert_allclose([got[i].score for i in learnt], want, atol=1e-9)
    model = quality.fit(x, y)
    for i, t in texts.items():
        np.testing.assert_allclose(got[i].score, model.scores(np.array([measure(t)]))[0], atol=1e-9)
        assert got[i].predicted == int(got[i].score >= 0.3) and got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
