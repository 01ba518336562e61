"""Corpus operators where they did less than their whole job."""

import duckdb
from tests.llm.conftest import make_docs, prose
from pyspark.sql import functions as F

from weftline.llm import packing, rules, simhash


def test_near_copies_share_no_bin(spark):
    rows, near = [], []
    for i in range(40):
        words = prose(i, 200).split()
        for at in range(200):
            changed = words[:at] + ["qqqq"] + words[at + 1 :]
            a, b = (simhash.fingerprint_bits(" ".join(w)) for w in (words, changed))
            if 0 < (a ^ b).bit_count() <= simhash.DISTANCE:
                rows += [(2 * i, " ".join(words), "en", f"a{i}"), (2 * i + 1, " ".join(changed), "en", f"b{i}")]
                near.append(2 * i)
                break
    assert len(near) > 5
    docs = make_docs(spark, rows)
    bins = lambda **kw: {x.doc_id: x.bin_id for x in packing.pack(docs, capacity=100_000, **kw).collect()}
    got, by_text = bins(), bins(cluster=packing.text_cluster(F.col("text")))
    assert all(by_text[i] == by_text[i + 1] for i in near)
    assert all(got[i] != got[i + 1] for i in near) and len(set(got.values())) == 2


def test_copies_in_other_case_share_no_bin(spark):
    text = "Ärger über Öl und Übung in ÉTÉ Ñandú " * 3
    docs = make_docs(spark, [(1, text, "de", "a"), (2, text.lower(), "de", "b"), (3, text.upper(), "de", "c"), (4, None, "de", "d"), (5, None, "de", "e")])
    got = {x.doc_id: x.bin_id for x in packing.pack(docs).collect()}
    assert len({got[1], got[2], got[3]}) == 3 and got[4] == got[5]


def test_lines_of_a_large_host_by_number_alone(spark):
    rows = [(i, prose(i, 25) + ("\na line that some documents share" if i < 30 else ""), "en", "h") for i in range(900)]
    rows += [(i, prose(i, 25) + "\na line that some documents share", "en", "k") for i in range(900, 920)]
    docs = make_docs(spark, rows + rows[:3])
    c = duckdb.connect()
    documents = docs.select("doc_id", "text", "source").toArrow()  # noqa: F841
    got = rules.judge(docs)  # 33 of 903 documents of one host have the line, 20 of 20 of the other
    ran = c.execute(rules.ORACLE)
    names = [d[0] for d in ran.description]
    assert sorted(map(str, ran.fetchall())) == sorted(str(tuple(r[n] for n in names)) for r in got.collect())
    assert got.where("words_removed = 6").count() == 33
    hot = rules.MOST_HOT
    try:
        rules.MOST_HOT = 1  # nothing is broadcast
        assert rules.judge(docs).where("words_removed = 6").count() == 33
    finally:
        rules.MOST_HOT = hot
