"""Queries over whole tables, where the SQL of a narrower query keeps a part."""

import os

import pytest

from weftline.queries import QUERIES
from weftline.queries.base import CUTOFFS

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def rows_of(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def test_relevance_and_propagation_take_every_task_row(spark):
    n = rows_of(spark, "customer").count()
    got = {x.t: x.n for x in QUERIES["relevance_whole"](spark, SF).collect()}
    assert got["customer"] == n and got["task"] == len(CUTOFFS) * n
    out = QUERIES["propagate_embeddings_whole"](spark, SF)
    assert out.select("t_cust", "cutoff").distinct().count() == out.count() == len(CUTOFFS) * n


def test_junction_takes_every_order(spark):
    orders = rows_of(spark, "orders")
    got = QUERIES["rewrite_junction_whole"](spark, SF)
    assert got.where("side = 'a'").select("key").distinct().count() == orders.select("o_orderkey").distinct().count()
    assert got.where("side = 'b'").count() == orders.count()


def test_prose_profile_looks_beyond_500_texts(spark, tmp_path):
    rows = [(i, f"text number {i} of many") for i in range(700)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert QUERIES["prose_profile_whole"](spark, str(tmp_path)).first().n_unique == 700
