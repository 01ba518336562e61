"""The pipeline's stages on empty tables, nulls, and columns named as those inside."""

import pytest
from pyspark.sql import functions as F
from tests.llm.conftest import make_docs, prose

NAMES = ("__lang", "__toxic", "__mix", "__copy", "__k", "__repeats", "__hot")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, prose(i, 40, "abcdefg" if i % 2 else "opqrstu") + (" zorgle" if i % 5 == 0 else ""), "xx" if i % 2 else "yy", f"s{i % 3}") for i in range(90)]
    make_docs(spark, rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 7 > 0), int(i % 5 == 0)) for i, *_ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_keep_columns_and_take_empty_tables(spark, folder, edge_docs):
    import corpus_pipeline

    docs = edge_docs.withColumns({n: F.lit(7) for n in NAMES}).withColumn("a.b", F.lit("x"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        assert {tuple(r[n] for n in (*NAMES, "a.b")) for r in out.collect()} <= {(7,) * len(NAMES) + ("x",)}
        assert stage(spark, docs.limit(0), folder).collect() == []
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), folder).collect() == []


def test_whole_run_over_empty_tables(spark, tmp_path, empty_docs, edge_labels):
    import corpus_pipeline

    empty_docs.write.parquet(f"{tmp_path}/documents.parquet")
    edge_labels.limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
