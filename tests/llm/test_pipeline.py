"""The pipeline's stages against what they promise, and the queries against their SQL."""

import glob
import os

import duckdb
import pytest

DATA = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not glob.glob(f"{DATA}/documents.parquet"), reason="needs the driver's tables")


def test_stages_keep_clean_documents(spark, tmp_path):
    import corpus_pipeline
    from tidefold.llm.decontamination import contamination

    assert len(corpus_pipeline.STAGES) == 5
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / str(k))
        stage(spark, docs, DATA).write.parquet(path)
        docs = spark.read.parquet(path)
        sizes.append(docs.count())
        if k < 4:
            assert docs.columns == columns, name
    good = spark.read.parquet(f"{DATA}/labels.parquet").where("quality = 1").select("doc_id")
    first = spark.read.parquet(str(tmp_path / "0"))
    assert first.join(good, "doc_id").count() >= 0.97 * good.count()
    assert sizes[1] < sizes[0] and sizes[2] == sizes[1] and sizes[4] == sizes[3] <= sizes[2]
    clean = spark.read.parquet(str(tmp_path / "3"))
    assert contamination(clean, bench).where("size(spans) > 0").count() == 0
    packed = {r.doc_id for r in docs.select("doc_id").distinct().collect()}
    assert packed == {r.doc_id for r in clean.select("doc_id").collect()}


def test_queries_equal_their_sql(spark):
    from tidefold.llm import queries

    for name, sql in queries.oracle_sql().items():
        got = queries.queries()[name](spark, DATA).toPandas()
        with duckdb.connect() as c:
            for t in ("documents", "benchmark", "labels"):
                c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
            want = c.execute(sql).df()
        columns = sorted(want.columns)
        assert sorted(got.columns) == columns
        assert sorted(map(str, got[columns].values.tolist())) == sorted(map(str, want[columns].values.tolist()))


def test_one_query_for_each_operator():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))
    assert os.path.exists("corpus_pipeline.py") or "corpus_pipeline" in __spark_entry__.__dict__
