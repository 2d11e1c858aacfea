import corpus_pipeline
import pytest


@pytest.fixture(scope="module")
def folder(spark, odd_docs, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    odd_docs.write.parquet(f"{d}/documents.parquet")
    odd_docs.selectExpr("doc_id", "1 as quality", "0 as toxic").where("doc_id is not null").distinct().write.parquet(f"{d}/labels.parquet")
    text = odd_docs.where("doc_id = 6").first().text
    spark.createDataFrame([(1, " ".join(text.split()[100:130]))], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages_keep_columns_and_take_effect(spark, odd_docs, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_duplicates", "benchmark", "mixing"]
    docs = odd_docs
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.columns == odd_docs.columns + (["mix_copies"] if name == "mixing" else []), name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    ids = [r.doc_id for r in docs.collect()]
    assert 6 not in ids and 2 not in ids and 1 in ids or 7 in ids


def test_run_equals_its_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), stage(spark, docs, folder).schema)
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.text or "", r.mix_copies)
    assert sorted(map(key, docs.collect())) == sorted(map(key, corpus_pipeline.run(spark, folder).collect()))


def test_empty_tables(spark, odd_docs, folder, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
