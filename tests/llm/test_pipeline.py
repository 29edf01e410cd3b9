import inspect

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from freshet.llm import ngram_join, queries


def test_registered():
    names = set(entry.queries())
    assert {"pipeline", *queries.QUERIES} <= names
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 14)]
    assert len(pipeline.STAGES) == 5


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(k))
        stage(spark, out[-1], folder).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_filters_keep_columns_and_most_documents(spark, stages):
    docs = stages[0]
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    for before, after in zip(stages[:4], stages[1:4]):
        assert after.columns == docs.columns
        assert after.select("doc_id").subtract(before.select("doc_id")).isEmpty()
        assert after.count() >= 0.75 * before.count()
    good = labels.where("quality = 1").join(docs, "doc_id")
    assert stages[1].join(good, "doc_id", "left_semi").count() >= 0.97 * good.count()


def test_one_document_of_each_group_stays(stages):
    found = ngram_join.near_documents(stages[2])
    want = {r.doc_id for r in found.where("doc_id = component_id").collect()}
    assert {r.doc_id for r in stages[3].collect()} == want


def test_personal_data_is_replaced_and_all_is_packed(stages):
    assert {r.doc_id for r in stages[4].collect()} == {r.doc_id for r in stages[3].collect()}
    assert stages[4].where(F.col("text").rlike(r"[a-z]@[a-z]+\d*\.example\.com")).count() == 0
    packed = stages[5].groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("t")).collect()
    assert len(packed) == stages[4].count() and all(r.n == r.t for r in packed)


def test_odd_documents_pass_through(spark, documents, tmp_path):
    docs = documents.withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long"))
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(0, 1), (1, 1), (3, 0), (8, 0)], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    assert pipeline.run(spark, folder).columns[0] == "doc_id"


def test_empty_documents(spark, tmp_path):
    folder = str(tmp_path)
    for name in ("documents", "labels"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(0).write.parquet(f"{folder}/{name}.parquet")
    assert pipeline.run(spark, folder).count() == 0


def test_only_the_entry_guards_its_imports():
    assert "ImportError" not in inspect.getsource(pipeline)
