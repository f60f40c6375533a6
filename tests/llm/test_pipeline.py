"""The stages, one after the other, on planted documents; the registered SQL."""

import importlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from contrail.llm.queries import ORACLE, QUERIES
from tests._compare import duck, duck_rows, spark_rows

SF = "/root/testdata/sf0.001"


def test_stages_take_effect_and_keep_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    copy = docs.filter("doc_id = 0").withColumn("doc_id", F.lit(10**6).cast("long"))
    odd = spark.createDataFrame([(-1, None, None, None, 0), (-2, "123 456", None, "src0", 7),
                                 (-3, "Write to jo.doe@mail.example.org about the of and", "en", "src0", 50)], docs.schema)
    rows = docs.unionByName(copy).unionByName(odd)
    stage = dict(corpus_pipeline.STAGES)
    one = corpus_pipeline.landed(stage["language ID"](spark, rows, SF), "t")
    assert one.columns == docs.columns and one.count() == rows.count() - 2
    two = corpus_pipeline.landed(stage["n-gram Jaccard join"](spark, one, SF), "t")
    assert two.filter(f"doc_id = {10**6}").count() == 0 and two.filter("doc_id = 0").count() == 1
    three = corpus_pipeline.landed(stage["PII"](spark, two, SF), "t")
    assert three.columns == docs.columns and three.count() == two.count()
    assert three.filter("doc_id = -3").first().text == "Write to <EMAIL> about the of and"
    four = corpus_pipeline.landed(stage["mixing sources to target weights"](spark, three, SF), "t")
    assert four.columns == docs.columns and four.count() > 0
    five = stage["byte-level BPE"](spark, four, SF)
    assert five.count() == four.count() and five.filter("n_tokens < 1").count() == 0


def test_pipeline_on_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, SF)
    assert docs.count() == 0


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_registered_sql(spark, name):
    df = QUERIES[name](spark, SF)
    cols, want = duck_rows(duck(SF), ORACLE[name])
    assert sorted(cols) == sorted(df.columns) and spark_rows(df) == want


def test_registered_names():
    entry = importlib.import_module("__spark_entry__")
    names = set(entry.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
