from pyspark.sql import functions as F

import corpus_pipeline
from gazette.llm import pii
from tests.llm.test_corpus_operators import brute_components

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, docs
    stages = [f for _, f in corpus_pipeline.STAGES]
    kept = stages[0](spark, docs, SF)
    assert kept.columns == columns and 0 < kept.count() < docs.count()
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    want, _ = brute_components(texts, 5, 80)
    kept = stages[1](spark, kept, SF)
    assert kept.columns == columns and {r["doc_id"] for r in kept.collect()} == {d for d, c in want.items() if d == c}
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {r["doc_id"] for r in kept.collect() if not any(i in r["text"] for i in items)}
    kept = stages[2](spark, kept, SF)
    assert kept.columns == columns and {r["doc_id"] for r in kept.collect()} == clean
    kept = stages[3](spark, kept, SF)
    assert kept.columns == columns and kept.filter(F.length("text") != F.col("n_chars")).isEmpty()
    assert all(not any(pii.find_spans(r["text"])[k] for k in pii.BASE_KINDS) for r in kept.collect())
    last = stages[4](spark, kept, SF)
    assert {r["doc_id"] for r in last.collect()} == clean and last.filter("not round_trip").isEmpty()


def test_odd_rows_pass_all_stages(spark, odd_docs):
    for _, stage in corpus_pipeline.STAGES:
        odd_docs = stage(spark, odd_docs, SF)
    odd_docs.collect()
