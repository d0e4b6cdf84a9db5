"""The registered queries and the pipeline over the smallest tables."""

import pytest
from oracle import differences
from test_llm_near_dups import brute_groups

import corpus_pipeline
from foldwise.llm import decontaminate
from foldwise.llm.oracles import ORACLES
from foldwise.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    assert differences(spark, SMALL, name, QUERIES, ORACLES) == ""


def test_one_query_for_each_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


def test_one_row_for_each_document(spark):
    for name in ("op1_token_counts", "op4_quality", "op6_language", "op7_fingerprints", "op10_sentencepiece"):
        rows = QUERIES[name](spark, SMALL).select("doc_id").collect()
        assert sorted(r.doc_id for r in rows) == list(range(200)), name
    for name in ("op2_main_text", "op5_warc"):
        assert sorted(r.page_id for r in QUERIES[name](spark, SMALL).select("page_id").collect()) == list(range(50)), name


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    columns = docs.columns
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        path = str(tmp_path / str(number))
        stage(spark, docs, SMALL).write.parquet(path)
        docs = spark.read.parquet(path)
        ids, old = {r.doc_id for r in docs.collect()}, {r.doc_id for r in before}
        if number < 4:
            assert docs.columns == columns and ids <= old
        if number == 0:
            assert ids == old  # every document here is in a known language
        if number == 1:
            gone = old - ids
            assert not any(labels.get(k) == 1 for k in gone) and all(labels.get(k, 1) == 1 for k in ids)
        if number == 2:
            groups = brute_groups([(r.doc_id, r.text) for r in before])
            assert ids == {root for _, _, root in groups}
        if number == 3:
            benchmark = spark.read.parquet(f"{SMALL}/benchmark.parquet")
            found = decontaminate.find_leaks(spark.createDataFrame(before), benchmark)
            assert old - ids == {r.doc_id for r in found.collect()}
        if number == 4:
            assert ids == old and all(r.same for r in docs.collect())
