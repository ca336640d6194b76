"""The registered queries: against their SQL, and the pipeline against the operators it calls."""

import os

import pytest

import corpus_pipeline
from oracle.check import compare, connect
from sitequill.llm import mixing, ngram_join, packing, quality, toxicity
from sitequill.llm.oracle import ORACLE
from sitequill.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no sample data")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    result = compare(spark, connect(SF), name, SF, QUERIES, ORACLE)
    assert result.startswith("ok"), result


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = [name for name, _ in corpus_pipeline.STAGES]
    assert len(stages) == 5
    frames, now = [docs], docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SF)
        assert now.columns == docs.columns
        now = spark.createDataFrame(now.collect(), docs.schema)
        frames.append(now)
    ids = [[r.doc_id for r in f.select("doc_id").collect()] for f in frames]
    kept = {r.doc_id for r in quality.quality_columns(docs).where("kept").collect()}
    assert set(ids[1]) == kept
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    toxic = {r.doc_id for r in toxicity.toxic_scores(frames[1], labels).where("predicted = 1").collect()}
    assert toxic and set(ids[2]) == kept - toxic
    assert set(ids[3]) == {r.doc_id for r in ngram_join.ngram_classes(frames[2], 5, 80, 100).where("doc_id = component_id").collect()}
    place = {r.doc_id: (r.slot, r.place) for r in mixing.mixed(frames[3]).collect()}
    assert sorted(ids[4]) == sorted(ids[3]) and [place[i] for i in ids[4]] == sorted(place[i] for i in ids[4])
    want = {(r.doc_id, r.piece, r.ids_crc32) for r in packing.packed_documents(frames[4]).collect()}
    assert {(r.doc_id, r.piece, r.ids_crc32) for r in corpus_pipeline.run(spark, SF).collect()} == want
