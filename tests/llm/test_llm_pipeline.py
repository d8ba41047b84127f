from __future__ import annotations

import __spark_entry__
import pytest
from edge_rows import edge_documents
from test_llm_packing import ids_of
from test_llm_secrets import base_spans
from test_llm_simhash import plain_components, plain_fingerprint

import corpus_pipeline
from riskweave.llm import packing, toxicity
from riskweave.llm.queries import LLM_QUERIES, LLM_SQL

SMALL = "/root/testdata/sf0.001"


def test_every_operator_has_its_query():
    names = list(LLM_QUERIES)
    assert names == [*sorted((n for n in names if n != "pipeline"), key=lambda n: int(n[2:].split("_")[0])), "pipeline"]
    assert [int(n[2:].split("_")[0]) for n in names[:-1]] == list(range(1, 11))
    assert set(LLM_SQL) < set(names) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", [n for n in LLM_QUERIES if n != "pipeline"])
def test_queries_run(spark, name):
    source = {"op3": "embeddings", "op4": "embeddings", "op8": "pages"}.get(name.split("_")[0], "documents")
    n = spark.read.parquet(f"{SMALL}/{source}.parquet").count()
    rows = LLM_QUERIES[name](spark, SMALL).count()
    assert rows >= n if name == "op6_packing" else rows > 0 if source == "embeddings" else rows == n


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    scores = {r.doc_id: r.score for r in toxicity.score_documents(docs, labels).collect()}
    clean = stages["toxicity"](spark, docs, SMALL)
    assert clean.columns == docs.columns
    rows = {r.doc_id: r for r in docs.collect()}
    kept = {i for i, s in scores.items() if s < toxicity.THRESHOLD}
    assert {r.doc_id for r in clean.collect()} == kept
    marked = [(i, plain_fingerprint(rows[i].text)) for i in sorted(kept)]
    first = {i for i, _, low in plain_components(marked) if i == low}
    single = stages["near_duplicates"](spark, clean, SMALL)
    assert {r.doc_id for r in single.collect()} == first and single.columns == docs.columns
    open_ = {r.doc_id: r for r in stages["secrets"](spark, single, SMALL).collect()}
    assert set(open_) == first
    for i, r in open_.items():
        assert not base_spans(r.text)
        assert base_spans(rows[i].text) or r == rows[i]
    encoder = packing.WordEncoder()
    packed = corpus_pipeline.run(spark, SMALL).collect()
    length = {i: len(ids_of(encoder, r.text or "")) + 1 for i, r in open_.items()}
    total = {}
    for r in packed:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert total == length
    assert len({r.sequence_id for r in packed}) <= 1.1 * sum(length.values()) / 2048 + 1


def test_stages_take_edge_rows(spark, tmp_path):
    docs = edge_documents(spark)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        for table in (docs, docs.where("false")):
            out = stage(spark, table, str(tmp_path))
            assert (out.count() > 0) == (table is docs)
            assert name == "packing" or out.columns == docs.columns
