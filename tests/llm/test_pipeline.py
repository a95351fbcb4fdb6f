"""The pipeline's stages on the small tables."""

import brute
import corpus_pipeline
import pytest

from tidepanel.llm import queries
from tidepanel.session import materialize

SF = "/root/testdata/sf0.001"


def test_stages_keep_clean_documents_and_act(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    rows = {r.doc_id: r.text for r in docs.collect()}
    table, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        table = materialize(stage(spark, table, SF), "test_pipeline")
        seen[name] = table
        if name != "packing":
            assert table.columns == docs.columns and table.dtypes == docs.dtypes
    kept = {r.doc_id for r in seen["language ID"].collect()}
    assert kept == set(rows)  # every text is prose of a learned language
    brute.shingles.__defaults__ = (5,)
    groups = brute.link_components(list(rows.items()), 80)
    brute.shingles.__defaults__ = (4,)
    single = {r.doc_id for r in seen["n-gram Jaccard join"].collect()}
    assert single == {g for _, g in groups.values()}
    clean = {r.doc_id for r in seen["benchmark decontamination"].collect()}
    assert clean == {i for i in single if not brute.decontaminate(rows[i], bench)[1]}
    for r in seen["PII"].collect():
        assert not brute.base_spans(r.text) and r.n_chars == len(r.text)
        if not brute.base_spans(rows[r.doc_id]) and "token" not in rows[r.doc_id]:
            assert r.text == rows[r.doc_id]
    assert {r.doc_id for r in seen["packing"].select("doc_id").distinct().collect()} == clean


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None), (2, "", "en", "s", 0)]])
def test_stages_on_empty_and_null_tables(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), "test_pipeline")
    assert docs.count() == 0


def test_every_operator_has_a_query():
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 14)}
