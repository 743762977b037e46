"""Every operator and stage on nulls, empty and very long texts, ties, repeats, clashing columns and empty tables."""

import pytest

import corpus_pipeline
from passagemill.llm import html_text, licenses, line_dedup, mixing, near_dedup, packing, quality, queries, substrings, topk, toxicity

OPERATORS = {
    "packing": lambda docs, labels: packing.pack_documents(docs, queries.tokenizer_path()),
    "line_dedup": lambda docs, labels: line_dedup.dedup_lines(docs).select("n_lines", "n_dropped", "kept_text"),
    "near_dedup": lambda docs, labels: near_dedup.near_duplicates(docs),
    "substrings": lambda docs, labels: substrings.repeated_spans(docs),
    "toxicity": lambda docs, labels: toxicity.scored(docs, toxicity.trained(docs, labels)),
    "quality": lambda docs, labels: quality.judged(docs).drop("doc"),
    "mixing": lambda docs, labels: mixing.produced(docs, labels).drop("doc"),
    "licenses": lambda docs, labels: licenses.scan(docs),
}
PER_ROW = {"line_dedup", "near_dedup", "toxicity", "quality", "mixing", "licenses"}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_odd_rows(odd_docs, odd_labels, odd_rows, name):
    rows = OPERATORS[name](odd_docs, odd_labels).collect()
    if name in PER_ROW:
        assert len(rows) == len(odd_rows)


@pytest.mark.parametrize("name", list(OPERATORS))
def test_empty_table(no_docs, odd_labels, name):
    assert OPERATORS[name](no_docs, odd_labels).collect() == []


def test_stages_keep_columns(spark, odd_docs, no_docs, odd_labels, tmp_path):
    odd_labels.write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns, name
            assert out.dtypes == docs.dtypes, name
            out.collect()


def test_stage_results(spark, odd_docs, odd_labels, tmp_path):
    odd_labels.write.parquet(str(tmp_path / "labels.parquet"))
    near = [r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, odd_docs, str(tmp_path)).collect()]
    assert 5 in near and 6 not in near  # equal long texts
    assert 7 in near and 8 not in near  # a near copy
    assert near.count(12) == 1  # a repeated row stays once
    assert {1, 9, 10} <= set(near)
    assert len({2, 3, None} & set(near)) == 1 or None in near  # a null text is an empty one
    mixed = {r["doc_id"] for r in corpus_pipeline.source_mixing(spark, odd_docs, str(tmp_path)).collect()}
    assert mixed == {r["doc_id"] for r in odd_docs.collect()}


def test_pages(spark):
    rows = [(1, "u", None, 1), (2, None, "", 2), (None, "u", "<p>Plain words here, enough to be a text.", 3), (3, "u", "&am", 4), (3, "u", "<", 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text long")
    out = {(r["page_id"], r["url"]): r["text"] for r in html_text.main_text(pages, html_text.trained(pages)).collect()}
    assert out[1, "u"] == "" and out[2, None] == "" and out[None, "u"] == "Plain words here, enough to be a text."
    assert html_text.main_text(pages.limit(0), html_text.trained(pages.limit(0))).collect() == []


def test_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (None, [1.0, 1.0]), (6, [1.0]), (7, []), (8, [-0.001, 0.5]), (8, [-0.001, 0.5])]
    vectors = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    out = topk.exact_top_k(vectors.where("vec_id = 0"), vectors, k=5, shard_rows=2, query_rows=1).collect()
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in out) == [(1, 1, 65536), (2, 8, -256), (3, 8, -256)]
    assert topk.exact_top_k(vectors.limit(0), vectors.limit(0)).collect() == []
