"""Retrieval against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagemill.operators import recall, retrieve


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(["the"] + rng.choices(words, k=rng.randrange(1, 30)))) for i in range(80)] + [(80, "")]
    asked = [(i, " ".join(rng.choices(words + ["the", "the", "nowhere"], k=5))) for i in range(12)]
    return docs, asked


def brute(docs, query):
    toks = {i: t.split() for i, t in docs}
    n, mean = len(docs), sum(map(len, toks.values())) / len(docs)
    df = Counter(w for t in toks.values() for w in set(t))
    out = {}
    for i, t in toks.items():
        tf = Counter(t)
        s = sum(
            math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(t) / mean))
            for w in query.split()
            if tf[w]
        )
        if s:
            out[i] = s
    return out


@pytest.mark.parametrize("bound", [200_000, 3])
def test_bm25(monkeypatch, spark, corpus, bound):
    """With a small bound the query terms are joined by salted shuffle instead of broadcast."""
    monkeypatch.setattr(retrieve, "BROADCAST_TERMS", bound)
    docs, asked = corpus
    index = retrieve.keyword_index(spark.createDataFrame(docs, "id long, text string"), "id", F.col("text"))
    terms = retrieve.query_terms(spark.createDataFrame(asked, "query_id long, query string"), "query_id", "query")
    got = {(r.query_id, r.id): r.score for r in retrieve.bm25_scores(index, terms, salts=3).collect()}
    want = {(q, i): s for q, text in asked for i, s in brute(docs, text).items()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


@pytest.mark.parametrize("n, block, seed, bound", [(4, 2048, 2000, 200_000), (1, 7, 3, 200_000), (4, 7, 3, 7), (200, 7, 3, 7), (200, 2048, 2000, 200_000)])
def test_bm25_top_equals_all_pairs(monkeypatch, spark, corpus, n, block, seed, bound):
    """Thresholds, skipped blocks, batches of queries, ties and repeated documents: the same rows as from all scores."""
    monkeypatch.setattr(retrieve, "BROADCAST_TERMS", bound)
    monkeypatch.setattr(retrieve, "BLOCK_DOCS", block)
    monkeypatch.setattr(retrieve, "SEED_POSTINGS", seed)
    docs, asked = corpus
    docs = docs + [(100 + i, docs[3][1]) for i in range(9)]
    index = retrieve.keyword_index(spark.createDataFrame(docs, "id long, text string"), "id", F.col("text"))
    asked = asked + [(50, "nowhere"), (51, ""), (52, docs[3][1])]
    terms = retrieve.query_terms(spark.createDataFrame(asked, "query_id long, query string"), "query_id", "query")
    got = {(r.query_id, r["rank"]): (r.id, r.score) for r in retrieve.bm25_top(index, terms, n).collect()}
    want = {}
    for q, text in asked:
        best = sorted((-round(s, 9), i) for i, s in brute(docs, text).items())[:n]
        want |= {(q, r): (i, -s) for r, (s, i) in enumerate(best, 1)}
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1]) for k in want)


def test_bm25_top_follows_few_pairs(monkeypatch, spark, data):
    """Far fewer pairs leave the blocks than share a term."""
    monkeypatch.setattr(retrieve, "BLOCK_DOCS", 64)
    docs, items = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "benchmark"))
    index = retrieve.keyword_index(docs, "doc_id", F.col("text"))
    terms = retrieve.query_terms(items, "item_id", "text").cache()
    assert 5 * retrieve.bm25_candidates(index, terms, 10).count() < retrieve.bm25_scores(index, terms).count()


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(2)
    v = np.round(rng.normal(size=(300, 8)), 1)
    v[10:20] = v[10]  # ties
    q = np.round(rng.normal(size=(25, 8)), 1)
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, embedding array<float>").repartition(5)
    asked = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "query_id long, embedding array<float>")
    scores = np.round(q.astype("float32").astype(float) @ v.astype("float32").astype(float).T, 9)
    want = [(i, r + 1, int(j)) for i, row in enumerate(scores) for r, j in enumerate(sorted(range(300), key=lambda j: (-row[j], j))[:7])]
    return frame, asked, want


@pytest.mark.parametrize("batch, cell", [(4096, 50_000), (10, 70)])
def test_dense(monkeypatch, vectors, batch, cell):
    """With small limits the same search runs as a grid of cells."""
    monkeypatch.setattr(retrieve, "BATCH_QUERIES", batch)
    monkeypatch.setattr(retrieve, "CELL_VECTORS", cell)
    frame, asked, want = vectors
    best = retrieve.top_n(retrieve.dense_scores(frame, asked, 7), 7)
    assert sorted((r.query_id, r["rank"], r.id) for r in best.collect()) == want


def test_dense_without_queries(spark, vectors):
    frame, asked, _ = vectors
    assert retrieve.dense_scores(frame, asked.where("false"), 3).collect() == []


def test_fusion_is_symmetric_in_scores_and_keeps_missing_legs(spark):
    a = spark.createDataFrame([(1, 10, 0.9, 1), (1, 11, 0.8, 2)], "query_id long, id long, score double, rank long")
    b = spark.createDataFrame([(1, 12, 3.0, 1), (1, 10, 2.0, 2)], "query_id long, id long, score double, rank long")
    ab = {r.id: r for r in retrieve.fuse(a, b, 10).collect()}
    ba = {r.id: r for r in retrieve.fuse(b, a, 10).collect()}
    assert {i: r.rrf_score for i, r in ab.items()} == {i: r.rrf_score for i, r in ba.items()}
    assert ab[10].rrf_score == pytest.approx(1 / 61 + 1 / 62) and ab[10]["rank"] == 1
    assert ab[11].bm25_score is None and ab[12].dense_score is None
    # Equal fusion scores put the dense leg first.
    tie = retrieve.fuse(a.where("id = 11").withColumn("rank", F.lit(1)), b.where("id = 12"), 5).orderBy("rank").collect()
    assert [r.id for r in tie] == [11, 12]


def test_report_ks():
    assert recall.report_ks([10, 5, 1, 5, 0, -3, 99], 10) == [1, 5, 10]
    assert recall.report_ks([0], 3) == [1, 3, 3]


def test_hits_grow_with_k_and_count_empty_results(spark):
    ranked = spark.createDataFrame([("m", 1, 7, 1), ("m", 1, 8, 2), ("n", 1, 8, 1)], "method string, query_id long, id long, rank long")
    qrels = spark.createDataFrame([(1, 8), (2, 9)], "query_id long, id long")
    hits = {(r.method, r.query_id, r.k): r.hit for r in recall.hits_at(ranked, qrels, [1, 2], ["method"]).collect()}
    assert hits == {("m", 1, 1): 0, ("m", 1, 2): 1, ("m", 2, 1): 0, ("m", 2, 2): 0, ("n", 1, 1): 1, ("n", 1, 2): 1, ("n", 2, 1): 0, ("n", 2, 2): 0}


def test_blank_qrels_fail(spark):
    bad = spark.createDataFrame([(1, " ", [1])], "query_id long, query string, relevant array<long>")
    with pytest.raises(Exception, match="invalid qrels"):
        recall.checked_qrels(bad).collect()


@pytest.mark.parametrize("bound", [0, 200_000])
def test_scores_are_added_up_in_bounded_tasks(spark, monkeypatch, bound):
    docs = [(i % 900 if i % 50 else None, " ".join(["a"] * (i % 4) + ["b", f"c{i % 7}"])) for i in range(1000)]
    index = retrieve.keyword_index(spark.createDataFrame(docs, "id long, text string"), "id", F.col("text"))
    asked = retrieve.query_terms(spark.createDataFrame([(q, f"a b c{q}") for q in range(6)], "q long, t string"), "q", "t")
    monkeypatch.setattr(retrieve, "BROADCAST_TERMS", bound)
    whole = {(r.query_id, r.id): r.score for r in retrieve.bm25_scores(index, asked).collect()}
    monkeypatch.setattr(retrieve, "TASK_HITS", 200)
    parted = retrieve.bm25_scores(index, asked)
    assert parted.rdd.getNumPartitions() >= len(whole) / 200
    assert not re.search(r"hashpartitioning\(query_id#\d+L?, id#", parted._jdf.queryExecution().executedPlan().toString())
    got = {(r.query_id, r.id): r.score for r in parted.collect()}
    assert got.keys() == whole.keys() and len(whole) == 6 * 883
    assert all(abs(got[k] - s) < 1e-9 for k, s in whole.items())
