"""Significance against tabulated values, similarity against difflib."""

import difflib

import pytest
from pyspark.sql import functions as F

from passagemill.operators import curate, stats


def test_t_distribution_tables():
    for t, df, p in [(12.706, 1, 0.05), (2.228, 10, 0.05), (3.169, 10, 0.01), (1.96, 1e6, 0.05), (0.0, 7, 1.0), (-2.228, 10, 0.05)]:
        assert stats.t_two_sided(t, df) == pytest.approx(p, abs=2e-5)


def test_exact_signed_rank_tables():
    assert stats.signed_rank_exact(0, 5) == pytest.approx(0.0625)
    assert stats.signed_rank_exact(8, 10) == pytest.approx(0.048828125)


def pairs(spark, diffs, metric="m"):
    return spark.createDataFrame([(metric, i, 0.0, float(d), float(d)) for i, d in enumerate(diffs)], "metric string, id long, base double, dpo double, diff double")


def test_signed_rank_sums(spark):
    row = stats.signed_rank(pairs(spark, [1, -1, 2, 3, 0, -2, 2])).collect()[0]
    # |d| ranks: 1,1 -> 1.5; 2,2,2 -> 4; 3 -> 6; minus ranks 1.5 + 4
    assert (row.n, row.w, row.tied) == (6, 5.5, True)


def test_significance_edges(spark):
    frames = pairs(spark, [0, 0, 0], "still").unionByName(pairs(spark, [1], "single")).unionByName(pairs(spark, [1, 2, 3, 4, 5], "up"))
    rows = {r.metric: r for r in stats.significance(frames).collect()}
    assert rows["still"].p_t == rows["still"].p_wilcoxon == 1.0
    assert rows["single"].p_t != rows["single"].p_t
    assert rows["up"].p_wilcoxon == pytest.approx(0.0625)
    assert rows["up"].p_t == pytest.approx(0.013236, abs=1e-5)


def test_bootstrap_does_not_depend_on_partitioning(spark):
    p = pairs(spark, [(i * 7) % 11 - 4 for i in range(300)])
    a = stats.bootstrap_ci(p.repartition(1), resamples=500).collect()[0]
    b = stats.bootstrap_ci(p.repartition(6), resamples=500).collect()[0]
    assert (a.ci_low, a.ci_high) == (b.ci_low, b.ci_high)
    mean = sum((i * 7) % 11 - 4 for i in range(300)) / 300
    assert a.ci_low < mean < a.ci_high


def test_unreadable_replies_are_no_ties(spark):
    replies = spark.createDataFrame([(1, "nonsense"), (2, 'so: {"winner": "tie"} ok'), (3, '{"winner": "B", "score_a": 3}'), (4, "5")], "id long, raw string")
    keys = spark.createDataFrame([(i, "DPO ", "base", 0) for i in range(5)], "id long, A string, B string, position long")
    judged = stats.judgements(replies, keys)
    assert {r.id: r.winner_model for r in judged.collect()} == {1: None, 2: "tie", 3: "base", 4: None}
    row = stats.win_counts(judged).collect()[0]
    assert (row.valid_rows, row.invalid_rows, row.tie_wins, row.base_wins) == (2, 2, 1, 1)


def test_near_identical(spark):
    rows = [(1, "abcdefghij" * 5, "abcdefghij" * 5 + "x"), (2, "abc", "xyz"), (3, "", ""), (4, "a" * 10, "a" * 20)]
    df = spark.createDataFrame(rows, "id int, a string, b string")
    got = {r.id: r.similarity for r in curate.near_identical(df, "a", "b").collect()}
    want = {i: difflib.SequenceMatcher(a=a, b=b).ratio() for i, a, b in rows}
    assert got == {i: r for i, r in want.items() if r >= 0.92}


def test_gates_follow_the_first_kept_sample(spark):
    judge = '{"winner":"A","score_a":9,"score_b":3}'
    weak = '{"winner":"A","score_a":6,"score_b":3}'
    rows = [(i, "p", "q", "", "c", "r", "", 0.1, j) for i, j in enumerate([weak, judge, judge, weak])]
    df = spark.createDataFrame(rows, "position long, prompt string, question string, context string, chosen string, rejected string, source_answer string, similarity double, judge_raw string")
    done = spark.createDataFrame([], "prompt string")
    got = [r.reason for r in curate.gated(df, done).orderBy("position").collect()]
    assert got == ["chosen_score_too_low", "kept", "resume_duplicate_prompt", "resume_duplicate_prompt"]
    meta = curate.accepted(curate.gated(df, done)).select(F.to_json("meta").alias("j")).collect()
    assert len(meta) == 1 and '"score_a":9' in meta[0].j
