"""Recall of ranked results against relevance judgements."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.functions.predicates import require
from passagemill.functions.text import norm


def report_ks(wanted: Iterable[int], top_k: int) -> list[int]:
    """Positive cut-offs, none above ``top_k``, sorted and distinct; 1, 5 and ``top_k`` when none is left."""
    ks = sorted({min(k, top_k) for k in wanted if k > 0})
    return ks or [1, min(5, top_k), top_k]


def checked_qrels(qrels: DataFrame) -> DataFrame:
    """``query_id, query, relevant array<bigint>``; a blank query or an empty list fails the job."""
    ok = (norm(F.col("query")) != "") & (F.size("relevant") > 0)
    return require(qrels, ok, "invalid qrels: need query and relevant ids")


def hits_at(
    ranked: DataFrame, qrels: DataFrame, ks: list[int], keys: list[str] | None = None, runs: list[tuple] | None = None
) -> DataFrame:
    """``keys, query_id, k, hit`` for every judged query, also those with nothing retrieved.

    ``ranked`` is ``keys, query_id, id, rank``; ``qrels`` is ``query_id, id`` with one row
    per relevant id. ``runs`` lists the values of ``keys`` when the caller knows them;
    without it they are read off ``ranked``, which is then computed once more.
    """
    keys = keys or []
    judged = qrels.select("query_id", "id")
    if keys:
        if runs is not None:
            known = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(keys, run)]) for run in runs])
        else:
            known = ranked.agg(F.collect_set(F.struct(*keys))).scalar()  # one entry per compared method
        judged = judged.withColumn("_run", F.explode(known)).select("_run.*", "query_id", "id")
    near = ranked.where(F.col("rank") <= max(ks)).select(*keys, "query_id", "id", "rank")
    first = judged.join(near, [*keys, "query_id", "id"], "left").groupBy(*keys, "query_id").agg(F.min("rank").alias("_first"))
    hit = F.coalesce((F.col("_first") <= F.col("k")).cast("bigint"), F.lit(0).cast("bigint"))
    cut = F.explode(F.array(*[F.lit(k).cast("bigint") for k in ks]))
    return first.withColumn("k", cut).select(*keys, "query_id", "k", hit.alias("hit"))


def recall_at(hits: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Hits, queries and recall per cut-off (and per method)."""
    keys = keys or []
    totals = hits.groupBy(*keys, "k").agg(F.sum("hit").alias("hits"), F.count("*").alias("queries"))
    return totals.withColumn("recall", F.col("hits") / F.greatest(F.col("queries"), F.lit(1)))


def recall_details(ranked: DataFrame, qrels: DataFrame, ks: list[int]) -> DataFrame:
    """Per query: gold id, predicted ids in order, and one hit column per cut-off."""
    predicted = (
        ranked.groupBy("query_id")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("_p"))
        .select("query_id", F.transform("_p", lambda p: p["id"]).alias("predicted"))
    )
    gold = qrels.groupBy("query_id").agg(F.min_by("id", "position").alias("gold_id"))
    hits = hits_at(ranked, qrels, ks)
    wide = hits.groupBy("query_id").agg(*[F.max(F.when(F.col("k") == k, F.col("hit"))).alias(f"hit_at_{k}") for k in ks])
    return gold.join(predicted, "query_id", "left").join(wide, "query_id")
