"""Keyword, dense and hybrid retrieval for whole tables of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagemill.functions.text import CONTENT_LABEL, HEADING_LABEL, SOURCE_LABEL, labelled_passage
from passagemill.functions.tokens import tokenize
from passagemill.operators.encode import coverage_scorer
from passagemill.operators.spread import unnest
from passagemill.session import stored

SCORE_DIGITS = 9  # ranks compare scores at this precision, ties go to the smaller id


# ---- keyword leg --------------------------------------------------------------------------


@dataclass
class KeywordIndex:
    """Keyword statistics of a corpus as tables: write them once, read them for every query batch."""

    postings: DataFrame  # id, length, term, tf
    lengths: DataFrame  # id, length

    def stats(self) -> DataFrame:
        """One row: number of documents and their mean length."""
        return self.lengths.agg(F.count("*").alias("n_docs"), F.avg("length").alias("avg_length"))

    def terms(self, postings: DataFrame | None = None) -> DataFrame:
        """Document frequency and inverse document frequency per term."""
        counts = (postings or self.postings).groupBy("term").agg(F.count("*").alias("df"))
        n = self.lengths.agg(F.count("*")).scalar()
        return counts.withColumn("idf", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)))


def keyword_index(docs: DataFrame, id_col: str, text: Column) -> KeywordIndex:
    tokens = docs.select(F.col(id_col).alias("id"), tokenize(text).alias("_tokens"))
    tokens = tokens.withColumn("length", F.size("_tokens").cast("bigint"))
    # The tokens of one document lie together, so counting combines almost fully before the shuffle.
    words = unnest(tokens, ["id", "length"], F.col("_tokens"), "term")
    postings = words.groupBy("id", "length", "term").agg(F.count("*").alias("tf"))
    return KeywordIndex(postings, tokens.select("id", "length"))


def query_terms(queries: DataFrame, query_id: str, text: str) -> DataFrame:
    """``query_id, term, qtf``: a term asked twice counts twice."""
    words = unnest(queries, [F.col(query_id).alias("query_id")], tokenize(F.col(text)), "term")
    return words.groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


BROADCAST_TERMS = 200_000  # (query, term) rows sent to every task at most, some megabytes
TASK_HITS = 1 << 20  # rows of one query and one asked term of a document that a task adds up


def bm25_scores(index: KeywordIndex, asked: DataFrame, k1: float = 1.5, b: float = 0.75, salts: int = 16) -> DataFrame:
    """``query_id, id, score`` of every document that shares a term with a query.

    Only postings of asked terms take part: the semi join is pushed below the token
    count. Up to ``BROADCAST_TERMS`` counted query terms travel to the postings. Beyond
    that both sides are shuffled by term, and a frequent term is spread over ``salts``
    keys by document, so no task holds all its documents. Scores are added up by document,
    in as many tasks as the counted rows ask for, so a task's memory does not grow with the corpus.
    """
    wanted = stored(index.postings.join(asked.select("term").distinct(), "term", "left_semi"), "asked-postings")
    terms = index.terms(wanted)
    n_hits = asked.join(terms, "term").agg(F.sum("df").alias("n")).first()["n"] or 0
    tasks = max(1, -(-n_hits // TASK_HITS), asked.sparkSession.sparkContext.defaultParallelism)
    weighted = asked.join(terms, "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("_weight"))
    mean = F.coalesce(F.nullif(index.lengths.agg(F.avg("length")).scalar(), F.lit(0.0)), F.lit(1.0))
    norm = k1 * (1 - b + b * F.col("length") / mean)
    gains = wanted.select("id", "term", (F.col("tf") * (k1 + 1) / (F.col("tf") + norm)).alias("_gain"))
    if asked.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS:
        hits = gains.repartition(tasks, "id").join(F.broadcast(weighted), "term")
    else:
        salt = F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")
        every_salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
        hits = gains.withColumn("_salt", salt).join(weighted.withColumn("_salt", every_salt), ["term", "_salt"]).repartition(tasks, "id")
    # A document's hits lie in one task already, so they are not shuffled for the sum.
    return hits.groupBy("query_id", "id").agg(F.sum(F.col("_weight") * F.col("_gain")).alias("score"))


def top_n(scores: DataFrame, n: int, score: str = "score", ties: str = "id") -> DataFrame:
    """The ``n`` best rows per query with ``rank`` from 1; limited in every task before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.round(score, SCORE_DIGITS).desc(), F.col(ties))
    return scores.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= n)


# ---- keyword top-n without all pairs -----------------------------------------------------------

BLOCK_DOCS = 2048  # documents whose postings a task holds at a time
SEED_POSTINGS = 2000  # a query's rarest terms are read for its threshold until they have this many postings
SEEDS = 10  # documents scored for the threshold, as a multiple of the rows wanted
_SLACK = 1e-8  # scores are compared after rounding, and sums depend on their order


class _Postings:
    """The postings of one block of documents, by term, with the largest gain of each term in the block."""

    def __init__(self, rows: pd.DataFrame) -> None:
        self.ids, places = np.unique(rows["id"].to_numpy(), return_inverse=True)
        codes, terms = pd.factorize(rows["term"])
        order = np.argsort(codes, kind="stable")
        starts = np.searchsorted(codes[order], np.arange(len(terms) + 1))
        self.places, self.gains = places[order], rows["gain"].to_numpy()[order]
        largest = np.maximum.reduceat(self.gains, starts[:-1])
        self.terms = {t: (a, b, m) for t, a, b, m in zip(terms, starts, starts[1:], largest)}

    def best(self, asked: list[tuple[str, float]], least: float, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the documents that may be among the ``n`` best, none below ``least``.

        Terms are added by falling largest gain. Once the terms to come cannot lift a document to
        ``least`` by themselves, only documents that still can reach it are followed.
        """
        parts = sorted(((w * self.terms[t][2], w, *self.terms[t][:2]) for t, w in asked if t in self.terms), reverse=True)
        rest = sum(bound for bound, *_ in parts)
        none = np.empty(0, np.int64), np.empty(0)
        if not parts or rest < least:
            return none
        scores, alive = np.zeros(len(self.ids)), None
        for i, (bound, weight, a, b) in enumerate(parts):
            places, gains = self.places[a:b], self.gains[a:b]
            if alive is not None:
                followed = alive[places]
                places, gains = places[followed], gains[followed]
            scores[places] += weight * gains
            rest -= bound
            if rest < least and (alive is None or i % 4 == 0):
                alive = scores + rest >= least
                if not alive.any():
                    return none
        found = np.flatnonzero((scores > 0) & (scores >= least))
        if len(found) > n:
            bar = np.partition(scores[found], len(found) - n)[len(found) - n] - _SLACK
            found = found[scores[found] >= bar]
        return found, scores[found]


def _asked_lists(rows: pd.DataFrame) -> dict:
    """For each query its terms with weights, and its threshold."""
    return {q: (list(zip(g["term"], g["weight"])), float(g["least"].iloc[0])) for q, g in rows.groupby("query_id", sort=False)}


def _block_scores(rows: pd.DataFrame, asked: dict, n: int) -> pd.DataFrame:
    postings, out = _Postings(rows), []
    for query, (terms, least) in asked.items():
        places, scores = postings.best(terms, least, n)
        if len(places):
            out.append(pd.DataFrame({"query_id": query, "id": postings.ids[places], "score": scores}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "id": [], "score": []})


def bm25_candidates(index: KeywordIndex, asked: DataFrame, n: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """``query_id, id, score``: exact scores of documents that hold all of each query's ``n`` best, and few others.

    Documents are cut into blocks of about ``BLOCK_DOCS``; a task holds the asked terms' postings of
    one block and scores it document by document, so pairs of query and document are never
    shuffled. Two rounds: documents with a query's rarest terms are scored first, and the ``n``-th
    best of them is a threshold no result can be below; then a block whose largest gains cannot add up to it is
    skipped for that query. Up to ``BROADCAST_TERMS`` counted query terms travel to the
    blocks; beyond that queries are cut into batches and each block meets each batch.
    """
    spark = index.postings.sparkSession
    asked = stored(asked, "asked")
    few = asked.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    small = F.broadcast if few else (lambda df: df)
    docs, mean = index.lengths.agg(F.count("*"), F.avg("length")).first()
    blocks = max(1, -(-docs // BLOCK_DOCS))
    norm = k1 * (1 - b + b * F.col("length") / (mean or 1.0))
    wanted = index.postings.join(small(asked.select("term").distinct()), "term", "left_semi")
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block")
    gains = stored(wanted.select("id", "term", (F.col("tf") * (k1 + 1) / (F.col("tf") + norm)).alias("gain"), block), "gains")
    terms = gains.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = stored(asked.join(terms, "term").select("query_id", "term", "df", (F.col("qtf") * idf).alias("weight")), "weighted")

    rarest = Window.partitionBy("query_id").orderBy("df", "term")
    before = F.coalesce(F.sum("df").over(rarest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    seeds = weighted.withColumn("before", before).where(F.col("before") < SEED_POSTINGS).drop("before")
    gained = F.sum(F.col("weight") * F.col("gain")).alias("score")
    partial = gains.join(small(seeds), "term").groupBy("query_id", "id").agg(gained)
    chosen = top_n(partial, SEEDS * n).select("query_id", "id")
    full = chosen.join(small(weighted), "query_id").join(gains, ["id", "term"]).groupBy("query_id", "id").agg(gained)
    least = top_n(full, n).where(F.col("rank") == n).select("query_id", (F.col("score") - _SLACK).alias("least"))
    queries = weighted.join(least, "query_id", "left").select("query_id", "term", "weight", F.coalesce("least", F.lit(0.0)).alias("least"))

    schema = T.StructType([queries.schema["query_id"], gains.schema["id"], T.StructField("score", T.DoubleType())])
    if few:
        shared = spark.sparkContext.broadcast(_asked_lists(queries.toPandas()))
        return gains.groupBy("block").applyInPandas(lambda rows: _block_scores(rows, shared.value, n), schema)
    batches = max(1, -(-asked.count() // BROADCAST_TERMS))
    batch = F.pmod(F.xxhash64("query_id"), F.lit(batches)).alias("batch")
    every = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")))
    left = gains.withColumn("batch", every(batches)).groupBy("block", "batch")
    right = queries.withColumn("batch", batch).withColumn("block", every(blocks)).groupBy("block", "batch")

    def match(rows: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or some.empty:
            return pd.DataFrame({"query_id": [], "id": [], "score": []})
        return _block_scores(rows, _asked_lists(some), n)

    return left.cogroup(right).applyInPandas(match, schema)


def bm25_top(index: KeywordIndex, asked: DataFrame, n: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """The ``n`` best documents of each query: ``query_id, id, score, rank``."""
    return top_n(bm25_candidates(index, asked, n, k1, b), n)


# ---- dense leg ----------------------------------------------------------------------------

BATCH_QUERIES = 4096  # queries held by a task at a time
CELL_VECTORS = 50_000  # vectors per cell when there are more queries than that


def _best(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> pd.DataFrame:
    """Exact local top-k of one block of vectors for one block of queries."""
    order = np.argsort(ids, kind="stable")
    ids, scores = ids[order], np.round(queries @ vectors[order].T, SCORE_DIGITS)
    k = min(k, len(ids))
    least = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
    picked = []
    for row, bound in zip(scores, least):
        near = np.flatnonzero(row >= bound)  # ids ascend, so equal scores keep the smaller id
        picked.append(near[np.argsort(-row[near], kind="stable")[:k]])
    best = np.stack(picked)
    return pd.DataFrame(
        {
            "query_id": np.repeat(query_ids, k),
            "id": ids[best].ravel(),
            "score": np.take_along_axis(scores, best, axis=1).ravel(),
        }
    )


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype("float64")


def dense_scores(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Exact inner-product candidates ``query_id, id, score``: at least the ``k`` best per query.

    ``vectors`` is ``id, embedding``; ``queries`` is ``query_id, embedding``. Up to
    ``BATCH_QUERIES`` queries (a counted bound, some megabytes) travel to the tasks
    that scan the vectors, which then need no shuffle. Beyond that both sides are cut
    into a grid of bounded cells, each vector block meeting each query block once.
    """
    vectors = vectors.where(F.col("embedding").isNotNull())
    queries = queries.where(F.col("embedding").isNotNull())
    schema = T.StructType(
        [
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField("id", vectors.schema["id"].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )
    head = queries.select("query_id", "embedding").limit(BATCH_QUERIES + 1).toPandas()
    if len(head) > BATCH_QUERIES:
        return _dense_grid(vectors, queries, k, schema)
    if head.empty:
        return queries.sparkSession.createDataFrame([], schema)
    shared = queries.sparkSession.sparkContext.broadcast((head["query_id"].to_numpy(), _matrix(head["embedding"])))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        query_ids, matrix = shared.value
        for batch in batches:
            if len(batch):
                yield _best(batch["id"].to_numpy(), _matrix(batch["embedding"]), query_ids, matrix, k)

    return vectors.select("id", "embedding").mapInPandas(scan, schema)


def _dense_grid(vectors: DataFrame, queries: DataFrame, k: int, schema: T.StructType) -> DataFrame:
    """Every vector cell meets every query cell; a cell holds a bounded number of rows."""
    columns = max(1, -(-queries.count() // BATCH_QUERIES))
    rows = max(1, -(-vectors.count() // CELL_VECTORS))

    def cells(df: DataFrame, key: str, mine: str, n: int, other: str, m: int) -> DataFrame:
        own = df.select(key, "embedding", F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias(mine))
        return own.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))

    left = cells(vectors, "id", "_row", rows, "_column", columns).groupBy("_row", "_column")
    right = cells(queries, "query_id", "_column", columns, "_row", rows).groupBy("_row", "_column")

    def match(v: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if v.empty or q.empty:
            return pd.DataFrame({"query_id": [], "id": [], "score": []})
        return _best(v["id"].to_numpy(), _matrix(v["embedding"]), q["query_id"].to_numpy(), _matrix(q["embedding"]), k)

    return left.cogroup(right).applyInPandas(match, schema)


# ---- fusion, reranking, context -----------------------------------------------------------


def fuse(dense: DataFrame, keyword: DataFrame, top_k: int, rrf_k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two ranked legs, each ``query_id, id, score, rank``.

    A document found by one leg only keeps a null score for the other.
    """

    def leg(df: DataFrame, name: str) -> DataFrame:
        return df.select("query_id", "id", F.col("score").alias(f"{name}_score"), F.col("rank").alias(f"{name}_rank"))

    both = leg(dense, "dense").join(leg(keyword, "bm25"), ["query_id", "id"], "full_outer")

    def share(rank: str) -> Column:
        return F.coalesce(1.0 / (rrf_k + F.col(rank)), F.lit(0.0))

    fused = both.withColumn("rrf_score", share("dense_rank") + share("bm25_rank"))
    order = Window.partitionBy("query_id").orderBy(
        F.col("rrf_score").desc(), F.col("dense_rank").asc_nulls_last(), F.col("bm25_rank").asc_nulls_last()
    )
    return fused.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= top_k)


def rerank(
    candidates: DataFrame,
    queries: DataFrame,
    chunks: DataFrame,
    top_k: int,
    scorer: Callable[[Column, Column], Column] = coverage_scorer,
    preview_chars: int | None = None,
) -> DataFrame:
    """Score each (query, passage) pair and keep the best ``top_k`` per query, numbered anew.

    ``queries`` is ``query_id, query``; ``chunks`` is ``id, source, headings, content``.
    Passages are joined only to the few candidates left. ``scorer`` may be a pandas UDF.
    """
    pairs = candidates.withColumnRenamed("rank", "recall_rank").join(queries.select("query_id", "query"), "query_id")
    pairs = pairs.join(chunks.select("id", "source", "headings", "content"), "id")
    scored = pairs.withColumn(
        "rerank_score", scorer(F.col("query"), labelled_passage(F.col("source"), F.col("headings"), F.col("content")))
    )
    order = Window.partitionBy("query_id").orderBy(F.round("rerank_score", SCORE_DIGITS).desc(), F.col("recall_rank"))
    best = scored.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= top_k)
    if preview_chars is not None:
        best = best.withColumn("content", F.left("content", F.lit(preview_chars)))
    return best


def above(hits: DataFrame, threshold: float | None, score: str = "rerank_score") -> DataFrame:
    """Drop hits below the threshold (``None`` keeps all) and close the gaps in ``rank``."""
    if threshold is None:
        return hits
    order = Window.partitionBy("query_id").orderBy("rank")
    return hits.where(F.col(score) >= threshold).withColumn("rank", F.row_number().over(order).cast("bigint"))


def contexts(hits: DataFrame, max_chars: int = 500) -> DataFrame:
    """``query_id, context``: the numbered passages of each query as one text; a query has few hits."""
    entry = F.concat(
        F.lit("["), F.col("rank").cast("string"), F.lit("] " + SOURCE_LABEL), F.coalesce("source", F.lit("")),
        F.lit("\n" + HEADING_LABEL), F.coalesce("headings", F.lit("")),
        F.lit("\n" + CONTENT_LABEL), F.left(F.coalesce("content", F.lit("")), F.lit(max_chars)),
    )
    pairs = F.array_sort(F.collect_list(F.struct("rank", entry.alias("text"))))
    return hits.groupBy("query_id").agg(F.array_join(F.transform(pairs, lambda p: p["text"]), "\n\n").alias("context"))


@dataclass
class RetrievalSettings:
    """Defaults of the question-answering service."""

    top_k: int = 8
    candidate_k: int = 30
    rerank_top_n: int = 20
    rrf_k: int = 60
    max_chars_per_doc: int = 800
    min_relevance_score: float | None = 0.0

    def per_leg(self, wanted: int | None = None) -> int:
        return max(self.candidate_k, wanted or self.rerank_top_n)


def retrieve(
    queries: DataFrame,
    query_vectors: DataFrame,
    chunks: DataFrame,
    vectors: DataFrame,
    index: KeywordIndex,
    settings: RetrievalSettings | None = None,
    scorer: Callable[[Column, Column], Column] = coverage_scorer,
) -> DataFrame:
    """Hybrid recall, rerank and threshold for a table of queries: one row per kept hit.

    ``queries`` is ``query_id, query``; ``chunks`` is ``id, source, headings, content``.
    """
    s = settings or RetrievalSettings()
    dense = top_n(dense_scores(vectors, query_vectors, s.per_leg()), s.per_leg())
    keyword = bm25_top(index, query_terms(queries, "query_id", "query"), s.per_leg())
    recalled = fuse(dense, keyword, s.rerank_top_n, s.rrf_k)
    return above(rerank(recalled, queries, chunks, s.top_k, scorer), s.min_relevance_score)


def with_context(questions: DataFrame, retrieved: DataFrame) -> DataFrame:
    """A context given with the question wins over a retrieved one."""
    given = F.nullif(F.trim(F.coalesce(F.col("given_context"), F.lit(""))), F.lit(""))
    joined = questions.join(retrieved.select("query_id", "context"), "query_id", "left")
    return joined.withColumn("context", F.coalesce(given, F.col("context"), F.lit(""))).withColumn(
        "from_retrieval", given.isNull()
    )


def needing_retrieval(questions: DataFrame) -> DataFrame:
    return questions.where(F.trim(F.coalesce(F.col("given_context"), F.lit(""))) == "")
