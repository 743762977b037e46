"""Retrieval, model seams and recall."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.functions.text import keyword_text
from passagemill.operators import encode as E
from passagemill.operators import recall as V
from passagemill.operators import retrieve as R
from passagemill.plans import inputs
from passagemill.registry import Registry, duck
from passagemill.session import read_table

area = Registry()

# ---- shared SQL ----------------------------------------------------------------------------

ASKED = f"asked AS (SELECT item_id AS query_id, array_to_string({duck.tokens('text')}[1:4], ' ') AS query FROM benchmark)"
PASSAGES = "asked AS (SELECT item_id AS query_id, text AS query FROM benchmark)"
CHUNKS = f"chunks AS (SELECT doc_id AS id, source, lang AS headings, text AS content, embedding FROM documents JOIN embeddings ON {inputs.VECTOR_OF_DOCUMENT} = vec_id)"
QREL = "qrel AS (SELECT item_id AS query_id, doc_id AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
DENSE = (
    "qvec AS (SELECT item_id AS query_id, embedding FROM benchmark JOIN embeddings ON item_id = vec_id)",
    "dense_all AS (SELECT query_id, id, round(list_inner_product(cast(q.embedding AS double[]), cast(c.embedding AS double[])), 9) AS score FROM qvec q, chunks c)",
    "dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM dense_all)",
)


def bm25(table: str, id_col: str, text: str) -> tuple[str, ...]:
    return (
        f"toks AS (SELECT {id_col} AS id, {duck.tokens(text)} AS t FROM {table})",
        "lens AS (SELECT id, cast(len(t) AS bigint) AS length FROM toks)",
        "post AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(t) AS term FROM toks) GROUP BY ALL)",
        "nums AS (SELECT count(*) AS n, avg(length) AS mean FROM lens)",
        "terms AS (SELECT term, count(*) AS df, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM post, nums GROUP BY term)",
        f"qterms AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({duck.tokens('query')}) AS term FROM asked) GROUP BY ALL)",
        "scores AS (SELECT query_id, p.id, sum(qtf * idf * (tf * 2.5) / (tf + 1.5 * (1 - 0.75 + 0.75 * length / mean))) AS score "
        "FROM qterms q JOIN post p USING (term) JOIN terms USING (term) JOIN lens l ON l.id = p.id, nums GROUP BY query_id, p.id)",
        "keyword AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM scores)",
    )


DOC_BM25 = bm25("documents", "doc_id", "text")
CHUNK_BM25 = bm25("chunks", "id", "source || ' ' || headings || ' ' || content")


def fused(per_leg: int, top_k: int) -> tuple[str, ...]:
    return (
        f"""paired AS (SELECT coalesce(d.query_id, k.query_id) AS query_id, coalesce(d.id, k.id) AS id, d.score AS dense_score, k.score AS bm25_score,
          d.rank AS dense_rank, k.rank AS bm25_rank FROM (SELECT * FROM dense WHERE rank <= {per_leg}) d
          FULL JOIN (SELECT * FROM keyword WHERE rank <= {per_leg}) k ON d.query_id = k.query_id AND d.id = k.id)""",
        "rrf AS (SELECT *, coalesce(1.0::double / (60 + dense_rank), 0.0::double) + coalesce(1.0::double / (60 + bm25_rank), 0.0::double) AS rrf_score FROM paired)",
        "ordered AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, dense_rank ASC NULLS LAST, bm25_rank ASC NULLS LAST) AS rank FROM rrf)",
        f"fused AS (SELECT * FROM ordered WHERE rank <= {top_k})",
    )


LABELLED = "'来源: ' || source || chr(10) || '标题: ' || headings || chr(10) || '内容: ' || content"


def reranked(top_k: int) -> tuple[str, ...]:
    q, p = f"list_distinct({duck.tokens('query')})", duck.tokens(LABELLED)
    return (
        f"pairs AS (SELECT f.*, query, source, headings, content, {q} AS qt, {p} AS pt FROM fused f JOIN asked USING (query_id) JOIN chunks c USING (id))",
        "scored AS (SELECT *, CASE WHEN len(qt) = 0 THEN 0.0::double ELSE len(list_intersect(qt, pt))::double / len(qt) END AS rerank_score FROM pairs)",
        "ranked AS (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY query_id ORDER BY round(rerank_score, 9) DESC, rank) AS rank FROM scored)",
        f"best AS (SELECT * FROM ranked WHERE rank <= {top_k})",
    )


def kept(threshold: float) -> str:
    return (
        "kept AS (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank "
        f"FROM best WHERE rerank_score >= {threshold})"
    )


# ---- shared plans --------------------------------------------------------------------------


def _documents(spark, folder) -> DataFrame:
    return read_table(spark, folder, "documents")


def _passages(spark, folder) -> DataFrame:
    return read_table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _doc_index(spark, folder) -> R.KeywordIndex:
    return R.keyword_index(_documents(spark, folder), "doc_id", F.col("text"))


def _chunk_index(chunks: DataFrame) -> R.KeywordIndex:
    return R.keyword_index(chunks, "id", keyword_text(F.col("source"), F.col("headings"), F.col("content")))


def _bm25(index, asked) -> DataFrame:
    return R.bm25_scores(index, R.query_terms(asked, "query_id", "query"))


def _bm25_top(index, asked, n: int) -> DataFrame:
    return R.bm25_top(index, R.query_terms(asked, "query_id", "query"), n)


def _legs(spark, folder, per_leg: int):
    chunks = inputs.vector_chunks(spark, folder)
    asked = inputs.short_queries(spark, folder)
    dense = R.top_n(R.dense_scores(chunks.select("id", "embedding"), inputs.query_vectors(spark, folder), per_leg), per_leg)
    keyword = _bm25_top(_chunk_index(chunks), asked, per_leg)
    return chunks, asked, dense, keyword


def _reranked(spark, folder, per_leg=30, recall=20, top_k=8) -> DataFrame:
    chunks, asked, dense, keyword = _legs(spark, folder, per_leg)
    return R.rerank(R.fuse(dense, keyword, recall), asked, chunks, top_k)


# ---- keyword leg ---------------------------------------------------------------------------


@area.query("r1_term_statistics", duck.with_(ASKED, *DOC_BM25, select="SELECT term, df, round(idf, 6) AS idf FROM terms"))
def _r1(spark, folder):
    return _doc_index(spark, folder).terms().select("term", "df", F.round("idf", 6).alias("idf"))


@area.query("r1_corpus_statistics", duck.with_(ASKED, *DOC_BM25, select="SELECT n AS n_docs, round(mean, 6) AS avg_length FROM nums"))
def _r1_stats(spark, folder):
    return _doc_index(spark, folder).stats().select("n_docs", F.round("avg_length", 6).alias("avg_length"))


@area.query("r2_bm25_scores", duck.with_(ASKED, *DOC_BM25, select="SELECT query_id, id, round(score, 6) AS score FROM scores"))
def _r2(spark, folder):
    scores = _bm25(_doc_index(spark, folder), inputs.short_queries(spark, folder))
    return scores.select("query_id", "id", F.round("score", 6).alias("score"))


@area.query("r3_bm25_top10", duck.with_(PASSAGES, *DOC_BM25, select="SELECT query_id, id, rank, round(score, 6) AS score FROM keyword WHERE rank <= 10"))
def _r3(spark, folder):
    best = _bm25_top(_doc_index(spark, folder), _passages(spark, folder), 10)
    return best.select("query_id", "id", "rank", F.round("score", 6).alias("score"))


# ---- dense leg, fusion, rerank ---------------------------------------------------------------


@area.query("r4_dense_top10", duck.with_(CHUNKS, *DENSE, select="SELECT query_id, id, rank, round(score, 6) AS score FROM dense WHERE rank <= 10"))
def _r4(spark, folder):
    vectors = inputs.vector_chunks(spark, folder).select("id", "embedding")
    best = R.top_n(R.dense_scores(vectors, inputs.query_vectors(spark, folder), 10), 10)
    return best.select("query_id", "id", "rank", F.round("score", 6).alias("score"))


_FUSED_COLUMNS = "query_id, id, rank, round(rrf_score, 9) AS rrf_score, round(dense_score, 6) AS dense_score, round(bm25_score, 6) AS bm25_score"


@area.query("r5_rank_fusion", duck.with_(CHUNKS, ASKED, *DENSE, *CHUNK_BM25, *fused(50, 50), select=f"SELECT {_FUSED_COLUMNS} FROM fused"))
def _r5(spark, folder):
    _, _, dense, keyword = _legs(spark, folder, 50)
    return R.fuse(dense, keyword, 50).select(
        "query_id", "id", "rank", F.round("rrf_score", 9).alias("rrf_score"),
        F.round("dense_score", 6).alias("dense_score"), F.round("bm25_score", 6).alias("bm25_score"),
    )


_HYBRID = (CHUNKS, ASKED, *DENSE, *CHUNK_BM25, *fused(30, 20), *reranked(8))


@area.query("r7_rerank", duck.with_(*_HYBRID, select="SELECT query_id, id, rank, round(rerank_score, 6) AS rerank_score, left(content, 300) AS content FROM best"))
def _r7(spark, folder):
    chunks, asked, dense, keyword = _legs(spark, folder, 30)
    best = R.rerank(R.fuse(dense, keyword, 20), asked, chunks, 8, preview_chars=300)
    return best.select("query_id", "id", "rank", F.round("rerank_score", 6).alias("rerank_score"), "content")


@area.query("f5_minimum_relevance", duck.with_(*_HYBRID, kept(0.5), select="SELECT query_id, id, rank, round(rerank_score, 6) AS rerank_score FROM kept"))
def _f5(spark, folder):
    hits = R.above(_reranked(spark, folder), 0.5)
    return hits.select("query_id", "id", "rank", F.round("rerank_score", 6).alias("rerank_score"))


_CONTEXT = (
    "ctx AS (SELECT query_id, string_agg('[' || rank || '] 来源: ' || source || chr(10) || '标题: ' || headings || chr(10) || '内容: ' || left(content, 800), "
    "chr(10) || chr(10) ORDER BY rank) AS context FROM kept GROUP BY query_id)"
)


@area.query("r8_context", duck.with_(*_HYBRID, kept(0.0), _CONTEXT, select="SELECT query_id, context FROM ctx"))
def _r8(spark, folder):
    return R.contexts(R.above(_reranked(spark, folder), 0.0), 800)


@area.query(
    "r9_retrieve",
    duck.with_(*_HYBRID, kept(0.0), select="SELECT query_id, id, rank, source, headings, round(rrf_score, 9) AS rrf_score, round(rerank_score, 6) AS rerank_score FROM kept"),
)
def _r9(spark, folder):
    chunks = inputs.vector_chunks(spark, folder)
    hits = R.retrieve(
        inputs.short_queries(spark, folder),
        inputs.query_vectors(spark, folder),
        chunks.select("id", "source", "headings", "content"),
        chunks.select("id", "embedding"),
        _chunk_index(chunks),
    )
    return hits.select(
        "query_id", "id", "rank", "source", "headings", F.round("rrf_score", 9).alias("rrf_score"), F.round("rerank_score", 6).alias("rerank_score")
    )


@area.query(
    "r10_cosine",
    """WITH p AS (SELECT a.vec_id AS id, cast(a.embedding AS double[]) AS x, CASE WHEN a.vec_id % 11 = 0 THEN list_transform(cast(b.embedding AS double[]), lambda v: v * 0) ELSE cast(b.embedding AS double[]) END AS y
      FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
    n AS (SELECT id, list_inner_product(x, y) AS d, sqrt(list_inner_product(x, x)) * sqrt(list_inner_product(y, y)) AS m FROM p)
    SELECT id, round(CASE WHEN m = 0 THEN 0.0::double ELSE d / m END, 6) AS cosine FROM n""",
)
def _r10(spark, folder):
    vectors = read_table(spark, folder, "embeddings")
    a = vectors.select(F.col("vec_id").alias("id"), F.col("embedding").alias("x"))
    zeroed = F.when((F.col("vec_id") - 1) % 11 == 0, F.transform("embedding", lambda v: v * 0)).otherwise(F.col("embedding"))
    b = vectors.select((F.col("vec_id") - 1).alias("id"), zeroed.alias("y"))
    return a.join(b, "id").select("id", F.round(E.cosine(F.col("x"), F.col("y")), 6).alias("cosine"))


@area.query(
    "r11_supplied_context",
    duck.with_(
        *_HYBRID, kept(0.0), _CONTEXT,
        select="""SELECT a.query_id, CASE WHEN a.query_id % 3 = 0 THEN 'given ' || query ELSE coalesce(context, '') END AS context, a.query_id % 3 <> 0 AS from_retrieval
        FROM asked a LEFT JOIN ctx USING (query_id)""",
    ),
)
def _r11(spark, folder):
    given = F.when(F.col("query_id") % 3 == 0, F.concat(F.lit("given "), F.col("query")))
    questions = inputs.short_queries(spark, folder).withColumn("given_context", given)
    chunks = inputs.vector_chunks(spark, folder)
    open_questions = R.needing_retrieval(questions)
    hits = R.retrieve(
        open_questions.select("query_id", "query"),
        inputs.query_vectors(spark, folder).join(open_questions.select("query_id"), "query_id", "left_semi"),
        chunks.select("id", "source", "headings", "content"),
        chunks.select("id", "embedding"),
        _chunk_index(chunks),
    )
    return R.with_context(questions, R.contexts(hits, 800)).select("query_id", "context", "from_retrieval")


# ---- model seams -----------------------------------------------------------------------------

_HASHED = (
    f"words AS (SELECT id, unnest({duck.tokens('text')}) AS w FROM texts)",
    "slots AS (SELECT id, cast('0x' || substr(md5(w), 1, 8) AS bigint) % 64 AS dim, sum(1 - 2 * (cast('0x' || substr(md5(w), 9, 8) AS bigint) % 2)) AS v FROM words GROUP BY ALL)",
    "norms AS (SELECT id, sqrt(sum(v * v)::double) AS m FROM slots GROUP BY id)",
    "hashed AS (SELECT id, dim, cast(cast(v / m AS float) AS double) AS v FROM slots JOIN norms USING (id) WHERE v <> 0)",
)


def _components(df: DataFrame, *keys: str) -> DataFrame:
    rows = df.select(*keys, F.posexplode("embedding").alias("dim", "v"))
    return rows.where(F.col("v") != 0).select(*keys, F.col("dim").cast("bigint").alias("dim"), F.round(F.col("v").cast("double"), 6).alias("v"))


@area.query(
    "e1_encode",
    duck.with_("texts AS (SELECT doc_id AS id, text FROM documents)", *_HASHED, select="SELECT id AS doc_id, dim, round(v, 6) AS v FROM hashed"),
)
def _e1(spark, folder):
    return _components(E.encode(_documents(spark, folder), ["doc_id"], "text"), "doc_id")


@area.query(
    "e2_encode_distinct",
    duck.with_("texts AS (SELECT DISTINCT md5(text) AS id, text FROM documents)", *_HASHED, select="SELECT id AS text_key, dim, round(v, 6) AS v FROM hashed"),
)
def _e2(spark, folder):
    return _components(E.encode_distinct(_documents(spark, folder), "text"), "text_key")


@area.query(
    "e3_pair_scores",
    f"""WITH p AS (SELECT a.conv_id, a.turn, list_distinct({duck.tokens('a.text')}) AS q, {duck.tokens('b.text')} AS t
      FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
    SELECT conv_id, turn, round(CASE WHEN len(q) = 0 THEN 0.0::double ELSE len(list_intersect(q, t))::double / len(q) END, 6) AS score FROM p""",
)
def _e3(spark, folder):
    rows = read_table(spark, folder, "conversations")
    reply = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    pairs = rows.select("conv_id", "turn", "text").join(reply, ["conv_id", "turn"])
    return pairs.select("conv_id", "turn", F.round(E.coverage_scorer(F.col("text"), F.col("reply")), 6).alias("score"))


# ---- recall ----------------------------------------------------------------------------------

_KS = (1, 5, 10)


def _hits(source: str, keys: str = "") -> tuple[str, ...]:
    runs = f"(SELECT DISTINCT {keys} FROM {source}) m, " if keys else ""
    on = f"AND r.{keys} = m.{keys}" if keys else ""
    sel = f"m.{keys}, " if keys else ""
    group = f"m.{keys}, q.query_id, k" if keys else "q.query_id, k"
    return (
        "ks AS (SELECT unnest([1, 5, 10]) AS k)",
        f"""hits AS (SELECT {sel}q.query_id, k, cast(count(*) FILTER (WHERE g.id IS NOT NULL AND r.rank <= k) > 0 AS bigint) AS hit
          FROM {runs}(SELECT DISTINCT query_id FROM qrel) q CROSS JOIN ks
          LEFT JOIN {source} r ON r.query_id = q.query_id {on} LEFT JOIN qrel g ON g.query_id = r.query_id AND g.id = r.id GROUP BY {group})""",
    )


@area.query(
    "v2_hits",
    duck.with_(ASKED, QREL, *DOC_BM25, "top AS (SELECT * FROM keyword WHERE rank <= 10)", *_hits("top"), select="SELECT query_id, cast(k AS bigint) AS k, hit FROM hits"),
)
def _v2(spark, folder):
    ranked = _bm25_top(_doc_index(spark, folder), inputs.short_queries(spark, folder), 10)
    return V.hits_at(ranked, inputs.qrels(spark, folder), V.report_ks(_KS, 10))


@area.query(
    "v3_recall_details",
    duck.with_(
        ASKED, QREL, *DOC_BM25, "top AS (SELECT * FROM keyword WHERE rank <= 10)", *_hits("top"),
        select="""SELECT q.query_id, min(q.id) AS gold_id, any_value(predicted) AS predicted,
          max(hit) FILTER (WHERE k = 1) AS hit_at_1, max(hit) FILTER (WHERE k = 5) AS hit_at_5, max(hit) FILTER (WHERE k = 10) AS hit_at_10
          FROM qrel q JOIN hits h USING (query_id) LEFT JOIN (SELECT query_id, string_agg(id, ',' ORDER BY rank) AS predicted FROM top GROUP BY query_id) USING (query_id) GROUP BY q.query_id""",
    ),
)
def _v3(spark, folder):
    ranked = _bm25_top(_doc_index(spark, folder), inputs.short_queries(spark, folder), 10)
    judged = inputs.qrels(spark, folder).withColumn("position", F.col("id"))
    details = V.recall_details(ranked, judged, V.report_ks(_KS, 10))
    return details.withColumn("predicted", F.array_join("predicted", ","))


_RECALL = "SELECT {m}cast(k AS bigint) AS k, cast(sum(hit) AS bigint) AS hits, count(*) AS queries, round(sum(hit) / count(*), 6) AS recall FROM hits GROUP BY {m}k"


@area.query(
    "v4_recall_bm25",
    duck.with_(PASSAGES, QREL, *DOC_BM25, "top AS (SELECT * FROM keyword WHERE rank <= 10)", *_hits("top"), select=_RECALL.format(m="")),
)
def _v4(spark, folder):
    ranked = _bm25_top(_doc_index(spark, folder), _passages(spark, folder), 10)
    hits = V.hits_at(ranked, inputs.qrels(spark, folder), V.report_ks(_KS, 10))
    return V.recall_at(hits).withColumn("recall", F.round("recall", 6))


@area.query(
    "v4_recall_methods",
    duck.with_(
        CHUNKS, ASKED, *DENSE, *CHUNK_BM25, *fused(50, 20), *reranked(10), QREL,
        """runs AS (SELECT 'dense' AS method, query_id, id, rank FROM dense WHERE rank <= 10
          UNION ALL SELECT 'bm25', query_id, id, rank FROM keyword WHERE rank <= 10
          UNION ALL SELECT 'hybrid', query_id, id, rank FROM fused WHERE rank <= 10
          UNION ALL SELECT 'hybrid_rerank', query_id, id, rank FROM best)""",
        *_hits("runs", "method"), select=_RECALL.format(m="method, "),
    ),
)
def _v4_methods(spark, folder):
    chunks, asked, dense, keyword = _legs(spark, folder, 50)
    recalled = R.fuse(dense, keyword, 20)
    legs = {"dense": dense, "bm25": keyword, "hybrid": recalled, "hybrid_rerank": R.rerank(recalled, asked, chunks, 10)}
    runs = None
    for method, ranked in legs.items():
        part = ranked.where(F.col("rank") <= 10).select(F.lit(method).alias("method"), "query_id", "id", "rank")
        runs = part if runs is None else runs.unionByName(part)
    hits = V.hits_at(runs, inputs.qrels(spark, folder), V.report_ks(_KS, 10), ["method"], [(m,) for m in legs])
    return V.recall_at(hits, ["method"]).withColumn("recall", F.round("recall", 6))


@area.query(
    "v4_recall_labels",
    """WITH q AS (SELECT item_id AS query_id, embedding, label FROM benchmark JOIN embeddings ON item_id = vec_id),
    s AS (SELECT query_id, vec_id AS id, e.label = q.label AS same, row_number() OVER (PARTITION BY query_id ORDER BY
        round(list_inner_product(cast(q.embedding AS double[]), cast(e.embedding AS double[])), 9) DESC, vec_id) AS rank
      FROM q JOIN embeddings e ON vec_id <> query_id),
    h AS (SELECT query_id, k, cast(count(*) FILTER (WHERE same AND rank <= k) > 0 AS bigint) AS hit FROM s, (SELECT unnest([1, 5, 10]) AS k) GROUP BY query_id, k)
    SELECT cast(k AS bigint) AS k, cast(sum(hit) AS bigint) AS hits, count(*) AS queries, round(sum(hit) / count(*), 6) AS recall FROM h GROUP BY k""",
)
def _v4_labels(spark, folder):
    vectors = read_table(spark, folder, "embeddings")
    asked = inputs.query_vectors(spark, folder)
    near = R.dense_scores(vectors.select(F.col("vec_id").alias("id"), "embedding"), asked, 11)
    ranked = R.top_n(near.where(F.col("id") != F.col("query_id")), 10)
    labels = vectors.select(F.col("vec_id").alias("id"), "label")
    wanted = asked.select("query_id").join(labels.select(F.col("id").alias("query_id"), F.col("label").alias("wanted")), "query_id")
    # A hit needs the label of the found vector only, so the judged pairs are never listed.
    found = ranked.join(labels, "id").join(wanted, "query_id").where(F.col("label") == F.col("wanted"))
    first = wanted.select("query_id").join(found.groupBy("query_id").agg(F.min("rank").alias("first")), "query_id", "left")
    hits = first.select(
        "query_id", F.explode(F.array(*[F.lit(k) for k in _KS])).alias("k"), "first"
    ).select("query_id", "k", F.coalesce((F.col("first") <= F.col("k")).cast("bigint"), F.lit(0)).alias("hit"))
    return V.recall_at(hits).withColumn("recall", F.round("recall", 6))
