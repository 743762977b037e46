"""The numbered operators as queries over the given tables, with the columns that their contracts fix."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill.llm import filter_audit, hard_negatives, html_text, licenses, line_dedup, mixing, near_dedup, packing, pii, quality, substrings, topk, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    vectors = topk.quantised(table(spark, folder, "embeddings"))
    found = topk.exact_top_k(vectors.where(F.col("vec_id") % 50 == 0), vectors, k=5)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op2_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, folder, "documents"), tokenizer_path())
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, folder, "documents"))
    sha = F.sha2(F.encode("kept_text", "UTF-8"), 256)
    return out.select(F.col("doc.doc_id").alias("doc_id"), "n_lines", "n_dropped", sha.alias("kept_sha256"))


def op4_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = near_dedup.near_duplicates(table(spark, folder, "documents"))
    return found.select(F.col("id").alias("doc_id"), "class_id", (F.col("id") == F.col("class_id")).alias("kept"))


def op5_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.repeated_spans(table(spark, folder, "documents")).withColumnRenamed("id", "doc_id").withColumnRenamed("first_id", "first_doc_id")


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return toxicity.scored(docs, toxicity.trained(docs, table(spark, folder, "labels")))


def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judged(table(spark, folder, "documents")).select(
        F.col("doc.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op8_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    out = mixing.produced(table(spark, folder, "documents"), table(spark, folder, "labels"), ["doc_id"])
    likely = F.array_max(F.transform(F.map_entries("posterior"), lambda e: F.struct(e["value"].alias("p"), e["key"].alias("domain"))))
    return out.select(
        F.col("doc.doc_id").alias("doc_id"), "n_tokens", likely["domain"].alias("domain"), likely["p"].alias("domain_p"), "rate", "copies"
    )


def op9_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents")).drop("matches")


def op10_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return html_text.main_text(pages, html_text.trained(pages)).withColumn("n_chars", F.length("text").cast("long"))


def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    rows = hard_negatives.labelled(table(spark, folder, "embeddings"), moved)
    return hard_negatives.hard_negatives(rows, rows.where(F.col("vec_id") % 100 == 0))


def op12_pii(spark: SparkSession, folder: str) -> DataFrame:
    out = pii.counted(pii.found(table(spark, folder, "documents")))
    return out.select(F.col("doc.doc_id").alias("doc_id"), "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def op13_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


def queries() -> dict[str, Query]:
    made = (
        op1_exact_top_k, op2_best_fit_packing, op3_line_dedup, op4_near_dedup, op5_substring_dedup, op6_toxicity, op7_quality_rules,
        op8_source_mixing, op9_license_scan, op10_html_extraction, op11_hard_negatives, op12_pii, op13_filter_audit,
    )
    return {query.__name__: query for query in made}


def oracle_sql() -> dict[str, str]:
    return SQL | {"op12_pii": _pii_sql(SQL["op12_pii"])}


def _pii_sql(template: str) -> str:
    """Patterns in the form of DuckDB's engine, which never goes back and has no lookaround."""
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        "iban": r"\b[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)\b",
        "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "birth": r"\b(?:19|20)[0-9]{2}-[01][0-9]-[0-3][0-9]\b",
    }
    proposals = [
        f"SELECT row, '{k.name}' AS kind, {i} AS listed, '(?:^|[^a-z])(?:{'|'.join(k.context)})(?:[^a-z]|$)' AS near, {k.confidence} AS confidence, "
        f"regexp_extract_all(text, '{plain[k.name]}') AS hits, string_split_regex(text, '{plain[k.name]}') AS gaps FROM d"
        for i, k in enumerate(pii.KINDS)
    ]
    filled = {"{proposals}": " UNION ALL ".join(proposals), "{upper}": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "{lower}": "abcdefghijklmnopqrstuvwxyz"}
    for mark, value in filled.items():
        template = template.replace(mark, value)
    return template


SQL = {
    "op1_exact_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS DOUBLE)) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""",
    "op3_line_dedup": r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents
), k AS (
  SELECT *, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key
  FROM l
), c AS (
  SELECT key, max(doc_id) AS last_id FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), m AS (
  SELECT k.*, c.key IS NULL OR k.doc_id = c.last_id AS stays FROM k LEFT JOIN c ON k.key = c.key
)
SELECT doc_id, count(*) AS n_lines, count(*) - count(*) FILTER (WHERE stays) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE stays), '')) AS kept_sha256
FROM m GROUP BY doc_id""",
    "op11_hard_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS DOUBLE)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.x, c.x) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id
), p AS (
  SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM s WHERE same
), n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
  WHERE p.place <= 5
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10""",
    "op12_pii": r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents
), p AS (
  {proposals}
), h AS (
  SELECT row, kind, listed, near, confidence, n, hits[n] AS hit, gaps[n] AS gap, gaps[n + 1] AS rest
  FROM p, unnest(range(1, len(hits) + 1)) AS u(n)
), s AS (
  SELECT *, CAST(sum(length(gap) + length(hit)) OVER (PARTITION BY row, kind ORDER BY n) AS BIGINT) AS stop,
         regexp_replace(hit, '[^0-9]', '', 'g') AS digits, replace(hit, ' ', '') AS bare,
         CASE WHEN regexp_matches(translate(right(gap, 48), '{upper}', '{lower}'), near)
                OR regexp_matches(translate(left(rest, 24), '{upper}', '{lower}'), near) THEN 0.3 ELSE 0 END AS gain
  FROM h
), v AS (
  SELECT row, kind, listed, stop - length(hit) AS start, stop,
    CASE kind
      WHEN 'email' THEN true
      WHEN 'ip' THEN len(list_filter(string_split(hit, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(TRY_CAST(ltrim(x, '0') AS BIGINT), 0) > 255)) = 0
      WHEN 'card' THEN length(digits) BETWEEN 12 AND 19 AND list_sum([
          CASE WHEN (length(digits) - i) % 2 = 0 THEN CAST(digits[i] AS INT)
               WHEN CAST(digits[i] AS INT) > 4 THEN 2 * CAST(digits[i] AS INT) - 9 ELSE 2 * CAST(digits[i] AS INT) END
          for i in range(1, least(length(digits), 19) + 1)]) % 10 = 0
      WHEN 'phone' THEN length(digits) BETWEEN 9 AND 15
      WHEN 'iban' THEN length(bare) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0, [
          CASE WHEN ascii(c) < 58 THEN ascii(c) - 48 ELSE ascii(c) - 55 END for c in string_split(substr(bare, 5, 30) || left(bare, 4), '')]),
          lambda r, x: CASE WHEN x < 10 THEN r * 10 + x ELSE r * 100 + x END % 97) = 1
      WHEN 'ssn' THEN NOT regexp_matches(hit, '^(?:000|666|9)|-00-|-0000$') AND confidence + gain >= 0.6
      ELSE TRY_CAST(hit AS DATE) IS NOT NULL AND confidence + gain >= 0.6
    END AS good
  FROM s
), o AS (
  SELECT row, listed, kind, start, kind || ':' || start || ':' || stop AS span FROM v WHERE good
)
SELECT doc_id, count(*) FILTER (WHERE kind = 'email') AS n_email, count(*) FILTER (WHERE kind = 'ip') AS n_ip,
       count(*) FILTER (WHERE kind = 'card') AS n_card, count(*) FILTER (WHERE kind = 'phone') AS n_phone,
       sha256(coalesce(string_agg(span, ',' ORDER BY start, listed) FILTER (WHERE listed < 4), '')) AS base_sha256,
       coalesce(string_agg(span, ',' ORDER BY start, listed), '') AS spans
FROM d LEFT JOIN o USING (row) GROUP BY row, doc_id""",
    "op13_filter_audit": r"""
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first_id FROM t
), m AS (
  SELECT doc_id, part,
         CAST(len(words) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(words)) < 50 * len(words) AS INT)
         + 4 * CAST(100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) AS INT)
         + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(first_id < doc_id, false) AS INT) AS mask
  FROM w
), l AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id
), c AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE l.good) AS good, count(*) FILTER (WHERE l.toxic) AS toxic
  FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask
), f AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit
), o AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), s AS (
  SELECT filter_order, step, bits[step] AS bit, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INT) AS before
  FROM o, unnest(range(1, 6)) AS u(step)
), r AS (
  SELECT part, filter_order, CAST(step AS INT) AS step, bit,
         coalesce(sum(n) FILTER (WHERE mask & (before | bit) = 0), 0) AS kept,
         coalesce(sum(n) FILTER (WHERE mask & before = 0 AND mask & bit > 0), 0) AS removed,
         coalesce(sum(n) FILTER (WHERE mask & before > 0 AND mask & bit > 0), 0) AS redundant,
         coalesce(sum(n) FILTER (WHERE mask = bit), 0) AS unique_fails,
         coalesce(sum(good) FILTER (WHERE mask & before = 0 AND mask & bit > 0), 0) AS good_lost,
         coalesce(sum(toxic) FILTER (WHERE mask & before = 0 AND mask & bit > 0), 0) AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM r""",
}
