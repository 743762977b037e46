"""Sources, chunkers, the index and the catalogue."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from passagemill.functions.keys import hash_mod

from passagemill.operators import blocks, catalogue, chunkers, index, windows
from passagemill.operators.spread import unnest
from passagemill.plans import inputs
from passagemill.registry import Registry, duck
from passagemill.session import checkpoint_folder, read_table
from passagemill.sources import files, records, snapshots

area = Registry()


def _docs(spark, folder):
    return read_table(spark, folder, "documents")


def _scratch(spark, name: str) -> str:
    """A new folder in the shared area, for queries about files."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


# ---- chunkers --------------------------------------------------------------------------------

LINES = "lines AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents)"
_NL = "chr(10)"
_head = f"list_extract(['一、', '（二）', '3. ', '（4）', ''], cast({duck.hash_mod(5, chr(39) + 'head' + chr(39), 'doc_id', 'i')} + 1 AS bigint)) || left(line, 24)"
MARKED = f"""marked AS (SELECT doc_id, any_value(source) AS source, string_agg(CASE {duck.hash_mod(5, chr(39) + 'txt' + chr(39), 'doc_id', 'i')}
    WHEN 0 THEN {_head} || {_NL} || {_NL} || line WHEN 1 THEN {_head} || {_NL} || line ELSE line END, {_NL} || {_NL} ORDER BY i) AS text FROM lines GROUP BY doc_id)"""

_ws = duck.WS
_level = f"""CASE WHEN first = '' OR length(first) > 40 THEN 0
    WHEN regexp_matches(first, '^[一二三四五六七八九十百]+[、．.]') THEN 1
    WHEN regexp_matches(first, '^[（(][一二三四五六七八九十]+[）)]') THEN 2
    WHEN regexp_matches(first, '^\\p{{Nd}}+[.．]{_ws}') THEN 3
    WHEN regexp_matches(first, '^[（(]\\p{{Nd}}+[）)]') THEN 4
    WHEN NOT regexp_matches(first, '[，。；！？,;!?]$') THEN 2 ELSE 0 END"""


def _clean(x: str) -> str:
    out = f"regexp_replace({x}, 'DOI:[^\n]*', '', 'g')"
    out = f"regexp_replace({out}, '\n{{3,}}', chr(10) || chr(10), 'g')"
    return duck.strip(f"regexp_replace({out}, '[ \t]{{2,}}', ' ', 'g')")


BLOCKS = (
    LINES,
    MARKED,
    f"split AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array({duck.strip('text')}, '\\n{_ws}*\\n'), lambda x: {duck.strip('x')}), lambda x: x <> '') AS paras FROM marked)",
    "paras AS (SELECT doc_id, unnest(paras) AS raw, generate_subscripts(paras, 1) - 1 AS p FROM split)",
    "lined AS (SELECT *, regexp_split_to_array(raw, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]') AS ls FROM paras)",
    f"firsts AS (SELECT *, {duck.strip('ls[1]')} AS first FROM lined)",
    f"levelled AS (SELECT *, {_level} AS lv FROM firsts)",
    f"bodies AS (SELECT *, CASE WHEN lv > 0 THEN {_clean('array_to_string(ls[2:], chr(10))')} ELSE {_clean('raw')} END AS body FROM levelled)",
    """blocks AS (SELECT doc_id, p * 2 AS pos, 'heading' AS type, lv AS level, first AS text FROM bodies WHERE lv > 0
      UNION ALL SELECT doc_id, p * 2 + 1, 'paragraph', 0, body FROM bodies WHERE body <> '')""",
)
_BLOCK_COLUMNS = "doc_id, cast(pos AS bigint) AS pos, type, cast(level AS bigint) AS level, text"


@area.query("c2_text_blocks", duck.with_(*BLOCKS, select=f"SELECT {_BLOCK_COLUMNS} FROM blocks"))
def _c2(spark, folder):
    return blocks.text_blocks(inputs.marked_plain(spark, folder), "doc_id", "text")


def _last(n: int, what: str) -> str:
    return f"last_value(CASE WHEN level = {n} THEN {what} END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)"


_smaller = {n: "greatest(" + ", ".join(["-1", *[f"coalesce(p{m}, -1)" for m in range(1, n)]]) + ")" for n in range(1, 5)}


@area.query(
    "c3_heading_paths",
    duck.with_(
        *BLOCKS,
        "latest AS (SELECT *, " + ", ".join(f"{_last(n, 'pos')} AS p{n}, {_last(n, 'text')} AS t{n}" for n in range(1, 5)) + " FROM blocks)",
        select=f"SELECT {_BLOCK_COLUMNS}, concat_ws(' > ', "
        + ", ".join(f"CASE WHEN p{n} > {_smaller[n]} THEN t{n} END" for n in range(1, 5))
        + ") AS headings FROM latest",
    ),
)
def _c3(spark, folder):
    return blocks.heading_paths(blocks.text_blocks(inputs.marked_plain(spark, folder), "doc_id", "text"), "doc_id")


@area.query("c6_chunk_markdown")
def _c6(spark, folder):
    return chunkers.chunk_markdown(inputs.marked_markdown(spark, folder), "doc_id", "text")


@area.query("c7_chunk_plain")
def _c7(spark, folder):
    return chunkers.chunk_plain(inputs.marked_plain(spark, folder), "doc_id", "text")


@area.query("c8_chunk_layout")
def _c8(spark, folder):
    return chunkers.chunk_layout(inputs.layout_documents(spark, folder), "doc_id", "layout")


@area.query("c10_chunk_flat_text")
def _c10(spark, folder):
    return chunkers.chunk_flat_text(_docs(spark, folder), "doc_id", "text")


def _windows_sql(text: str, size: int, step: int, table: str = "documents", keys: str = "doc_id") -> tuple[str, ...]:
    return (
        f"src AS (SELECT {keys}, {text} AS t FROM {table})",
        f"starts AS (SELECT *, CASE WHEN length(t) <= {size} THEN [0] ELSE range(0, cast(ceil((length(t) - {size})::double / {step}) AS bigint) * {step} + 1, {step}) END AS ss FROM src)",
        f"cuts AS (SELECT {keys}, unnest(ss) AS s, t FROM starts)",
        f"pieces AS (SELECT {keys}, s, CASE WHEN length(t) <= {size} THEN t ELSE {duck.strip(f'substr(t, s + 1, {size})')} END AS content FROM cuts)",
        f"chunks AS (SELECT {keys}, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS chunk_id, content FROM pieces WHERE content <> '')",
    )


@area.query("c9_overlapped_windows", duck.with_(*_windows_sql("text", 768, 648), select="SELECT doc_id, chunk_id, content FROM chunks"))
def _c9(spark, folder):
    return windows.as_chunks(_docs(spark, folder), "doc_id", windows.overlapped(F.col("text"), 768, 120))


@area.query("c9_wide_overlap_windows", duck.with_(*_windows_sql("text", 500, 100), select="SELECT doc_id, chunk_id, content FROM chunks"))
def _c9_wide(spark, folder):
    return windows.as_chunks(_docs(spark, folder), "doc_id", windows.layout_pieces(F.col("text"), 500, 400))


_NO_BLANK = (
    f"array_to_string(list_filter(list_transform(string_split({duck.newlines('text')}, chr(10)), lambda x: {duck.strip('x')}), lambda x: x <> ''), chr(10))"
)


@area.query("c9_append_windows", duck.with_(*_windows_sql(_NO_BLANK, 1000, 880), select="SELECT doc_id, chunk_id, content FROM chunks"))
def _c9_append(spark, folder):
    return windows.as_chunks(_docs(spark, folder), "doc_id", windows.append_pieces(F.col("text")))


def _pick(q: str) -> str:
    return f"max(len) FILTER (WHERE rn = cast(floor((n - 1) * {q}::double) AS bigint) + 1)"


@area.query(
    "c11_length_profile",
    duck.with_(
        *_windows_sql("text", 768, 648, keys="doc_id, source"),
        "sized AS (SELECT source, length(content)::double AS len, row_number() OVER (PARTITION BY source ORDER BY length(content)) AS rn, count(*) OVER (PARTITION BY source) AS n FROM chunks)",
        select=f"""SELECT source, {_pick('0.5')} AS p50, {_pick('0.9')} AS p90, {_pick('0.95')} AS p95, max(len) AS longest, any_value(n) AS chunks,
          {_pick('0.95')} < 345 AS too_small, max(len) > 768 AS too_long FROM sized GROUP BY source""",
    ),
)
def _c11(spark, folder):
    docs = _docs(spark, folder)
    chunks = unnest(docs, ["source"], windows.overlapped(F.col("text"), 768, 120), "content")
    return windows.length_profile(chunks, ["source"], "content", 768)


# ---- index -----------------------------------------------------------------------------------

NUMBERED = (
    *_windows_sql("text", 768, 648, keys="doc_id, source, lang"),
    "numbered AS (SELECT source || '/' || doc_id AS source, lang AS category, chunk_id, content, row_number() OVER (ORDER BY sha1(source || '/' || doc_id), source || '/' || doc_id, chunk_id) - 1 AS vec_id FROM (SELECT c.*, lang AS l FROM chunks c))",
)


def _chunks(spark, folder):
    """Window chunks of every document with ``source`` = ``<source>/<doc_id>``, ``category`` = language."""
    fields = [F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("source"), F.col("lang").alias("category")]
    return unnest(_docs(spark, folder), fields, windows.overlapped(F.col("text"), 768, 120), "content", "chunk_id")


@area.query("d1_assign_ids", duck.with_(*NUMBERED, select="SELECT source, chunk_id, vec_id FROM numbered"))
def _d1(spark, folder):
    return index.assign_ids(_chunks(spark, folder)).select("source", "chunk_id", "vec_id")


@area.query(
    "d1_duplicate_ids",
    "SELECT id AS vec_id, count(*) AS uses FROM (SELECT doc_id // 3 * CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 3 END AS id FROM documents) GROUP BY id HAVING count(*) > 1",
)
def _d1_dup(spark, folder):
    ids = _docs(spark, folder).select((F.floor(F.col("doc_id") / 3) * F.when(F.col("doc_id") % 5 == 0, 1).otherwise(3)).alias("vec_id"))
    return index.duplicate_ids(ids)


def _index_chunks(spark, folder):
    return _docs(spark, folder).select(
        F.col("doc_id").alias("vec_id"), F.lit(0).cast("bigint").alias("chunk_id"), "source", F.col("lang").alias("category"),
        F.col("lang").alias("headings"), F.col("text").alias("content"),
    )


def _vectors(spark, folder):
    return inputs.document_vectors(spark, folder).withColumnRenamed("id", "vec_id")


_INDEX = f"idx AS (SELECT doc_id AS vec_id, 0 AS chunk_id, source, lang AS category, lang AS headings, text AS content, embedding FROM documents JOIN embeddings ON {inputs.VECTOR_OF_DOCUMENT} = vec_id)"


@area.query("d2_build_index", duck.with_(_INDEX, select="SELECT vec_id, source, content, len(embedding) AS dim FROM idx"))
def _d2(spark, folder):
    built = index.build_index(_index_chunks(spark, folder), _vectors(spark, folder))
    return built.select("vec_id", "source", "content", F.size("embedding").alias("dim"))


_NEW = (
    *_windows_sql(_NO_BLANK, 1000, 880, table="documents", keys="doc_id, lang"),
    "fresh AS (SELECT 'new/' || doc_id AS source, chunk_id, content, row_number() OVER (ORDER BY sha1('new/' || doc_id), 'new/' || doc_id, chunk_id) AS n FROM chunks)",
)


@area.query(
    "d3_append_documents",
    duck.with_(
        _INDEX, *_NEW,
        select="""SELECT vec_id, source, content FROM idx UNION ALL
          SELECT (SELECT max(vec_id) FROM idx) + n, source, content FROM fresh""",
    ),
)
def _d3(spark, folder):
    built = index.build_index(_index_chunks(spark, folder), _vectors(spark, folder))
    new = _docs(spark, folder).select(
        F.concat(F.lit(" new/"), F.col("doc_id").cast("string")).alias("source"), F.lit("").alias("headings"),
        F.col("lang").alias("category"), F.lit("v2").alias("version"), "text",
    )
    return index.append_documents(built, new).select("vec_id", "source", "content")


def _gone(spark, folder):
    sources = _docs(spark, folder).select("source").distinct()
    return sources.where(hash_mod(4, "gone", F.col("source")) == 0).select(F.concat(F.col("source"), F.lit(" ")).alias("source"))


_GONE = f"gone AS (SELECT DISTINCT source FROM documents WHERE {duck.hash_mod(4, chr(39) + 'gone' + chr(39), 'source')} = 0)"


@area.query("d4_delete_sources", duck.with_(_INDEX, _GONE, select="SELECT vec_id, source, content FROM idx WHERE source NOT IN (SELECT source FROM gone)"))
def _d4(spark, folder):
    built = index.build_index(_index_chunks(spark, folder), _vectors(spark, folder))
    return index.delete_sources(built, _gone(spark, folder)).select("vec_id", "source", "content")


@area.query("d4_delete_report", duck.with_(_GONE, select="SELECT count(*) AS before, count(*) FILTER (WHERE source NOT IN (SELECT source FROM gone)) AS after FROM documents"))
def _d4_report(spark, folder):
    return index.delete_report(_index_chunks(spark, folder), _gone(spark, folder))


@area.query(
    "s12_alignment",
    """SELECT count(doc_id) AS chunks, count(vec_id) AS vectors, count(*) FILTER (WHERE vec_id IS NULL) AS chunks_without_vector,
      count(*) FILTER (WHERE doc_id IS NULL) AS vectors_without_chunk, count(*) FILTER (WHERE vec_id IS NULL OR doc_id IS NULL) = 0 AS aligned
    FROM documents FULL JOIN embeddings ON doc_id = vec_id""",
)
def _s12(spark, folder):
    return index.alignment_report(_index_chunks(spark, folder), read_table(spark, folder, "embeddings").select("vec_id", "embedding"))


@area.query("s12_snapshot", duck.with_(_INDEX, select="SELECT vec_id, source, content FROM idx"))
def _s12_snapshot(spark, folder):
    store = snapshots.SnapshotStore(spark, _scratch(spark, "snapshot"))
    store.commit(index.build_index(_index_chunks(spark, folder), _vectors(spark, folder)))
    return store.read().select("vec_id", "source", "content")


# ---- catalogue -------------------------------------------------------------------------------

DAY = "timestamp'2024-01-01 00:00:00'"


def _source_chunks(spark, folder):
    """Chunk rows with several documents per source, padded and missing values."""
    return _docs(spark, folder).select(
        F.col("doc_id").alias("vec_id"),
        F.concat(F.lit(" "), F.col("source")).alias("source"),
        F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("T"), F.col("doc_id").cast("string"))).alias("title"),
        F.when(F.col("doc_id") % 4 != 1, F.col("lang")).alias("category"),
    )


DOCUMENTS_OF = (
    """src_chunks AS (SELECT doc_id AS vec_id, source, CASE WHEN doc_id % 3 <> 0 THEN 'T' || doc_id END AS title, CASE WHEN doc_id % 4 <> 1 THEN lang END AS category FROM documents)""",
    """incoming AS (SELECT sha1(source) AS ingest_key, coalesce(arg_min(coalesce(title, '未知'), vec_id)) AS title, arg_min_null(category, vec_id) AS category, source,
      coalesce(array_to_string(list_sort(list(DISTINCT category) FILTER (WHERE category IS NOT NULL)), '|'), '') AS tags FROM src_chunks GROUP BY source)""",
)


def _flat_tags(df):
    return df.withColumn("tags", F.array_join("tags", "|"))


@area.query("d5_documents_of_chunks", duck.with_(*DOCUMENTS_OF, select="SELECT ingest_key, title, category, source, tags FROM incoming"))
def _d5(spark, folder):
    return _flat_tags(catalogue.documents_of(_source_chunks(spark, folder)).drop("version"))


def _catalogue(spark, folder):
    """A catalogue of two documents in three, from earlier index runs, uploads and hand entry."""
    rows = _docs(spark, folder).where(F.col("doc_id") % 3 != 0)
    key = F.when(F.col("doc_id") < 40, F.concat(F.lit("src"), F.col("doc_id").cast("string"))).otherwise(F.concat(F.lit("old"), F.col("doc_id").cast("string")))
    return rows.select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("old title "), F.col("doc_id").cast("string")).alias("title"),
        F.col("lang").alias("category"),
        key.alias("source"),
        F.lit("v1").alias("version"),
        F.array(F.col("lang")).alias("tags"),
        (F.col("doc_id") % 7).alias("updated_by"),
        F.element_at(F.array(F.lit("manual"), F.lit("text_upload"), F.lit("faiss_sync")), (F.col("doc_id") % 4 % 3 + 1).cast("int")).alias("ingest_source"),
        F.sha1(F.encode(key, "UTF-8")).alias("ingest_key"),
        F.expr(DAY).alias("created_at"),
        (F.expr(DAY) + F.make_dt_interval(secs=F.col("doc_id"))).alias("updated_at"),
        (F.col("doc_id") % 5 == 0).alias("is_deleted"),
    )


CATALOGUE = (
    "keyed AS (SELECT *, CASE WHEN doc_id < 40 THEN 'src' || doc_id ELSE 'old' || doc_id END AS k FROM documents WHERE doc_id % 3 <> 0)",
    """cat AS (SELECT doc_id AS id, 'old title ' || doc_id AS title, lang AS category, k AS source, 'v1' AS version, lang AS tags, doc_id % 7 AS updated_by,
      list_extract(['manual', 'text_upload', 'faiss_sync'], cast(doc_id % 4 % 3 + 1 AS bigint)) AS ingest_source, sha1(k) AS ingest_key,
      0 AS created, doc_id AS updated, doc_id % 5 = 0 AS is_deleted FROM keyed)""",
)


def _shown(df):
    """Times as seconds since the first day, tags as text."""
    base = F.unix_timestamp(F.expr(DAY))
    return _flat_tags(df).select(
        "id", "title", "category", "source", "version", "tags", "updated_by", "ingest_source", "ingest_key",
        (F.unix_timestamp("created_at") - base).alias("created"), (F.unix_timestamp("updated_at") - base).alias("updated"), "is_deleted",
    )


_NOW = 10_000_000


def _now():
    return F.expr(DAY) + F.make_dt_interval(secs=F.lit(_NOW))


def _merged(old: str, incoming_source: str, keep_by: bool) -> str:
    by = "o.updated_by" if keep_by else "CASE WHEN n.ingest_key IS NOT NULL THEN 42 ELSE o.updated_by END"
    return f"""WITH_OLD AS (SELECT * FROM {old}),
    added AS (SELECT ingest_key, row_number() OVER (ORDER BY sha1(ingest_key), ingest_key) AS rn FROM incoming WHERE ingest_key NOT IN (SELECT ingest_key FROM WITH_OLD)),
    merged AS (SELECT coalesce(o.id, (SELECT max(id) FROM cat) + a.rn) AS id,
      CASE WHEN n.ingest_key IS NOT NULL THEN n.title ELSE o.title END AS title, CASE WHEN n.ingest_key IS NOT NULL THEN n.category ELSE o.category END AS category,
      coalesce(n.source, o.source) AS source, CASE WHEN n.ingest_key IS NOT NULL THEN NULL ELSE o.version END AS version,
      coalesce(n.tags, o.tags, '') AS tags, cast({by} AS bigint) AS updated_by, CASE WHEN n.ingest_key IS NOT NULL THEN '{incoming_source}' ELSE o.ingest_source END AS ingest_source,
      coalesce(n.ingest_key, o.ingest_key) AS ingest_key, cast(coalesce(o.created, {_NOW}) AS bigint) AS created,
      cast(CASE WHEN n.ingest_key IS NOT NULL THEN {_NOW} ELSE o.updated END AS bigint) AS updated, CASE WHEN n.ingest_key IS NOT NULL THEN false ELSE o.is_deleted END AS is_deleted
      FROM WITH_OLD o FULL JOIN incoming n ON o.ingest_key = n.ingest_key LEFT JOIN added a ON a.ingest_key = n.ingest_key)"""


@area.query(
    "d6_refresh_catalogue",
    duck.with_(*DOCUMENTS_OF, *CATALOGUE, _merged("cat WHERE ingest_source <> 'faiss_sync'", "faiss_sync", True), select="SELECT * FROM merged"),
)
def _d6(spark, folder):
    incoming = catalogue.documents_of(_source_chunks(spark, folder))
    return _shown(catalogue.refresh(_catalogue(spark, folder), incoming, _now()))


@area.query("d7_upsert_uploads", duck.with_(*DOCUMENTS_OF, *CATALOGUE, _merged("cat", "text_upload", False), select="SELECT * FROM merged"))
def _d7(spark, folder):
    incoming = catalogue.documents_of(_source_chunks(spark, folder))
    return _shown(catalogue.upsert(_catalogue(spark, folder), incoming, catalogue.FROM_UPLOAD, _now(), F.lit(42)))




@area.query(
    "d8_partial_update",
    duck.with_(
        *CATALOGUE,
        """changes AS (SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN event_type END AS title, CASE WHEN event_id % 3 = 0 THEN 'c' || user_id END AS category FROM events)""",
        select="""SELECT c.id, CASE WHEN NOT is_deleted THEN coalesce(h.title, c.title) ELSE c.title END AS title,
          CASE WHEN NOT is_deleted THEN coalesce(h.category, c.category) ELSE c.category END AS category, c.source FROM cat c LEFT JOIN changes h ON h.id = c.id""",
    ),
)
def _d8(spark, folder):
    changes = read_table(spark, folder, "events").select(
        F.col("event_id").alias("id"),
        F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("title"),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("c"), F.col("user_id").cast("string"))).alias("category"),
    )
    rows = catalogue.patch(_catalogue(spark, folder), changes, "id", ["title", "category"], ~F.col("is_deleted"))
    return rows.select("id", "title", "category", "source")


@area.query(
    "d9_soft_delete",
    duck.with_(*CATALOGUE, select="SELECT id, is_deleted OR id IN (SELECT event_id FROM events WHERE event_type = 'error') AS is_deleted FROM cat"),
)
def _d9(spark, folder):
    gone = read_table(spark, folder, "events").where(F.col("event_type") == "error").select(F.col("event_id").alias("id"))
    return catalogue.soft_delete(_catalogue(spark, folder), gone).select("id", "is_deleted")


def status_log(events):
    """The event table read as a log of index work, one index per user."""
    failed = F.col("value") > 20
    kind = F.when(F.col("event_type") == "view", "start").when(F.col("event_type").isin("click", "purchase"), "finish").otherwise("edit")
    status = catalogue.status_after(kind, failed)
    error = F.when(status == "error", F.concat(F.lit("failed at "), F.col("event_id").cast("string")))
    return events.select("user_id", "ts", F.col("event_id").alias("seq"), status.alias("status"), error.alias("error"))


STATUS_LOG = """log AS (SELECT user_id, ts, event_id AS seq, CASE WHEN event_type = 'view' THEN 'running' WHEN event_type IN ('click', 'purchase') AND value > 20 THEN 'error'
      WHEN event_type IN ('click', 'purchase') THEN 'synced' ELSE 'dirty' END AS status FROM events)"""


@area.query(
    "d10_index_status",
    duck.with_(
        STATUS_LOG,
        "ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, seq DESC) AS rn FROM log)",
        select="""SELECT user_id, max(status) FILTER (WHERE rn = 1) AS status, max(CASE WHEN status = 'error' THEN 'failed at ' || seq END) FILTER (WHERE rn = 1) AS last_error,
          epoch_us(max(ts) FILTER (WHERE status = 'synced')) AS last_reindexed_at, epoch_us(max(ts)) AS updated_at FROM ranked GROUP BY user_id""",
    ),
)
def _d10(spark, folder):
    rows = catalogue.current_status(status_log(read_table(spark, folder, "events")), ["user_id"])
    return rows.withColumns({c: F.unix_micros(F.col(c).cast("timestamp")) for c in ("last_reindexed_at", "updated_at")})


@area.query(
    "d11_catalogue_page",
    duck.with_(
        *CATALOGUE,
        select="""SELECT id, title, source, (SELECT count(*) FROM cat WHERE NOT is_deleted AND (title ILIKE '%1%' OR category ILIKE '%1%' OR source ILIKE '%1%')) AS total
          FROM cat WHERE NOT is_deleted AND (title ILIKE '%1%' OR category ILIKE '%1%' OR source ILIKE '%1%') ORDER BY updated DESC, id DESC LIMIT 50 OFFSET 50""",
    ),
)
def _d11(spark, folder):
    return catalogue.page(_catalogue(spark, folder), "1", number=2, size=80).select("id", "title", "source", "total")


# ---- sources ---------------------------------------------------------------------------------


@area.query("s4_canonical_chunks", "SELECT doc_id, source, text AS content FROM documents WHERE doc_id % 9 <> 4")
def _s4(spark, folder):
    path = _scratch(spark, "chunk-files")
    rows = _docs(spark, folder).select(
        F.col("doc_id").alias("chunk_id"), "source", F.col("lang").alias("category"),
        F.when(F.col("doc_id") % 9 != 4, F.lit("")).alias("headings"), F.col("text").alias("content"),
    )
    rows.write.json(path)
    kept = records.canonical_chunks(spark.read.schema(records.CHUNK_SCHEMA).json(path))
    return kept.select(F.col("chunk_id").alias("doc_id"), "source", "content")


_LINE = "CASE WHEN event_id % 7 = 0 THEN '' WHEN event_id % 7 = 1 THEN substr(props, 2) WHEN event_id % 7 = 2 THEN '[1]' ELSE props END"


@area.query(
    "s5_tolerant_records", "SELECT event_id, cast(json_extract_string(props, '$.k') AS bigint) AS k FROM events WHERE event_id % 7 > 2"
)
def _s5(spark, folder):
    lines = read_table(spark, folder, "events").select("event_id", F.expr(_LINE).alias("value"))
    return records.tolerant_records(lines, "k bigint")


@area.query(
    "s6_strict_records", "SELECT event_id, cast(json_extract_string(props, '$.k') AS bigint) AS k FROM events WHERE event_id % 7 > 1"
)
def _s6(spark, folder):
    line = F.when(F.col("event_id") % 7 == 0, "  ").when(F.col("event_id") % 7 == 1, F.concat(F.lit("// "), F.col("props"))).otherwise(F.col("props"))
    return records.strict_records(read_table(spark, folder, "events").select("event_id", line.alias("value")), "k bigint")


@area.query(
    "s7_wrapped_records",
    """SELECT event_id, k FROM (SELECT event_id, cast(json_extract_string(props, '$.k') AS bigint) AS k FROM events
      UNION ALL SELECT event_id, user_id FROM events WHERE event_id % 5 < 4) t""",
)
def _s7(spark, folder):
    second = F.concat(F.lit('{"k": '), F.col("user_id").cast("string"), F.lit("}"))
    pair = F.concat(F.lit("["), F.col("props"), F.lit(", 7, "), second, F.lit("]"))
    kind = F.col("event_id") % 5
    wrapped = [F.concat(F.lit('{"' + n + '": '), pair, F.lit("}")) for n in ("data", "rows", "items")]
    doc = F.when(kind == 0, pair).when(kind == 1, wrapped[0]).when(kind == 2, wrapped[1]).when(kind == 3, wrapped[2]).otherwise(F.col("props"))
    return records.items_of(read_table(spark, folder, "events").select("event_id", doc.alias("value")), "k bigint")


@area.query(
    "s8_question_pool",
    f"""WITH q AS (SELECT doc_id, CASE doc_id % 4 WHEN 3 THEN '问题：' || text || '检索资料：' || lang ELSE text END AS t FROM documents)
    SELECT doc_id, {duck.collapse("CASE doc_id % 4 WHEN 3 THEN string_split(string_split(t, '问题：')[2], '检索资料：')[1] ELSE t END")} AS question FROM q WHERE {duck.collapse('t')} <> ''""",
)
def _s8(spark, folder):
    prompt = F.concat(F.lit("问题："), F.col("text"), F.lit("检索资料："), F.col("lang"))
    line = (
        F.when(F.col("doc_id") % 4 == 0, F.col("text"))
        .when(F.col("doc_id") % 4 == 1, F.to_json(F.struct(F.col("text").alias("question"))))
        .when(F.col("doc_id") % 4 == 2, F.to_json(F.struct(F.col("text").alias("query"))))
        .otherwise(F.to_json(F.struct(prompt.alias("prompt"))))
    )
    return records.questions_of(_docs(spark, folder).select("doc_id", line.alias("value")))


@area.query("s9_csv_roundtrip", "SELECT doc_id, lang, text FROM documents")
def _s9(spark, folder):
    path = _scratch(spark, "csv")
    files.write_csv(_docs(spark, folder).select("doc_id", "lang", "text"), path)
    return files.read_csv(spark, path).withColumn("doc_id", F.col("doc_id").cast("bigint"))


@area.query(
    "s10_unprocessed",
    "SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = length(d.text) % 2)",
)
def _s10(spark, folder):
    found = _docs(spark, folder).select("doc_id", F.col("doc_id").alias("path"), (F.length("text") % 2).cast("int").alias("modificationTime"))
    done = read_table(spark, folder, "labels").select(F.col("doc_id").alias("path"), F.col("quality").alias("modificationTime"))
    return files.unprocessed(found, done).select("doc_id")


@area.query("s11_chunk_sink", "SELECT source, lang AS category, doc_id AS chunk_id, text AS content FROM documents")
def _s11(spark, folder):
    path = _scratch(spark, "chunks")
    rows = _docs(spark, folder).select("source", F.col("lang").alias("category"), F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    files.write_chunks(rows, path)
    return spark.read.parquet(path).select("source", F.col("category").cast("string").alias("category"), "chunk_id", "content")


_STATE = "CASE event_type WHEN 'view' THEN ' Done ' WHEN 'click' THEN 'running' WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'failed' ELSE NULL END"


@area.query(
    "s14_extraction_progress",
    f"""WITH i AS (SELECT 'b' || user_id AS batch_id, lower(trim(coalesce({_STATE}, ''))) AS state, event_id % 3 > 0 AS has_url FROM events)
    SELECT batch_id, count(*) AS files, count(*) FILTER (WHERE state IN ('done', 'failed', 'error', 'cancelled')) AS ended,
      count(*) FILTER (WHERE state = 'done' AND has_url) AS fetchable, count(*) FILTER (WHERE NOT (state = 'done' AND has_url)) AS skipped FROM i GROUP BY batch_id""",
)
def _s14(spark, folder):
    item = F.struct(
        F.col("event_id").cast("string").alias("data_id"),
        F.expr(_STATE).alias("state"),
        F.when(F.col("event_id") % 3 > 0, F.lit("https://files.example.com/x.zip")).alias("full_zip_url"),
    )
    data = F.struct(F.concat(F.lit("b"), F.col("user_id").cast("string")).alias("batch_id"), F.array(item).alias("extract_result"))
    reply = F.to_json(F.struct(F.lit(0).alias("code"), data.alias("data")))
    return records.extraction_progress(records.extraction_items(read_table(spark, folder, "events").select(reply.alias("value"))))


_HREFS = "regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)"
_CATS = "regexp_extract_all(html, '<li>([^<]*)</li>', 1)"
_TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"


def _articles(spark, folder):
    return read_table(spark, folder, "pages").select(
        F.col("page_id").alias("pageid"),
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        "url",
        F.regexp_extract_all("html", F.lit("<li><a[^>]*>([^<]*)</a>"), F.lit(1)).alias("categories"),
        F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)).alias("links"),
        F.replace("html", F.lit("<p>"), F.lit("\n ")).alias("text"),
    )


@area.query(
    "s15_article_records",
    f"""WITH a AS (SELECT page_id, {_TITLE} AS title, url, regexp_extract_all(html, '<li><a[^>]*>([^<]*)</a>', 1) AS cats, {_HREFS} AS links, replace(html, '<p>', chr(10) || ' ') AS text FROM pages)
    SELECT page_id AS pageid, replace(title, ',', '，') AS title, length(text) AS word_count, replace(array_to_string(cats[1:5], '|'), ',', '；') AS categories,
      array_to_string(links[1:50], ' ') AS links,
      array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: {duck.strip('x')}), lambda x: x <> ''), '|') AS paragraphs FROM a""",
)
def _s15(spark, folder):
    found = records.article_records(_articles(spark, folder))
    extra = found.select("pageid", F.array_join("links", " ").alias("links"), F.array_join("paragraphs", "|").alias("paragraphs"))
    return records.article_index(found).drop("url").join(extra, "pageid")


@area.query(
    "s16_first_seen_articles",
    """WITH h AS (SELECT lang, doc_id // 2 AS pageid, length(text) % 5 AS query_pos, doc_id AS hit_pos, length(text) AS word_count FROM documents),
    f AS (SELECT *, row_number() OVER (PARTITION BY lang, pageid ORDER BY query_pos, hit_pos) AS rn FROM h)
    SELECT lang, count(*) AS articles, cast(sum(word_count) AS bigint) AS chars FROM f WHERE rn = 1 GROUP BY lang""",
)
def _s16(spark, folder):
    hits = _docs(spark, folder).select(
        "lang", F.floor(F.col("doc_id") / 2).alias("pageid"), (F.length("text") % 5).alias("query_pos"), F.col("doc_id").alias("hit_pos"),
        F.length("text").cast("bigint").alias("word_count"),
    )
    return records.article_totals(records.first_seen_articles(hits))
