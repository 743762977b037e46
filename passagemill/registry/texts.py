"""Text projections and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from passagemill.functions import keys, predicates, prompts, text, tokens
from passagemill.operators.spread import unnest
from passagemill.registry import Registry, duck
from passagemill.session import read_table

area = Registry()

# Words of the given documents that play the part of section titles.
MARKERS = (" und ", " the ", " les ")
DOC_KEYWORDS = ("ention", "über", "TION")


def _docs(spark, folder):
    return read_table(spark, folder, "documents")


def _column(name, fn, sql):
    """A query that applies one column function to every whole document text."""

    @area.query(name, f"SELECT doc_id, {sql} AS value FROM documents")
    def run(spark, folder):
        return _docs(spark, folder).select("doc_id", fn(F.col("text")).alias("value"))

    return run


_cut = "text"
_steps = []
for _i, _m in enumerate(MARKERS):
    _steps.append(f"s{_i} AS (SELECT doc_id, {duck.cut_before('text', _m)} AS text FROM {'documents' if _i == 0 else f's{_i - 1}'})")


@area.query("t1_truncate_tail", duck.with_(*_steps, select=f"SELECT doc_id, text AS value FROM s{len(MARKERS) - 1}"))
def _t1(spark, folder):
    return _docs(spark, folder).select("doc_id", text.truncate_tail(F.col("text"), MARKERS).alias("value"))


_clean = (
    "regexp_replace(regexp_replace(regexp_replace({}, 'DOI:[^\n]*', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '[ \t]{{2,}}', ' ', 'g')"
)
_column("t2_clean_paragraph", text.clean_paragraph, duck.strip(_clean.format(duck.newlines("text"))))


@area.query("t3_repair_layout_spacing")
def _t3(spark, folder):
    return _docs(spark, folder).select("doc_id", text.repair_layout_spacing(F.col("text")).alias("value"))


_tags = "html"
for _p, _r in ((r"<br\s*/?>", "chr(10)"), (r"</(p|div|tr|li|h[0-9])>", "chr(10)")):
    _tags = f"regexp_replace({_tags}, '{_p}', {_r}, 'gi')"
_tags = f"regexp_replace({_tags}, '<[^>]+>', ' ', 'g')"
for _e, _r in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
    _tags = f"replace({_tags}, '{_e}', '{_r}')"


@area.query("t4_tags_to_spacing", f"SELECT page_id, {_tags} AS value FROM pages")
def _t4(spark, folder):
    return read_table(spark, folder, "pages").select("page_id", text.tags_to_spacing(F.col("html")).alias("value"))


@area.query("t4_strip_html")
def _t4_full(spark, folder):
    html = text.drop_hidden_markup(F.col("html"))
    return read_table(spark, folder, "pages").select("page_id", text.strip_html(html).alias("value"))


_column(
    "t5_drop_blank_lines",
    text.drop_blank_lines,
    f"array_to_string(list_filter(list_transform(string_split({duck.newlines('text')}, chr(10)), "
    f"lambda x: {duck.strip('x')}), lambda x: x <> ''), chr(10))",
)
_column("t6_collapse_spaces", text.collapse_spaces, duck.collapse("text"))
_column("t7_clip", lambda c: text.clip(c, 300), duck.clip("text", 300, "...(truncated)"))
_column(
    "t8_truncate_utf8",
    lambda c: text.truncate_utf8(c, 33),
    "CASE WHEN strlen(text) <= 33 THEN text ELSE "
    "left(text, list_max(list_filter(range(0, 34), lambda k: strlen(left(text, k)) <= 33))) END",
)

_PATH = "source || '/' || lang || '_' || replace(left(text, 90), '/', '-') || '.md'"


def _path():
    return F.concat(
        F.col("source"), F.lit("/"), F.col("lang"), F.lit("_"),
        F.replace(F.left("text", F.lit(90)), F.lit("/"), F.lit("-")), F.lit(".md"),
    )


_longest = "list_max(list_filter(range(0, {room} + 1), lambda k: strlen(left({x}, k)) <= {room}))"
_STEM = r"regexp_replace({}, '([^.])\.[^.]+$', '\1')"


@area.query(
    "t9_document_id",
    f"""WITH p AS (SELECT doc_id, {_PATH} AS path, source AS cat FROM documents),
    q AS (SELECT *, {_STEM.format("split_part(path, '/', 2)")} AS stem,
                 '__' || left(md5(path), 10) || '.md' AS tail,
                 left(cat, {_longest.format(room=32, x="cat")}) || '/' AS prefix FROM p),
    r AS (SELECT *, 128 - strlen(prefix) - strlen(tail) AS room FROM q)
    SELECT doc_id, CASE WHEN strlen(path) <= 128 THEN path ELSE prefix ||
      CASE WHEN strlen(stem) <= room THEN stem ELSE left(stem, {_longest.format(room="room", x="stem")}) END || tail END AS value
    FROM r""",
)
def _t9(spark, folder):
    return _docs(spark, folder).select("doc_id", keys.document_id(_path()).alias("value"))


_RAW_NAME = "lang || '/x:' || left(text, 40)"


@area.query(
    "t10_safe_names",
    f"""WITH p AS (SELECT doc_id, {_RAW_NAME} AS raw FROM documents),
    q AS (SELECT doc_id, raw, string_split(raw, '/') AS parts FROM p)
    SELECT doc_id,
      regexp_replace(coalesce(nullif({duck.strip(_STEM.format("parts[len(parts)]"))}, ''), 'result'), '[<>:"/\\\\|?*]', '_', 'g') AS name,
      array_to_string(list_transform(list_filter(string_split(replace({duck.strip('raw')}, '\\', '/'), '/'), lambda x: x NOT IN ('', '.', '..')),
        lambda x: coalesce(nullif({duck.strip("regexp_replace(x, '[<>:" + chr(34) + "/\\\\|?*]', '_', 'g')")}, ''), 'unknown')), '/') AS path
    FROM q""",
)
def _t10(spark, folder):
    raw = F.concat(F.col("lang"), F.lit("/x:"), F.left("text", F.lit(40)))
    return _docs(spark, folder).select(
        "doc_id", keys.safe_file_name(raw, F.lit("")).alias("name"), keys.safe_path(raw).alias("path")
    )


_CORPUS_PATH = (
    "CASE WHEN doc_id % 3 = 0 THEN source || '/' || lang || '-' || doc_id || '/full.md' "
    "WHEN doc_id % 3 = 1 THEN source || '/' || doc_id || '.v1.txt' ELSE doc_id || '.txt' END"
)


@area.query(
    "t11_path_fields",
    f"""WITH p AS (SELECT doc_id, {_CORPUS_PATH} AS path FROM documents),
    q AS (SELECT *, string_split(path, '/') AS parts FROM p),
    r AS (SELECT *, lower(parts[len(parts)]) = 'full.md' AND len(parts) >= 2 AS extracted FROM q)
    SELECT doc_id,
      CASE WHEN extracted THEN parts[len(parts) - 1] ELSE {_STEM.format('parts[len(parts)]')} END AS title,
      CASE WHEN extracted THEN array_to_string(parts[1:len(parts) - 1], '/') || '.pdf' ELSE path END AS source,
      CASE WHEN len(parts) >= 2 THEN parts[1] ELSE '' END AS category
    FROM r""",
)
def _t11(spark, folder):
    paths = _docs(spark, folder).select("doc_id", F.expr(_CORPUS_PATH).alias("path"))
    return paths.select("doc_id", *[c.alias(n) for n, c in keys.path_fields(F.col("path")).items()])


_PADDED = "CASE WHEN doc_id % 7 = 0 THEN ' ' WHEN doc_id % 7 = 1 THEN NULL ELSE '  ' || source || chr(10) END"
_SRC = f"coalesce(nullif({duck.strip('coalesce(raw, chr(32))')}, ''), '未知来源')"


@area.query(
    "t12_ingest_key",
    f"""WITH p AS (SELECT doc_id, {_PADDED} AS raw FROM documents)
    SELECT doc_id, {_SRC} AS source, coalesce(nullif(raw, ''), '未知') AS title, sha1({_SRC}) AS ingest_key FROM p""",
)
def _t12(spark, folder):
    rows = _docs(spark, folder).select("doc_id", F.expr(_PADDED.replace("chr(10)", "char(10)")).alias("raw"))
    return rows.select(
        "doc_id",
        keys.source_or_default(F.col("raw")).alias("source"),
        keys.title_or_default(F.col("raw")).alias("title"),
        keys.ingest_key(F.col("raw")).alias("ingest_key"),
    )


_HEAD = "CASE WHEN doc_id % 4 = 0 THEN ' ' ELSE ' ' || source || ' > ' || lang END"


@area.query(
    "t13_passage_texts",
    f"""WITH p AS (SELECT doc_id, source, {_HEAD} AS headings, text FROM documents)
    SELECT doc_id,
      CASE WHEN {duck.strip('headings')} <> '' THEN {duck.strip('headings')} || chr(10) || {duck.strip('text')} ELSE {duck.strip('text')} END AS passage,
      source || ' ' || headings || ' ' || text AS keyword_text,
      '来源: ' || source || chr(10) || '标题: ' || headings || chr(10) || '内容: ' || text AS labelled
    FROM p""",
)
def _t13(spark, folder):
    rows = _docs(spark, folder).withColumn("headings", F.expr(_HEAD))
    s, h, c = F.col("source"), F.col("headings"), F.col("text")
    return rows.select(
        "doc_id",
        text.heading_prefixed(h, c).alias("passage"),
        text.keyword_text(s, h, c).alias("keyword_text"),
        text.labelled_passage(s, h, c).alias("labelled"),
    )


@area.query(
    "t14_tokenize",
    f"""WITH p AS (SELECT doc_id, unnest({duck.tokens('text')}) AS token FROM documents)
    SELECT doc_id, token, count(*) AS n FROM p GROUP BY ALL""",
)
def _t14(spark, folder):
    words = unnest(_docs(spark, folder), ["doc_id"], tokens.tokenize(F.col("text")), "token")
    return words.groupBy("doc_id", "token").agg(F.count("*").alias("n"))


_JS = r"\t\n\x0b\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
_cjk = r"length(regexp_replace(text, '[^\x{3400}-\x{9fff}]', '', 'g'))"
_wide = r"length(regexp_replace(text, '[^\x{10000}-\x{10ffff}]', '', 'g'))"
_marks = f"length(regexp_replace(text, '[A-Za-z0-9_{_JS}]', '', 'g'))"
_column(
    "t15_estimate_tokens",
    tokens.estimate_tokens,
    f"CASE WHEN regexp_matches(text, '[^{_JS}]') THEN cast({_cjk} + ceil((length(text) + {_wide} - {_cjk}) / 4) "
    f"+ ceil(({_marks} + {_wide}) * 0.25) AS bigint) ELSE 0 END",
)


_CONTENT_SPARK = (
    "CASE turn % 4 WHEN 0 THEN to_json(named_struct('text', concat(' ', text))) WHEN 1 THEN text "
    "WHEN 2 THEN concat('{\"turn\":', turn, '}') ELSE NULL END"
)
_CONTENT_DUCK = (
    "CASE turn % 4 WHEN 0 THEN cast(to_json({'text': ' ' || text}) AS varchar) WHEN 1 THEN text "
    "WHEN 2 THEN '{\"turn\":' || turn || '}' ELSE NULL END"
)


@area.query(
    "t16_message_text",
    f"""WITH m AS (SELECT conv_id, turn, {_CONTENT_DUCK} AS content FROM conversations)
    SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN {duck.strip("json_extract_string(content, '$.text')")}
      ELSE {duck.strip("coalesce(content, '')")} END AS value FROM m""",
)
def _t16(spark, folder):
    rows = read_table(spark, folder, "conversations").withColumn("content", F.expr(_CONTENT_SPARK))
    return rows.select("conv_id", "turn", prompts.message_text(F.col("content")).alias("value"))


_WORDS = "string_split(text, ' ')"


@area.query(
    "t17_tags",
    f"""SELECT doc_id, array_to_string(list_filter(list_transform({_WORDS}, lambda x: {duck.strip('x')}),
      lambda x: x <> '')[1:20], '|') AS value FROM documents""",
)
def _t17(spark, folder):
    return _docs(spark, folder).select("doc_id", F.array_join(text.tags(F.split("text", " ", -1)), "|").alias("value"))


@area.query(
    "t18_page_range",
    """WITH p AS (SELECT conv_id, list(turn ORDER BY turn) FILTER (WHERE role = 'assistant') AS pages FROM conversations GROUP BY conv_id)
    SELECT conv_id, CASE WHEN pages IS NULL OR len(pages) = 0 THEN '' WHEN list_min(pages) = list_max(pages) THEN 'p' || list_min(pages)
      ELSE 'p' || list_min(pages) || '-p' || list_max(pages) END AS value FROM p""",
)
def _t18(spark, folder):
    rows = read_table(spark, folder, "conversations")
    # Only the ends of the range are needed, so two numbers per group are kept, not all pages.
    page = F.when(F.col("role") == "assistant", F.col("turn"))
    ends = rows.groupBy("conv_id").agg(F.array_compact(F.array(F.min(page), F.max(page))).alias("pages"))
    return ends.select("conv_id", text.page_range(F.col("pages")).alias("value"))


_PROMPT = "CASE doc_id % 3 WHEN 0 THEN '旧问题：x 问题：' || text || ' 检索资料：' || source WHEN 1 THEN '问题： ' || text ELSE text END"
_after = "list_extract(string_split(prompt, '问题：'), -1)"


@area.query(
    "t19_question_of_prompt",
    f"""WITH p AS (SELECT doc_id, {duck.strip(_PROMPT)} AS prompt FROM documents)
    SELECT doc_id, {duck.collapse(f"string_split({_after}, '检索资料：')[1]")} AS value FROM p""",
)
def _t19(spark, folder):
    return _docs(spark, folder).select("doc_id", text.question_of_prompt(F.expr(_PROMPT)).alias("value"))


_marked = rf"regexp_replace(text, '([。！？!?；;]){duck.WS}+|\n+', '\1' || chr(1), 'g')"


@area.query(
    "t20_claims",
    f"""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split({_marked}, chr(1)), lambda x: {duck.collapse('x')}),
        lambda x: length(x) >= 8)[1:24] AS parts FROM (SELECT doc_id, replace(text, '.', '!') AS text FROM documents))
    SELECT doc_id, len(parts) AS n, array_to_string(parts, '|') AS value FROM p""",
)
def _t20(spark, folder):
    # The given texts end sentences with full stops; they stand in for exclamation marks here.
    parts = text.claims(F.replace("text", F.lit("."), F.lit("!")))
    rows = _docs(spark, folder).select("doc_id", parts.alias("parts"))
    return rows.select("doc_id", F.size("parts").alias("n"), F.array_join("parts", "|").alias("value"))


_FIELDS = ("CASE WHEN doc_id % 2 = 0 THEN '  ' END", "CASE WHEN doc_id % 3 = 0 THEN lang END", "CASE WHEN doc_id % 5 > 0 THEN text END")


@area.query(
    "t21_first_filled",
    "SELECT doc_id, coalesce(" + ", ".join(f"nullif({duck.collapse(f)}, '')" for f in _FIELDS) + ", '') AS value FROM documents",
)
def _t21(spark, folder):
    return _docs(spark, folder).select("doc_id", text.first_filled(*[F.expr(f) for f in _FIELDS]).alias("value"))


@area.query(
    "t23_usage",
    """WITH e AS (SELECT event_id, CASE WHEN event_id % 3 > 0 THEN cast(json_extract_string(props, '$.k') AS bigint) END AS p,
        CASE WHEN event_id % 4 > 0 THEN user_id END AS c FROM events)
    SELECT event_id, coalesce(p, 0) AS prompt_tokens, coalesce(c, 0) AS completion_tokens, coalesce(p, 0) + coalesce(c, 0) AS total_tokens FROM e""",
)
def _t23(spark, folder):
    asked = F.when(F.col("event_id") % 3 > 0, F.get_json_object("props", "$.k").cast("bigint"))
    written = F.when(F.col("event_id") % 4 > 0, F.col("user_id"))
    fields = prompts.usage_fields(asked, written)
    return read_table(spark, folder, "events").select("event_id", *[c.alias(n) for n, c in fields.items()])


_PROFILE_SPARK = "to_json(named_struct('age', cast(user_id as string), 'weight', ' ', 'hba1c', if(event_id % 3 = 0, null, cast(event_id % 90 as string)), 'ldl', concat(event_type, ' ')))"
_HB = "CASE WHEN event_id % 3 = 0 THEN NULL ELSE '- 糖化血红蛋白(%): ' || (event_id % 90) END"


@area.query(
    "t24_profile_text",
    f"""SELECT event_id, concat_ws(chr(10) || chr(10), '问题：' || event_type, CASE WHEN event_id % 2 = 0 THEN '检索资料：' || chr(10) || props END,
      '身体指标：' || chr(10) || concat_ws(chr(10), '- 年龄: ' || user_id, {_HB}, '- LDL-C(mmol/L): ' || event_type)) AS value FROM events""",
)
def _t24(spark, folder):
    rows = read_table(spark, folder, "events").withColumn("profile", F.expr(_PROFILE_SPARK))
    context = F.when(F.col("event_id") % 2 == 0, F.col("props"))
    return rows.select("event_id", prompts.user_text(F.concat(F.lit(" "), F.col("event_type")), context, F.col("profile")).alias("value"))


_DOCS_SPARK = (
    "transform(split(text, ' '), w -> named_struct('title', if(length(w) > 5, null, w), "
    "'source', if(length(w) > 7, null, concat('s-', w)), 'headings', cast(null as string), 'content', if(w = '', null, if(length(w) > 9, null, w))))"
)
_DOCS_DUCK = """unnested AS (SELECT conv_id, turn, unnest(range(1, len(string_split(text, ' ')) + 1)) AS i, unnest(string_split(text, ' ')) AS w FROM conversations),
  fields AS (SELECT conv_id, turn, i, CASE WHEN length(w) > 5 THEN '' ELSE w END AS title, CASE WHEN length(w) > 7 THEN '' ELSE 's-' || w END AS source,
    CASE WHEN w = '' OR length(w) > 9 THEN '' ELSE w END AS content FROM unnested WHERE w IS NOT NULL),
  kept AS (SELECT * FROM fields WHERE title || source || content <> '')"""


@area.query(
    "t25_retrieved_docs",
    duck.with_(_DOCS_DUCK, select="SELECT conv_id, turn, title, source, '' AS headings, content, count(*) AS n FROM kept GROUP BY ALL"),
)
def _t25(spark, folder):
    rows = read_table(spark, folder, "conversations").select("conv_id", "turn", F.explode(prompts.retrieved_docs(F.expr(_DOCS_SPARK))).alias("d"))
    return rows.select("conv_id", "turn", "d.*").groupBy("conv_id", "turn", "title", "source", "headings", "content").agg(F.count("*").alias("n"))


@area.query(
    "t26_citations",
    duck.with_(
        _DOCS_DUCK,
        "keyed AS (SELECT *, lower(trim(coalesce(nullif(title, ''), nullif(source, ''), '未知来源'))) AS k FROM kept)",
        "firsts AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, k ORDER BY i) AS rn FROM keyed)",
        select="SELECT conv_id, turn, string_agg(title || '/' || source, ';' ORDER BY i) AS cited, count(*) AS n FROM firsts WHERE rn = 1 GROUP BY ALL",
    ),
)
def _t26(spark, folder):
    docs = prompts.first_nonempty_docs(F.lit(None).cast(prompts.RETRIEVED_DOCS), F.expr(_DOCS_SPARK))
    rows = read_table(spark, folder, "conversations").select("conv_id", "turn", prompts.citations(docs).alias("d"))
    cited = F.array_join(F.transform("d", lambda x: F.concat(x["title"], F.lit("/"), x["source"])), ";")
    return rows.where(F.size("d") > 0).select("conv_id", "turn", cited.alias("cited"), F.size("d").alias("n"))


_ANSWER = "CASE turn % 3 WHEN 0 THEN replace(text, chr(10), '\\n') WHEN 1 THEN '##' || text || chr(13) || chr(10) || '#' || role ELSE text END"
_md = duck.newlines("answer")
_md2 = f"CASE WHEN contains({_md}, '\\n') AND NOT contains({_md}, chr(10)) THEN replace({_md}, '\\n', chr(10)) ELSE {_md} END"


@area.query(
    "t27_answer_markdown",
    f"""WITH a AS (SELECT conv_id, turn, {_ANSWER} AS answer FROM conversations)
    SELECT conv_id, turn, regexp_replace({_md2}, '(^|\\n)(\\s{{0,3}}#{{1,6}})([^\\s#])', '\\1\\2 \\3', 'g') AS value FROM a""",
)
def _t27(spark, folder):
    spark_answer = _ANSWER.replace("chr(", "char(").replace("'\\n'", "'\\\\n'")
    rows = read_table(spark, folder, "conversations").withColumn("answer", F.expr(spark_answer))
    return rows.select("conv_id", "turn", text.answer_markdown(F.col("answer")).alias("value"))


# ---- predicates ------------------------------------------------------------------------------


@area.query(
    "f1_topic_filter",
    "SELECT doc_id, source FROM documents WHERE " + " OR ".join(f"contains(lower(text), '{k.lower()}')" for k in DOC_KEYWORDS),
)
def _f1(spark, folder):
    return _docs(spark, folder).where(predicates.mentions_any(F.col("text"), DOC_KEYWORDS)).select("doc_id", "source")


@area.query(
    "f2_catalogue_search",
    "SELECT doc_id, source FROM documents WHERE doc_id % 6 <> 0 AND (lang ILIKE '%C1%' OR source ILIKE '%C1%' OR text ILIKE '%C1%')",
)
def _f2(spark, folder):
    rows = _docs(spark, folder).select(
        "doc_id", "source", F.col("lang").alias("category"), F.col("text").alias("title"), (F.col("doc_id") % 6 == 0).alias("is_deleted")
    )
    return rows.where(predicates.catalogue_match(" C1 ")).select("doc_id", "source")


@area.query(
    "f3_schema_report",
    """WITH c AS (SELECT doc_id, CASE WHEN doc_id % 97 = 5 THEN NULL ELSE source END AS source, CASE WHEN doc_id % 89 = 7 THEN NULL ELSE text END AS content FROM documents),
    m AS (SELECT doc_id, concat_ws(',', CASE WHEN content IS NULL THEN 'content' END, CASE WHEN source IS NULL THEN 'source' END) AS missing FROM c),
    w AS (SELECT string_agg(doc_id || ': missing ' || missing, ' | ' ORDER BY doc_id) AS examples FROM (SELECT * FROM m WHERE missing <> '' ORDER BY doc_id LIMIT 3))
    SELECT count(*) FILTER (WHERE missing <> '') AS bad_items, count(*) AS total_items, any_value(examples) AS examples FROM m, w""",
)
def _f3(spark, folder):
    rows = _docs(spark, folder).select(
        "doc_id",
        F.col("doc_id").alias("chunk_id"),
        F.when(F.col("doc_id") % 97 != 5, F.col("source")).alias("source"),
        F.col("lang").alias("category"),
        F.lit("").alias("headings"),
        F.when(F.col("doc_id") % 89 != 7, F.col("text")).alias("content"),
    )
    return predicates.schema_report(rows, "doc_id")


_BLANKED = "CASE WHEN length(text) % 5 = 0 THEN '  ' ELSE text END"


@area.query("f4_usable_rows", f"SELECT conv_id, turn FROM (SELECT conv_id, turn, {_BLANKED} AS text, role FROM conversations) WHERE {duck.strip('text')} <> '' AND {duck.strip('role')} <> ''")
def _f4(spark, folder):
    rows = read_table(spark, folder, "conversations").withColumn("text", F.expr(_BLANKED))
    return rows.where(predicates.filled("text", "role")).select("conv_id", "turn")
