"""Question/answer curation, preference gates, and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from passagemill.functions import prompts
from passagemill.functions.keys import hash_mod
from passagemill.functions.text import CONTEXT_MARK, QUESTION_MARK
from passagemill.operators import chat, curate
from passagemill.operators.spread import block_of
from passagemill.plans import inputs
from passagemill.registry import Registry, duck
from passagemill.registry.judging import MESSAGES, _q
from passagemill.session import read_table
from passagemill.streaming import answers

area = Registry()

KEYWORDS = ("ention", "über", "sh the")


def _topic(x: str) -> str:
    return "(" + " OR ".join(f"contains(lower({x}), '{k}')" for k in KEYWORDS) + ")"


def _pairs(gap: int, name: str) -> str:
    return f"""{name} AS (SELECT u.conv_id * 1000000 + u.turn AS id, u.conv_id, u.turn, u.text AS question, a.text AS reply FROM conversations u
      JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + {gap} WHERE u.role = 'user' AND a.role = 'assistant')"""


RECORDS = (
    _pairs(1, "turns"),
    f"""records AS (SELECT id, list_extract(['train', 'validation', 'test'], cast(id % 3 + 1 AS bigint)) AS split, {duck.strip('question')} AS question, {duck.strip('reply')} AS answer,
      CASE WHEN {duck.hash_mod(5, _q('nest'), 'id')} = 0 THEN {duck.strip('left(question, 50)')} END AS extra FROM turns)""",
    "asked AS (SELECT id, split, answer, question AS q FROM records UNION ALL SELECT id, split, answer, extra FROM records WHERE extra IS NOT NULL)",
)


@area.query(
    "t22_flat_questions",
    duck.with_(*RECORDS, select="SELECT id, CASE WHEN extra IS NULL THEN question ELSE extra || '|' || question END AS questions FROM records"),
)
def _t22(spark, folder):
    return inputs.qa_records(spark, folder).select("id", F.array_join(curate.flat_strings(F.col("questions")), "|").alias("questions"))


@area.query(
    "p1_topic_records",
    duck.with_(*RECORDS, select=f"SELECT split, count(*) AS kept FROM records WHERE {_topic('question')} GROUP BY split"),
)
def _p1(spark, folder):
    return curate.topic_records(inputs.qa_records(spark, folder), "questions", KEYWORDS).groupBy("split").agg(F.count("*").alias("kept"))


def _qa_tables(spark, folder):
    pairs = inputs.turn_pairs(spark, folder)
    questions = pairs.select(F.col("id").alias("question_id"), F.col("question").alias("content"))
    answers_ = pairs.select((F.col("id") + 1).alias("ans_id"), F.col("id").alias("question_id"), F.col("reply").alias("content"))
    candidates = pairs.select(
        F.col("id").alias("question_id"), (F.col("id") + 1).alias("pos_ans_id"), (F.col("id") + 3 - 2 * inputs.TURNS * (F.col("id") % 2)).alias("neg_ans_id")
    )
    return questions, answers_, candidates


_SUBSET = (
    _pairs(1, "turns"),
    f"kept_q AS (SELECT id AS question_id, question AS content FROM turns WHERE {_topic('question')})",
    "kept_a AS (SELECT id + 1 AS ans_id, id AS question_id, reply AS content FROM turns WHERE id IN (SELECT question_id FROM kept_q))",
    """kept_c AS (SELECT id AS question_id, id + 1 AS pos_ans_id, id + 3 - 2 * 1000000 * (id % 2) AS neg_ans_id FROM turns WHERE id IN (SELECT question_id FROM kept_q)
      AND id + 1 IN (SELECT ans_id FROM kept_a) AND id + 3 - 2 * 1000000 * (id % 2) IN (SELECT ans_id FROM kept_a))""",
)


@area.query("p2_subset_answers", duck.with_(*_SUBSET, select="SELECT ans_id, question_id, content FROM kept_a"))
def _p2(spark, folder):
    return curate.topic_subset(*_qa_tables(spark, folder), KEYWORDS)[1].select("ans_id", "question_id", "content")


@area.query("p2_subset_candidates", duck.with_(*_SUBSET, select="SELECT question_id, pos_ans_id, neg_ans_id FROM kept_c"))
def _p2_candidates(spark, folder):
    return curate.topic_subset(*_qa_tables(spark, folder), KEYWORDS)[2].select("question_id", "pos_ans_id", "neg_ans_id")


@area.query("p3_record_pairs", duck.with_(*RECORDS, select="SELECT 'records' AS source, q AS question, answer FROM asked WHERE q <> '' AND answer <> ''"))
def _p3(spark, folder):
    return curate.record_pairs(inputs.qa_records(spark, folder), "questions", "answers", "records")


_MERGED = "merged AS (SELECT 'records' AS source, q AS question, answer FROM asked UNION ALL SELECT 'tables', question, answer FROM records)"


def _merged(spark, folder):
    questions, answers_, _ = _qa_tables(spark, folder)
    return curate.record_pairs(inputs.qa_records(spark, folder), "questions", "answers", "records").unionByName(
        curate.joined_pairs(questions, answers_, "tables")
    )


@area.query("p4_merged_pairs", duck.with_(*RECORDS, _MERGED, select="SELECT source, question, answer FROM merged"))
def _p4(spark, folder):
    return _merged(spark, folder)


@area.query(
    "p5_dedup_pairs",
    duck.with_(
        *RECORDS, _MERGED, f"k AS (SELECT *, row_number() OVER (PARTITION BY {duck.collapse('question')}, {duck.collapse('answer')} ORDER BY source) AS rn FROM merged)",
        select="SELECT source, question, answer FROM k WHERE rn = 1",
    ),
)
def _p5(spark, folder):
    return curate.dedup_by(_merged(spark, folder), {"q": F.col("question"), "a": F.col("answer")}, ["source"])


@area.query(
    "p5_distinct_questions",
    f"SELECT {duck.collapse('text')} AS question, min(doc_id) AS doc_id FROM documents WHERE {duck.collapse('text')} <> '' GROUP BY 1",
)
def _p5_questions(spark, folder):
    rows = read_table(spark, folder, "documents").select(F.col("text").alias("question"), "doc_id")
    return curate.distinct_questions(rows, "question", ["doc_id"])


@area.query("p6_slice", "SELECT event_id FROM events ORDER BY event_id OFFSET 100 LIMIT 250")
def _p6(spark, folder):
    return curate.sliced(read_table(spark, folder, "events").select("event_id"), ["event_id"], 100, 250)


def _long_clip(x: str, n: int) -> str:
    return f"CASE WHEN length({duck.strip(x)}) > {n} THEN left({duck.strip(x)}, {n}) || chr(10) || '...[truncated]' ELSE {duck.strip(x)} END"


_PROMPT = f"'{QUESTION_MARK}' || {_long_clip('question', 60)} || CASE WHEN {duck.strip('context')} <> '' THEN chr(10) || chr(10) || '{CONTEXT_MARK}' || chr(10) || {_long_clip('context', 400)} ELSE '' END"


@area.query(
    "p7_prompts",
    duck.with_(
        _pairs(1, "turns"),
        "src AS (SELECT id, question, CASE WHEN id % 3 = 0 THEN ' ' ELSE reply END AS context, CASE WHEN id % 4 = 0 THEN '' ELSE reply END AS ref FROM turns)",
        select=f"""SELECT id, {_PROMPT} AS prompt, {_PROMPT} || CASE WHEN {duck.strip('ref')} <> '' THEN chr(10) || chr(10) || '参考答案（可参考但不要照抄）：' || chr(10) || {_long_clip('ref', 100)} ELSE '' END AS block FROM src""",
    ),
)
def _p7(spark, folder):
    rows = inputs.turn_pairs(spark, folder)
    context, ref = F.when(F.col("id") % 3 == 0, " ").otherwise(F.col("reply")), F.when(F.col("id") % 4 == 0, "").otherwise(F.col("reply"))
    q = F.col("question")
    return rows.select("id", prompts.training_prompt(q, context, 60, 400).alias("prompt"), prompts.input_block(q, context, ref, 60, 400, 100).alias("block"))


# ---- gates -------------------------------------------------------------------------------------


def _samples(spark, folder):
    """Three samples per user turn, some with equal prompts, with judge replies and similarities from md5."""
    rows = inputs.turn_pairs(spark, folder).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    rows = rows.withColumn("position", F.col("id") * 3 + F.col("copy"))
    n = F.col("position")
    reply = F.to_json(
        F.struct(
            F.when(hash_mod(6, "win", n) == 0, "b").otherwise(" a").alias("winner"),
            (hash_mod(5, "sa", n) + 6).alias("score_a"),
            (hash_mod(4, "sb", n) + 5).alias("score_b"),
            F.lit("better").alias("reason"),
        )
    )
    question = F.when(hash_mod(30, "blank", n) == 0, " ").otherwise(F.col("question"))
    return rows.select(
        "position",
        F.concat(F.lit(QUESTION_MARK), F.col("question")).alias("prompt"),
        question.alias("question"),
        F.lit("").alias("context"),
        F.col("reply").alias("chosen"),
        F.when(hash_mod(25, "none", n) == 0, "").otherwise(F.col("reply")).alias("rejected"),
        F.lit("ref").alias("source_answer"),
        (hash_mod(1000, "sim", n) / 1000.0).alias("similarity"),
        F.when(hash_mod(20, "bad", n) == 0, F.lit("oops")).otherwise(F.concat(F.lit("> "), reply)).alias("judge_raw"),
    )


def _done(spark, folder):
    asked = inputs.turn_pairs(spark, folder).where(hash_mod(10, "done", F.col("id")) == 0)
    return asked.select(F.concat(F.lit(f" {QUESTION_MARK}"), F.col("question")).alias("prompt"))


GATED = (
    _pairs(1, "turns"),
    "copies AS (SELECT *, unnest([0, 1, 2]) AS copy FROM turns)",
    "placed AS (SELECT *, id * 3 + copy AS position FROM copies)",
    f"""samples AS (SELECT position, '{QUESTION_MARK}' || question AS prompt, {duck.hash_mod(30, _q('blank'), 'position')} = 0 AS blank, reply, question AS question,
      {duck.hash_mod(25, _q('none'), 'position')} = 0 AS none, {duck.hash_mod(1000, _q('sim'), 'position')} / 1000.0::double AS sim, {duck.hash_mod(20, _q('bad'), 'position')} = 0 AS bad,
      {duck.hash_mod(6, _q('win'), 'position')} = 0 AS b_wins, {duck.hash_mod(5, _q('sa'), 'position')} + 6 AS sa, {duck.hash_mod(4, _q('sb'), 'position')} + 5 AS sb FROM placed)""",
    """own AS (SELECT *, CASE WHEN none THEN 'empty_chosen_or_rejected' WHEN sim >= 0.92 THEN 'similarity_too_high' WHEN bad THEN 'judge_json_parse_failed'
      WHEN b_wins THEN 'judge_winner_not_A' WHEN sa < 7 THEN 'chosen_score_too_low' WHEN sa - sb < 2 THEN 'score_gap_too_small' ELSE 'kept' END AS own FROM samples)""",
    f"done AS (SELECT DISTINCT {duck.strip(f'{_q(QUESTION_MARK)} || question')} AS prompt FROM turns WHERE {duck.hash_mod(10, _q('done'), 'id')} = 0)",
    """gated AS (SELECT *, CASE WHEN blank THEN 'empty_question' WHEN prompt IN (SELECT prompt FROM done)
      OR EXISTS (SELECT 1 FROM own e WHERE e.prompt = o.prompt AND e.position < o.position AND e.own = 'kept' AND NOT e.blank) THEN 'resume_duplicate_prompt' ELSE own END AS reason FROM own o)""",
)


@area.query("p10_gates", duck.with_(*GATED, select="SELECT position, reason FROM gated"))
def _p10(spark, folder):
    return curate.gated(_samples(spark, folder), _done(spark, folder)).select("position", "reason")


@area.query("p10_skip_reasons", duck.with_(*GATED, select="SELECT reason, count(*) AS rows FROM gated WHERE reason <> 'kept' GROUP BY reason"))
def _p10_reasons(spark, folder):
    return curate.skip_reasons(curate.gated(_samples(spark, folder), _done(spark, folder)))


@area.query(
    "p11_accepted",
    duck.with_(*GATED, select="SELECT prompt, question, reply AS chosen, sa AS score_a, sb AS score_b, 'A' AS winner, round(sim, 4) AS similarity FROM gated WHERE reason = 'kept'"),
)
def _p11(spark, folder):
    rows = curate.accepted(curate.gated(_samples(spark, folder), _done(spark, folder)))
    return rows.select("prompt", "meta.question", "chosen", "meta.judge.score_a", "meta.judge.score_b", "meta.judge.winner", "meta.similarity")


@area.query(
    "p8_pending_prompts",
    duck.with_(*GATED, select="SELECT prompt, min(position) AS position FROM samples WHERE prompt NOT IN (SELECT prompt FROM done) GROUP BY prompt"),
)
def _p8(spark, folder):
    rows = _samples(spark, folder).select("prompt", "position")
    return curate.pending_prompts(rows, _done(spark, folder), ["position"])


@area.query("p9_near_identical")
def _p9(spark, folder):
    rows = inputs.turn_pairs(spark, folder)
    near = F.when(F.col("id") % 3 == 0, F.concat(F.col("reply"), F.lit(" x"))).otherwise(F.reverse("reply"))
    return curate.near_identical(rows.select("id", F.col("reply").alias("a"), near.alias("b")), "a", "b").select("id", F.round("similarity", 6).alias("similarity"))


_fill = "template"
for _name, _options in curate.PLACEHOLDERS.items():
    _list = "[" + ", ".join(f"'{o}'" for o in _options) + "]"
    _fill = f"replace({_fill}, '{{{_name}}}', list_extract({_list}, {duck.hash_mod(len(_options), _q('42'), _q(_name), 'template')} + 1))"
_levels = "[" + ", ".join(f"'{d}'" for d in curate.DIFFICULTIES) + "]"


@area.query(
    "p12_template_questions",
    duck.with_(
        MESSAGES,
        "templates AS (SELECT role AS topic, text || ' {age} {bp} {drug} {fbg} {hba1c} {ldl}?' AS template, id AS position FROM msgs)",
        f"made AS (SELECT topic, {duck.strip(_fill)} AS question, position FROM templates)",
        "firsts AS (SELECT question, arg_min(topic, position) AS topic FROM made GROUP BY question)",
        "rounds AS (SELECT topic, question, unnest(range(cast(ceil(120 / (SELECT count(*) FROM firsts)) AS bigint))) AS round FROM firsts)",
        "kept AS (SELECT * FROM rounds ORDER BY round, md5('42:' || question), question LIMIT 120)",
        select=f"""SELECT 'synthetic_hq_question_v2' AS source, topic, list_extract({_levels}, {duck.hash_mod(3, _q('42'), _q('difficulty'), 'question')} + 1) AS difficulty,
          question || repeat('{curate.VARIANT_SUFFIX}', round) AS question FROM kept""",
    ),
)
def _p12(spark, folder):
    rows = read_table(spark, folder, "conversations")
    templates = rows.select(
        F.col("role").alias("topic"),
        F.concat(F.col("text"), F.lit(" {age} {bp} {drug} {fbg} {hba1c} {ldl}?")).alias("template"),
        (F.col("conv_id") * inputs.TURNS + F.col("turn")).alias("position"),
    )
    return curate.questions_from_templates(templates, 120, 42)


@area.query(
    "p13_unseen_sample",
    duck.with_(
        _pairs(1, "turns"),
        f"pool AS (SELECT {duck.collapse('question')} AS question FROM turns)",
        f"used AS (SELECT {duck.collapse('question')} AS question FROM turns WHERE id % 2 = 0)",
        select="SELECT question FROM pool WHERE question NOT IN (SELECT question FROM used) ORDER BY md5('7:' || question), question LIMIT 50",
    ),
)
def _p13(spark, folder):
    rows = inputs.turn_pairs(spark, folder)
    used = rows.where(F.col("id") % 2 == 0)
    in_prompt = F.col("id") % 4 == 0
    training = used.select(
        F.when(in_prompt, " ").otherwise(F.col("question")).alias("question"),
        F.when(in_prompt, F.concat(F.lit(QUESTION_MARK), F.col("question"), F.lit(CONTEXT_MARK), F.col("reply"))).alias("prompt"),
    )
    return curate.unseen_sample(rows.select("question"), training, 50, 7)


@area.query(
    "p14_training_view",
    duck.with_(
        _pairs(1, "turns"),
        f"""v AS (SELECT CASE WHEN id % 3 = 0 THEN '{QUESTION_MARK}' || {duck.strip('question')} || chr(10) || chr(10) || '{CONTEXT_MARK}' || chr(10) || {duck.strip('reply')} ELSE {duck.strip('question')} END AS prompt,
          {duck.strip('reply')} AS chosen, CASE WHEN id % 5 = 0 THEN '' ELSE {duck.strip('right(reply, length(reply) // 2)')} END AS rejected FROM turns)""",
        select="SELECT prompt, chosen, rejected FROM v WHERE prompt <> '' AND chosen <> '' AND rejected <> ''",
    ),
)
def _p14(spark, folder):
    rows = inputs.turn_pairs(spark, folder)
    return curate.training_view(
        rows.select(
            F.when(F.col("id") % 3 != 0, F.col("question")).alias("prompt"), "question", F.col("reply").alias("context"),
            F.col("reply").alias("chosen"), F.when(F.col("id") % 5 != 0, F.right("reply", F.floor(F.length("reply") / 2).cast("int"))).alias("rejected"),
        )
    )


# ---- conversations -----------------------------------------------------------------------------

CONVERSATIONS = (
    MESSAGES,
    "ids AS (SELECT DISTINCT conv_id AS id FROM msgs)",
    "all_ids AS (SELECT id FROM ids UNION ALL SELECT id + 1000000 FROM ids WHERE id % 2 = 0)",
    """convs AS (SELECT id, id % 50 AS user_id, CASE WHEN id % 4 = 0 THEN ' ' WHEN id % 4 = 1 THEN 'chat ' || id END AS title, CASE WHEN id % 3 = 0 THEN 'stored' END AS last_message,
      CASE WHEN id % 5 <> 0 THEN id % 2 END AS message_count, CASE WHEN id % 6 <> 0 THEN id END AS created, CASE WHEN id % 8 > 1 THEN id * 2 END AS updated, id % 7 = 0 AS is_deleted FROM all_ids)""",
)


@area.query(
    "h1_conversation_summaries",
    duck.with_(
        *CONVERSATIONS, "latest AS (SELECT conv_id, arg_max(text, turn) AS t, count(*) AS n FROM msgs GROUP BY conv_id)",
        select="SELECT id, user_id, title, coalesce(t, last_message) AS last_text, coalesce(n, 0) AS message_count FROM convs LEFT JOIN latest ON conv_id = id WHERE NOT is_deleted",
    ),
)
def _h1(spark, folder):
    rows = chat.summaries(inputs.conversations(spark, folder), inputs.messages(spark, folder))
    return rows.select("id", "user_id", "title", F.get_json_object("last_message", "$.text").alias("last_text"), "message_count")


@area.query(
    "h2_accessible_messages",
    duck.with_(
        *CONVERSATIONS,
        select="SELECT m.id, m.conv_id AS conversation_id, m.role FROM msgs m JOIN convs c ON c.id = m.conv_id WHERE NOT is_deleted AND (c.id % 3 <> 0)",
    ),
)
def _h2(spark, folder):
    convs = inputs.conversations(spark, folder)
    requests = convs.select(F.col("id").alias("conversation_id"), F.when(F.col("id") % 3 == 0, F.col("user_id") + 1).otherwise(F.col("user_id")).alias("user_id"))
    return chat.accessible_messages(inputs.messages(spark, folder), convs, requests).select("id", "conversation_id", "role")


_JS = r"\t\n\x0b\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"


def _tokens(x: str) -> str:
    cjk = rf"length(regexp_replace({x}, '[^\x{{3400}}-\x{{9fff}}]', '', 'g'))"
    marks = f"length(regexp_replace({x}, '[A-Za-z0-9_{_JS}]', '', 'g'))"
    return f"(CASE WHEN regexp_matches({x}, '[^{_JS}]') THEN cast({cjk} + ceil((length({x}) - {cjk}) / 4) + ceil({marks} * 0.25) AS bigint) ELSE 0 END)"


BUDGETS = (
    MESSAGES,
    """requests AS (SELECT conv_id, arg_max(text, turn) AS question, 'You are careful. ' || any_value(role) FILTER (WHERE turn = 0) AS system,
      coalesce(max(text) FILTER (WHERE turn = 1), '') AS context, conv_id % 4 * 900 AS reply FROM msgs GROUP BY conv_id)""",
    f"""budgets AS (SELECT conv_id, least(2048, greatest(0, 4096 - CASE WHEN reply > 0 THEN reply ELSE 1024 END - {_tokens('question')} - {_tokens('system')}
      - {_tokens(duck.strip('context'))} - 128)) AS budget FROM requests)""",
    "small AS (SELECT conv_id, cast(CASE WHEN conv_id % 3 = 0 THEN budget // 8 ELSE budget END AS bigint) AS budget FROM budgets)",
    f"spoken AS (SELECT id, conv_id, turn, role, {duck.strip('text')} AS content FROM msgs WHERE {duck.strip('text')} <> '')",
    f"costed AS (SELECT *, {_tokens('content')} + 4 AS cost FROM spoken)",
    "running AS (SELECT *, sum(cost) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS used FROM costed)",
    """history AS (SELECT id, r.conv_id, turn, CASE WHEN role = 'assistant' THEN 'assistant' ELSE 'user' END AS role, content, cost, cast(used AS bigint) AS used
      FROM running r JOIN small USING (conv_id) WHERE used <= budget)""",
)


def _requests(spark, folder):
    rows = read_table(spark, folder, "conversations")
    return rows.groupBy(F.col("conv_id").alias("conversation_id")).agg(
        F.max_by("text", "turn").alias("question"),
        F.concat(F.lit("You are careful. "), F.max(F.when(F.col("turn") == 0, F.col("role")))).alias("system_prompt"),
        F.max(F.when(F.col("turn") == 1, F.col("text"))).alias("context"),
    )


def _budgets(spark, folder):
    reply = F.col("conversation_id") % 4 * 900
    budget = chat.history_budget(F.col("question"), F.col("system_prompt"), F.col("context"), reply)
    return _requests(spark, folder).select("conversation_id", budget.alias("budget"))


@area.query("h3_history_budgets", duck.with_(*BUDGETS, select="SELECT conv_id AS conversation_id, cast(budget AS bigint) AS budget FROM budgets"))
def _h3(spark, folder):
    return _budgets(spark, folder)


def _history(spark, folder):
    third = F.when(F.col("conversation_id") % 3 == 0, F.floor(F.col("budget") / 8)).otherwise(F.col("budget"))
    return chat.history_within(inputs.messages(spark, folder), _budgets(spark, folder).withColumn("budget", third))


@area.query("h4_history_within_budget", duck.with_(*BUDGETS, select="SELECT id, conv_id AS conversation_id, role, content, cost, used FROM history"))
def _h4(spark, folder):
    return _history(spark, folder).select("id", "conversation_id", "role", "content", "cost", "used")


_FOLDED = """roles AS (SELECT *, CASE WHEN turn % 3 = 2 THEN 'USER' ELSE role END AS r FROM msgs),
    cleaned AS (SELECT id, conv_id, turn, lower(r) AS role, {text} AS content FROM roles WHERE lower(r) IN ('user', 'assistant') AND {text} <> ''),
    ahead AS (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM cleaned)""".format(text=duck.strip("text"))


@area.query("h5_folded_roles", duck.with_(MESSAGES, _FOLDED, select="SELECT id, role, content FROM ahead WHERE nxt IS DISTINCT FROM role"))
def _h5(spark, folder):
    rows = read_table(spark, folder, "conversations").select(
        (F.col("conv_id") * inputs.TURNS + F.col("turn")).alias("id"), "conv_id", "turn",
        F.when(F.col("turn") % 3 == 2, "USER").otherwise(F.col("role")).alias("role"), F.col("text").alias("content"),
    )
    # Blocks of three turns here, so that the carry between blocks is exercised.
    return chat.folded(rows, ["conv_id"], ["turn"], block_of(F.col("turn"), 3)).select("id", "role", "content")


@area.query(
    "h6_chat_messages",
    duck.with_(
        *BUDGETS,
        "ahead AS (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM history)",
        "folded AS (SELECT * FROM ahead WHERE nxt IS DISTINCT FROM role)",
        "past AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos, role, content FROM folded)",
        "n AS (SELECT conv_id, count(p.pos) AS n FROM requests LEFT JOIN past p USING (conv_id) GROUP BY conv_id)",
        select=f"""SELECT conv_id AS conversation_id, 0 AS pos, 'system' AS role, CASE WHEN conv_id % 5 = 0 THEN 'default' ELSE {duck.strip('system')} END AS content FROM requests
          UNION ALL SELECT conv_id, pos, role, content FROM past
          UNION ALL SELECT conv_id, n + 1, 'user', '{QUESTION_MARK}' || {duck.strip('question')} FROM requests JOIN n USING (conv_id)""",
    ),
)
def _h6(spark, folder):
    history = chat.folded(_history(spark, folder), ["conversation_id"], ["created_at", "id"], F.lit(0))
    requests = _requests(spark, folder).select(
        "conversation_id",
        F.when(F.col("conversation_id") % 5 == 0, " ").otherwise(F.col("system_prompt")).alias("system_prompt"),
        prompts.user_text(F.col("question"), F.lit(None)).alias("user_text"),
    )
    turns = chat.chat_messages(requests, history, "default").select("conversation_id", F.posexplode("messages").alias("pos", "m"))
    return turns.select("conversation_id", "pos", "m.role", "m.content")


@area.query(
    "h7_token_totals",
    duck.with_(
        MESSAGES,
        "used AS (SELECT id, conv_id, role, CASE WHEN turn % 3 > 0 THEN coalesce(CASE WHEN role = 'user' THEN turn * 10 WHEN role = 'assistant' THEN CASE WHEN turn % 4 > 0 THEN length(text) END END, CASE WHEN role <> 'system' THEN 0 END) END AS tokens FROM msgs)",
        select="""SELECT conv_id AS conversation_id, cast(coalesce(sum(tokens) FILTER (WHERE role = 'user'), 0) AS bigint) AS prompt_tokens,
          cast(coalesce(sum(tokens) FILTER (WHERE role = 'assistant'), 0) AS bigint) AS completion_tokens, count(tokens) AS counted_messages FROM used GROUP BY conv_id""",
    ),
)
def _h7(spark, folder):
    turn = F.col("turn")
    usage = read_table(spark, folder, "conversations").where(turn % 3 > 0).select(
        (F.col("conv_id") * inputs.TURNS + turn).alias("id"), (turn * 10).alias("prompt_tokens"), F.when(turn % 4 > 0, F.length("text").cast("bigint")).alias("completion_tokens")
    )
    return chat.token_totals(chat.token_accounting(inputs.messages(spark, folder), usage))


_NORMAL = "normal AS (SELECT id, user_id, CASE WHEN trim(coalesce(title, '')) <> '' THEN title ELSE '新对话' END AS title, coalesce(updated, created, 777) AS updated, coalesce(message_count, 0) AS message_count FROM convs)"


def _normal(spark, folder):
    return chat.normalised(inputs.conversations(spark, folder), inputs._seconds(F.lit(777)))


@area.query("h9_normalised_conversations", duck.with_(*CONVERSATIONS, _NORMAL, select="SELECT id, title, cast(updated AS bigint) AS updated, message_count FROM normal"))
def _h9(spark, folder):
    base = F.unix_timestamp(F.expr(inputs.FIRST_DAY))
    return _normal(spark, folder).select("id", "title", (F.unix_timestamp("updated_at") - base).alias("updated"), "message_count")


@area.query(
    "h8_redundant_conversations",
    duck.with_(
        *CONVERSATIONS, _NORMAL,
        "empties AS (SELECT id, row_number() OVER (PARTITION BY user_id ORDER BY updated DESC, id DESC) AS rn FROM normal WHERE trim(title) = '新对话' AND message_count = 0)",
        select="SELECT n.id, coalesce(e.rn > 1, false) AS redundant FROM normal n LEFT JOIN empties e USING (id)",
    ),
)
def _h8(spark, folder):
    return chat.duplicate_empties(_normal(spark, folder)).select("id", "redundant")


# ---- answers from events -----------------------------------------------------------------------

_roll = duck.hash_mod(50, _q("fate"), "id")


@area.query(
    "w1_assembled_answers",
    duck.with_(
        MESSAGES, f"r AS (SELECT id AS request, text, {_roll} AS roll FROM msgs WHERE role = 'assistant')",
        select="""SELECT request, CASE WHEN roll = 0 THEN 'error' WHEN roll = 1 THEN 'open' ELSE 'done' END AS status,
          CASE WHEN roll = 0 THEN NULL WHEN roll > 9 THEN text || ' ' ELSE text END AS answer, CASE WHEN roll > 1 THEN length(text) END AS completion_tokens FROM r""",
    ),
)
def _w1(spark, folder):
    return answers.assembled(inputs.generation_events(spark, folder))
