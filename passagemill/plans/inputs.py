"""Inputs the operators need, derived from the given tables by plain expressions.

The same expressions are written as DuckDB SQL next to the checks that use them.
All pseudo-random choices come from md5, so both engines agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill.functions.keys import hash_mod
from passagemill.functions.text import let
from passagemill.functions.tokens import tokenize
from passagemill.operators import phrases
from passagemill.operators.spread import unnest
from passagemill.session import read_table

GRAM = 4


def containment_pairs(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``item_id, doc_id`` of every document text that contains an item text.

    Items that fit one automaton are looked for in one pass over the documents. Of more items the
    long ones are found by a run of tokens, the short ones (normally few) by blocks of automata.
    """
    asked = items.select("item_id", F.col("text").alias("needle"))
    if phrases.fits_one_automaton(asked):
        return phrases.by_scan(docs, asked)
    asked = asked.withColumn("_n", F.size(tokenize(F.col("needle"))))
    long_enough = F.col("_n") >= GRAM + 2
    short = asked.where(~long_enough)
    near = phrases.by_scan if phrases.fits_one_automaton(short) else phrases.by_cells
    return pairs_by_runs(docs, asked.where(long_enough)).unionByName(near(docs, short))


def pairs_by_runs(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """The same for ``item_id, needle`` of at least ``GRAM + 2`` tokens.

    The inner tokens of a contained text appear unbroken in the document, so one run
    of tokens per item finds the candidates by equality; only those are searched.
    """

    def gram(ts: Column, i: Column) -> Column:
        return F.xxhash64(F.slice(ts, i, F.lit(GRAM)))

    def all_grams(ts: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(ts) - (GRAM - 1))
        return F.when(F.size(ts) >= GRAM, F.transform(starts, lambda i: gram(ts, i)))

    keyed = asked.select("item_id", let(tokenize(F.col("needle")), lambda ts: gram(ts, F.lit(2))).alias("_gram"))
    grams = unnest(docs, ["doc_id"], F.array_distinct(let(tokenize(F.col("text")), all_grams)), "_gram")
    # Only keys and ids are matched; the text is joined back to the few candidates.
    return (
        grams.join(keyed, "_gram")
        .join(asked.select("item_id", "needle"), "item_id")
        .join(docs.select("doc_id", "text"), "doc_id")
        .where(F.contains("text", "needle"))
        .select("item_id", "doc_id")
    )


def qrels(spark: SparkSession, folder: str) -> DataFrame:
    pairs = containment_pairs(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))
    return pairs.select(F.col("item_id").alias("query_id"), F.col("doc_id").alias("id"))


def short_queries(spark: SparkSession, folder: str, words: int = 4) -> DataFrame:
    """``query_id, query``: the first few tokens of each benchmark passage."""
    first = F.array_join(F.slice(tokenize(F.col("text")), 1, words), " ")
    return read_table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), first.alias("query"))


# Every document takes a given vector in turn, so that none is left without.
VECTOR_OF_DOCUMENT = "doc_id % (SELECT count(*) FROM embeddings)"


def document_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """``id, embedding`` of every document."""
    given = read_table(spark, folder, "embeddings")
    turn = F.pmod("doc_id", given.agg(F.count("*")).scalar())
    docs = read_table(spark, folder, "documents").select(F.col("doc_id").alias("id"), turn.alias("vec_id"))
    return docs.join(given.select("vec_id", "embedding"), "vec_id").select("id", "embedding")


def vector_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """``id, source, headings, content, embedding``: all documents, each with its vector."""
    docs = read_table(spark, folder, "documents").select(
        F.col("doc_id").alias("id"), "source", F.col("lang").alias("headings"), F.col("text").alias("content")
    )
    return docs.join(document_vectors(spark, folder), "id")


def query_vectors(spark: SparkSession, folder: str) -> DataFrame:
    items = read_table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"))
    vectors = read_table(spark, folder, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    return items.join(vectors, "query_id")


# ---- marked-up documents ---------------------------------------------------------------------





def marked_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, source, text`` with headings, underlined headings and fences before lines chosen by md5."""
    docs = read_table(spark, folder, "documents")

    def marked(line: Column, i: Column) -> Column:
        roll = hash_mod(9, "md", F.col("doc_id"), i)
        marks = F.repeat(F.lit("#"), (hash_mod(6, "level", F.col("doc_id"), i) + 1).cast("int"))
        nl = F.lit("\n")
        return (
            F.when(roll == 0, F.concat(marks, F.lit(" "), F.left(line, F.lit(30)), nl, nl, line))
            .when(roll == 1, F.concat(F.lit("```"), nl, line, nl, nl, F.lit("code"), nl, F.lit("```")))
            .when(roll == 2, F.concat(F.left(line, F.lit(20)), nl, F.lit("----"), nl, line))
            .otherwise(line)
        )

    text = F.array_join(F.transform(F.split("text", "\n", -1), marked), "\n\n")
    return docs.select("doc_id", "source", text.alias("text"))


def marked_plain(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, source, text`` with numbered headings before lines chosen by md5 and blank lines between."""
    docs = read_table(spark, folder, "documents")
    heads = F.array(*[F.lit(h) for h in ("一、", "（二）", "3. ", "（4）", "")])

    def marked(line: Column, i: Column) -> Column:
        roll = hash_mod(5, "txt", F.col("doc_id"), i)
        head = F.element_at(heads, (hash_mod(5, "head", F.col("doc_id"), i) + 1).cast("int"))
        title = F.concat(head, F.left(line, F.lit(24)))
        return (
            F.when(roll == 0, F.concat(title, F.lit("\n\n"), line))
            .when(roll == 1, F.concat(title, F.lit("\n"), line))
            .otherwise(line)
        )

    text = F.array_join(F.transform(F.split("text", "\n", -1), marked), "\n\n")
    return docs.select("doc_id", "source", text.alias("text"))


def layout_documents(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, layout``: each document as JSON pages of typed blocks, with titles, tables and skipped types."""
    docs = read_table(spark, folder, "documents")

    def block(line: Column, i: Column) -> Column:
        roll = hash_mod(12, "layout", F.col("doc_id"), i)
        level = hash_mod(4, "level", F.col("doc_id"), i) + 1
        kind = (
            F.when(roll == 0, F.lit("title")).when(roll == 1, F.lit("table")).when(roll == 2, F.lit("page_header")).otherwise(F.lit("paragraph"))
        )
        spans = F.array(F.struct(F.lit("text").alias("type"), line.alias("content")))
        return F.struct(
            kind.alias("type"),
            F.struct(
                F.when(roll == 0, level).alias("level"),
                F.when(roll == 0, F.array(F.struct(F.lit("text").alias("type"), F.left(line, F.lit(30)).alias("content")))).alias("title_content"),
                F.when(roll == 1, F.array(F.left(line, F.lit(12)))).alias("table_caption"),
                F.when(roll == 1, F.concat(F.lit("<table><tr><td>"), line, F.lit("</td><td>1 . 5 %</td></tr></table>"))).alias("html"),
                F.when(roll > 1, spans).alias("paragraph_content"),
            ).alias("content"),
        )

    blocks = F.transform(F.split("text", "\n", -1), block)
    pages = F.transform(
        F.sequence(F.lit(0), F.floor((F.size("_blocks") - 1) / 20).cast("int")), lambda p: F.slice("_blocks", p * 20 + 1, F.lit(20))
    )
    rows = docs.select("doc_id", "source", blocks.alias("_blocks"))
    return rows.select("doc_id", "source", F.to_json(pages).alias("layout"))


# ---- conversations -----------------------------------------------------------------------------

FIRST_DAY = "timestamp'2024-01-01 00:00:00'"
TURNS = 1_000_000  # message id = conversation id * TURNS + turn


def _seconds(n: Column) -> Column:
    return F.expr(FIRST_DAY) + F.make_dt_interval(secs=n)


def messages(spark: SparkSession, folder: str) -> DataFrame:
    """``id, conversation_id, role, content (JSON), created_at``."""
    rows = read_table(spark, folder, "conversations")
    return rows.select(
        (F.col("conv_id") * TURNS + F.col("turn")).alias("id"),
        F.col("conv_id").alias("conversation_id"),
        "role",
        F.to_json(F.struct("text")).alias("content"),
        _seconds(F.col("turn")).alias("created_at"),
    )


def conversations(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation rows: those with messages, and untouched ones without any."""
    ids = read_table(spark, folder, "conversations").select(F.col("conv_id").alias("id")).distinct()
    untouched = ids.where(F.col("id") % 2 == 0).select((F.col("id") + TURNS).alias("id"))
    rows = ids.unionByName(untouched)
    n = F.col("id")
    return rows.select(
        "id",
        (n % 50).alias("user_id"),
        F.when(n % 4 == 0, " ").when(n % 4 == 1, F.concat(F.lit("chat "), n.cast("string"))).alias("title"),
        F.when(n % 3 == 0, F.lit('{"text":"stored"}')).alias("last_message"),
        F.when(n % 5 != 0, (n % 2)).cast("int").alias("message_count"),
        F.when(n % 6 != 0, _seconds(n)).alias("created_at"),
        F.when(n % 8 > 1, _seconds(n * 2)).alias("updated_at"),
        (n % 7 == 0).alias("is_deleted"),
    )


def turn_pairs(spark: SparkSession, folder: str, gap: int = 1) -> DataFrame:
    """``id, conv_id, turn, question, reply``: user turns with the assistant turn ``gap`` later."""
    rows = read_table(spark, folder, "conversations")
    asked = rows.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))
    said = rows.where(F.col("role") == "assistant").select("conv_id", (F.col("turn") - gap).alias("turn"), F.col("text").alias("reply"))
    return asked.join(said, ["conv_id", "turn"]).withColumn("id", F.col("conv_id") * TURNS + F.col("turn"))


def qa_records(spark: SparkSession, folder: str) -> DataFrame:
    """``id, split, questions, answers`` with JSON lists; one question list in five holds a nested list."""
    rows = turn_pairs(spark, folder)
    nested = hash_mod(5, "nest", F.col("id")) == 0
    head = F.left("question", F.lit(50))
    plain = F.to_json(F.array(F.col("question"), F.lit("  ")))
    deep = F.concat(F.lit("["), F.to_json(F.array(F.concat(F.lit(" "), head), F.lit(""))), F.lit(","), F.to_json(F.struct("question")), F.lit("]"))
    deep = F.replace(F.replace(deep, F.lit('{"question":'), F.lit("")), F.lit("}]"), F.lit("]"))
    return rows.select(
        "id",
        F.element_at(F.array(F.lit("train"), F.lit("validation"), F.lit("test")), (F.col("id") % 3 + 1).cast("int")).alias("split"),
        F.when(nested, deep).otherwise(plain).alias("questions"),
        F.to_json(F.array(F.col("reply"), F.lit(" "))).alias("answers"),
    )


# ---- judgements --------------------------------------------------------------------------------


def judge_replies(spark: SparkSession, folder: str) -> DataFrame:
    """``id, raw``: one judge reply per message, some wrapped in prose, some unreadable."""
    from passagemill.functions.judging import DIMENSIONS

    n = F.col("id")

    def dimension(d: str, side: str) -> Column:
        missing = hash_mod(20, "miss", d, side, n) == 0
        return F.when(~missing, hash_mod(7, d, side, n)).alias(d)

    reply = F.to_json(
        F.struct(
            F.element_at(F.array(*[F.lit(w) for w in ("A", "b ", "TIE", "x")]), (hash_mod(4, "winner", n) + 1).cast("int")).alias("winner"),
            *[(hash_mod(10, "overall_score", s, n) + 1).alias(f"score_{s}") for s in "ab"],
            *[F.struct(*[dimension(d, s) for d in DIMENSIONS]).alias(f"dimensions_{s}") for s in "ab"],
            F.lit("because").alias("reason"),
        )
    )
    roll = hash_mod(33, "format", n)
    raw = F.when(roll == 0, "no verdict {").when(roll < 3, F.concat(F.lit("Verdict: "), reply, F.lit(" done."))).otherwise(reply)
    return messages(spark, folder).select("id", raw.alias("raw"))


def blind_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """``id, question, base, dpo``: each message with its text and the second half of it as two answers."""
    rows = read_table(spark, folder, "conversations")
    return rows.select(
        (F.col("conv_id") * TURNS + F.col("turn")).alias("id"),
        F.col("text").alias("question"),
        F.concat(F.lit("a "), "text").alias("base"),
        F.concat(F.lit("b "), F.right("text", F.floor(F.length("text") / 2).cast("int"))).alias("dpo"),
    )


# ---- generation events -------------------------------------------------------------------------

DELTA_CHARS = 20


def generation_events(spark: SparkSession, folder: str) -> DataFrame:
    """``request, seq, type, text, answer, usage``: assistant texts as 20-character deltas and an end or error."""
    rows = read_table(spark, folder, "conversations").where(F.col("role") == "assistant")
    rows = rows.select((F.col("conv_id") * TURNS + F.col("turn")).alias("request"), "text")
    parts = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{DELTA_CHARS}}}"), F.lit(0))
    deltas = unnest(rows, ["request"], parts, "part", "seq").withColumnRenamed("part", "text")
    roll = hash_mod(50, "fate", F.col("request"))
    last = rows.where(roll != 1).select(
        "request",
        F.size(parts).alias("seq"),
        F.when(roll == 0, "error").otherwise("end").alias("type"),
        F.when(roll > 9, F.concat(F.col("text"), F.lit(" "))).alias("answer"),
        F.when(roll > 0, F.length("text").cast("bigint")).alias("completion_tokens"),
    )
    events = deltas.withColumn("type", F.lit("delta")).unionByName(last, allowMissingColumns=True)
    return events.select("request", F.col("seq").cast("bigint").alias("seq"), "type", "text", "answer", "completion_tokens")
