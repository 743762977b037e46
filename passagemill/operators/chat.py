"""Conversations and messages: summaries, history under a token budget, prompts, accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagemill.functions.prompts import message_text, usage_fields
from passagemill.functions.text import norm, strip
from passagemill.functions.tokens import estimate_tokens
from passagemill.operators.spread import computed_once, next_value, running_sum

# Token limits of a prompt and the cost of a message beyond its text.
PROMPT_TOKENS, REPLY_TOKENS, HISTORY_TOKENS, SAFETY_TOKENS, MESSAGE_COST = 4096, 1024, 2048, 128, 4
DEFAULT_TITLE = "新对话"


def summaries(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Live conversations with their latest message and message count.

    One pass over the messages that combines before the shuffle, so a conversation
    with very many messages is no single task's work.
    """
    latest = messages.groupBy("conversation_id").agg(
        F.max_by("content", F.struct("created_at", "id")).alias("_latest"), F.count("*").alias("_count")
    )
    live = conversations.where(~F.col("is_deleted"))
    return live.join(latest, live["id"] == latest["conversation_id"], "left").select(
        live["id"],
        "user_id",
        "title",
        F.coalesce("_latest", "last_message").alias("last_message"),
        F.coalesce("_count", F.lit(0)).alias("message_count"),
        live["created_at"],
        "updated_at",
    )


def user_page(summary: DataFrame, user_id: int) -> DataFrame:
    return summary.where(F.col("user_id") == user_id).orderBy(F.col("updated_at").desc(), F.col("id").desc())


def accessible_messages(messages: DataFrame, conversations: DataFrame, requests: DataFrame) -> DataFrame:
    """Messages of the requested conversations the asking user owns and that are not deleted.

    ``requests`` is ``conversation_id, user_id``.
    """
    owned = conversations.where(~F.col("is_deleted")).select(F.col("id").alias("conversation_id"), "user_id")
    allowed = owned.join(requests.select("conversation_id", "user_id"), ["conversation_id", "user_id"], "left_semi")
    return messages.join(allowed, "conversation_id", "left_semi")


def history_budget(question: Column, system: Column, context: Column, reply_tokens: Column | None = None) -> Column:
    """Tokens left for history once question, system prompt, context, reply and margin are set aside."""
    reply = F.lit(REPLY_TOKENS)
    if reply_tokens is not None:
        reply = F.when(reply_tokens > 0, reply_tokens).otherwise(reply)
    fixed = reply + estimate_tokens(question) + estimate_tokens(system) + estimate_tokens(strip(F.coalesce(context, F.lit("")))) + SAFETY_TOKENS
    return F.least(F.lit(HISTORY_TOKENS), F.greatest(F.lit(0), PROMPT_TOKENS - fixed)).cast("bigint")


def history_within(messages: DataFrame, budgets: DataFrame) -> DataFrame:
    """The newest messages whose cost adds up to at most the conversation's ``budget``.

    The running sum goes from the newest message back, in blocks of an hour, so a very long
    conversation is summed by many tasks and no number of messages is presumed.
    """
    rows = computed_once(messages.select("conversation_id", "id", "created_at", "role", F.col("content").alias("_raw")), content=message_text(F.col("_raw")))
    rows = rows.drop("_raw").where(F.col("content") != "")
    costed = computed_once(rows, cost=estimate_tokens(F.col("content")) + MESSAGE_COST)
    hour = F.floor(F.unix_timestamp("created_at") / 3600)
    newest = [F.col("created_at").desc(), F.col("id").desc()]
    summed = running_sum(costed, ["conversation_id"], newest, F.col("cost"), "used", -F.coalesce(hour, F.lit(-(2**40))))
    used = summed.join(budgets.select("conversation_id", "budget"), "conversation_id")
    role = F.when(F.lower("role") == "assistant", F.lit("assistant")).otherwise(F.lit("user"))
    return used.where(F.col("used") <= F.col("budget")).select("conversation_id", "id", "created_at", role.alias("role"), "content", "cost", "used")


def folded(messages: DataFrame, keys: list[str], order: list[str], block: Column) -> DataFrame:
    """User and assistant messages with text; of neighbours with the same role only the last stays."""
    clean = messages.withColumns({"role": F.lower(norm(F.col("role"))), "content": norm(F.col("content"))})
    clean = clean.where(F.col("role").isin("user", "assistant") & (F.col("content") != ""))
    ahead = next_value(clean, keys, order, "role", "_next_role", block)
    return ahead.where(~F.equal_null("role", "_next_role")).drop("_next_role")


def chat_messages(requests: DataFrame, history: DataFrame, default_system: str) -> DataFrame:
    """``conversation_id, messages``: system prompt, history in order, then the user's text.

    ``requests`` is ``conversation_id, system_prompt, user_text``; ``history`` has been
    trimmed to a token budget, so the list per conversation is short.
    """

    def said(role: Column, content: Column) -> Column:
        return F.struct(role.alias("role"), content.alias("content"))

    lists = history.groupBy("conversation_id").agg(F.array_sort(F.collect_list(F.struct("created_at", "id", "role", "content"))).alias("_h"))
    joined = requests.join(lists, "conversation_id", "left")
    system = F.coalesce(F.nullif(norm(F.col("system_prompt")), F.lit("")), F.lit(default_system))
    first, last = said(F.lit("system"), system), said(F.lit("user"), F.col("user_text"))
    past = F.transform("_h", lambda m: said(m["role"], m["content"]))
    alone = F.array(first, last)
    return joined.select(
        "conversation_id",
        F.when(F.col("_h").isNull(), alone).otherwise(F.concat(F.array(first), past, F.array(last))).alias("messages"),
    )


def token_accounting(messages: DataFrame, usage: DataFrame) -> DataFrame:
    """Messages with ``tokens``: prompt tokens on the user's, completion tokens on the assistant's message.

    ``usage`` is ``id, prompt_tokens, completion_tokens`` of the message it belongs to.
    """
    fields = usage_fields(F.col("prompt_tokens"), F.col("completion_tokens"))
    known = usage.select("id", *[c.alias(f"_{n}") for n, c in fields.items()])
    joined = messages.join(known, "id", "left")
    tokens = F.when(F.col("role") == "user", F.col("_prompt_tokens")).when(F.col("role") == "assistant", F.col("_completion_tokens"))
    return joined.withColumn("tokens", tokens).select(*messages.columns, "tokens")


def token_totals(accounted: DataFrame) -> DataFrame:
    def of(role: str) -> Column:
        return F.sum(F.when(F.col("role") == role, F.coalesce("tokens", F.lit(0))).otherwise(F.lit(0)))

    return accounted.groupBy("conversation_id").agg(
        of("user").alias("prompt_tokens"), of("assistant").alias("completion_tokens"), F.count("tokens").alias("counted_messages")
    )


def normalised(conversations: DataFrame, now: Column) -> DataFrame:
    """Default title and the time fallback updated -> created -> now."""
    title = F.when(norm(F.col("title")) != "", F.col("title")).otherwise(F.lit(DEFAULT_TITLE))
    return conversations.withColumns(
        {
            "title": title,
            "updated_at": F.coalesce("updated_at", "created_at", now),
            "message_count": F.coalesce("message_count", F.lit(0)),
        }
    )


def duplicate_empties(conversations: DataFrame) -> DataFrame:
    """Add ``redundant``: an untouched new conversation that is not the user's newest one of that kind."""
    empty = (F.trim("title") == DEFAULT_TITLE) & (F.col("message_count") == 0)
    newest = conversations.where(empty).groupBy("user_id").agg(F.max_by("id", F.struct("updated_at", "id")).alias("_keep"))
    joined = conversations.join(newest, "user_id", "left")
    return joined.withColumn("redundant", empty & (F.col("id") != F.col("_keep"))).drop("_keep")
