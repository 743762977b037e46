"""Row filters and validity checks."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.functions.text import norm

# Terms that make a question relevant to the three conditions covered.
TOPIC_KEYWORDS = (
    "高血压", "血压高", "高血糖", "血糖高", "糖尿病", "高血脂",
    "血脂高", "高脂血症", "血脂异常", "甘油三酯高", "胆固醇高", "三高",
)
CHUNK_FIELDS = ("chunk_id", "source", "category", "headings", "content")


def mentions_any(c: Column, keywords: Sequence[str] = TOPIC_KEYWORDS) -> Column:
    """Case-insensitive search for any of the literal keywords."""
    pattern = "(?iu)" + "|".join(re.escape(k) for k in keywords)
    return F.rlike(F.coalesce(c, F.lit("")), F.lit(pattern))


def catalogue_match(keyword: str) -> Column:
    """Live catalogue rows whose title, category or source contains the keyword, any case."""
    live = ~F.col("is_deleted")
    word = keyword.strip()
    if not word:
        return live
    return live & (F.ilike("title", F.lit(f"%{word}%")) | F.ilike("category", F.lit(f"%{word}%")) | F.ilike("source", F.lit(f"%{word}%")))


def filled(*names: str) -> Column:
    cond = F.lit(True)
    for name in names:
        cond = cond & (norm(F.col(name)) != "")
    return cond


def canonical(df: DataFrame, fields: Sequence[str] = CHUNK_FIELDS) -> Column:
    cond = F.lit(True)
    for name in fields:
        cond = cond & (F.col(name).isNotNull() if name in df.columns else F.lit(False))
    return cond


def schema_report(df: DataFrame, id_col: str, fields: Sequence[str] = CHUNK_FIELDS, examples: int = 3) -> DataFrame:
    """One row: how many rows lack a required field, and the first few of them by id."""
    missing = F.concat_ws(",", *[F.when(F.col(f).isNull() if f in df.columns else F.lit(True), F.lit(f)) for f in sorted(fields)])
    marked = df.select(F.col(id_col).alias("id"), missing.alias("missing"))
    bad = marked.where(F.col("missing") != "")
    worst = bad.orderBy("id").limit(examples)
    shown = worst.agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("id", "missing"))), lambda r: F.concat(r["id"].cast("string"), F.lit(": missing "), r["missing"])),
            " | ",
        ).alias("examples")
    )
    return marked.agg(F.count_if(F.col("missing") != "").alias("bad_items"), F.count("*").alias("total_items")).select(
        "*", shown.scalar().alias("examples")
    )


def require(df: DataFrame, cond: Column, message: str) -> DataFrame:
    """Fail the job on the first row that breaks ``cond``; the check runs with the scan."""
    return df.where(F.when(F.coalesce(cond, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))
