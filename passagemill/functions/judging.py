"""Reading judge replies and model scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from passagemill.functions.text import collapse_spaces, let, strip

# Judged dimensions, all metrics, weights of the weighted score, model names.
DIMENSIONS = ("factual_consistency", "safety", "relevance", "completeness", "clarity", "boundary_awareness")
METRICS = ("overall_score",) + DIMENSIONS
WEIGHTS = {"factual_consistency": 0.35, "safety": 0.35, "completeness": 0.15, "relevance": 0.10, "clarity": 0.05}
MODELS = ("base", "dpo")


def is_object(json_text: Column) -> Column:
    variant = F.try_parse_json(F.nullif(json_text, F.lit("")))
    return F.coalesce(F.startswith(F.schema_of_variant(variant), F.lit("OBJECT")), F.lit(False))


def reply_json(raw: Column) -> Column:
    """The reply as JSON text: the whole of it, else from the first ``{`` to the last ``}``, else null."""


    def read(text: Column) -> Column:
        inner = F.regexp_extract(text, r"\{[\s\S]*\}", 0)
        return F.when(is_object(text), text).when(is_object(inner), inner)

    return let(strip(F.coalesce(raw, F.lit(""))), read)


def winner(c: Column) -> Column:
    side = F.upper(strip(F.coalesce(c, F.lit(""))))
    return F.when(side.isin("A", "B", "TIE"), side).otherwise(F.lit("TIE"))


def dimension_score(c: Column) -> Column:
    """A score as a number within 1..5; what is not a number stays missing."""
    value = c.try_cast("double")
    return F.when(value.isNotNull(), F.greatest(F.lit(1.0), F.least(F.lit(5.0), value)))


def fact_fields(reply: Column, raw: Column) -> dict[str, Column]:
    score = F.get_json_object(reply, "$.score").try_cast("double")
    reason = F.coalesce(F.nullif(F.get_json_object(reply, "$.reason"), F.lit("")), raw)
    return {
        "fact_score": score,
        "fact_consistency": score / 5.0,
        "fact_reason": F.left(collapse_spaces(reason), F.lit(240)),
    }


def label_score(outputs: Column, part: str) -> Column:
    """Best score among classifier outputs whose label contains ``part``; 0 when there is none."""
    hits = F.filter(outputs, lambda o: F.contains(F.lower(F.coalesce(o["label"], F.lit(""))), F.lit(part)))
    best = F.array_max(F.transform(hits, lambda o: F.coalesce(o["score"].cast("double"), F.lit(0.0))))
    return F.greatest(F.coalesce(best, F.lit(0.0)), F.lit(0.0))


def not_nan(c: Column) -> Column:
    return F.nanvl(c, F.lit(None).cast("double"))
