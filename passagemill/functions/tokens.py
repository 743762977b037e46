"""Token lists and token-count estimates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from passagemill.functions.text import let

# Fixed value: one CJK character, or a run of ASCII word characters.
TOKEN = "[\\u4e00-\\u9fff]|[A-Za-z0-9_]+"

# Fixed value: whitespace as JavaScript's \s sees it.
_JS_SPACE = "\\t\\n\\x0b\\f\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"


def tokenize(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TOKEN), F.lit(0))


def estimate_tokens(c: Column) -> Column:
    """CJK characters + a quarter of the rest + a quarter of the punctuation, each rounded up.

    Lengths count UTF-16 units, so a character outside the basic plane weighs two.
    """

    def weigh(text: Column) -> Column:
        cjk = F.regexp_count(text, F.lit("[\\u3400-\\u9fff]"))
        wide = F.regexp_count(text, F.lit("[\\x{10000}-\\x{10ffff}]"))
        marks = F.regexp_count(text, F.lit(f"[^A-Za-z0-9_{_JS_SPACE}]")) + wide
        rest = F.length(text) + wide - cjk
        total = cjk + F.ceil(rest / 4) + F.ceil(marks * 0.25)
        return F.when(F.regexp_like(text, F.lit(f"[^{_JS_SPACE}]")), total).otherwise(F.lit(0)).cast("bigint")

    return let(F.coalesce(c.cast("string"), F.lit("")), weigh)


def coverage(query_tokens: Column, text_tokens: Column) -> Column:
    """Share of the distinct query tokens that occur in the text."""
    asked = F.array_distinct(query_tokens)
    return F.when(F.size(asked) == 0, F.lit(0.0)).otherwise(
        F.size(F.array_intersect(asked, text_tokens)) / F.size(asked)
    )
