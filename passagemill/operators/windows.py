"""Fixed character windows with overlap, and the length profile of chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.functions.text import drop_blank_lines, let, strip
from passagemill.operators.spread import quantiles, unnest


def window_pieces(text: Column, max_chars: int, step: int) -> Column:
    """Windows of ``max_chars`` characters every ``step`` characters, trimmed, empty ones dropped.

    The text is cut once into step-sized pieces, so the cost grows with the text
    and not with its square, as repeated substrings of a long text would.
    """
    if max_chars < 1 or step < 1:
        raise ValueError("max_chars and step must be positive")
    span = -(-max_chars // step)

    def windows(t: Column) -> Column:
        count = F.greatest(F.ceil((F.length(t) - max_chars) / step) + 1, F.lit(1)).cast("int")
        return let(
            F.regexp_extract_all(t, F.lit(f"(?s).{{1,{step}}}"), F.lit(0)),
            lambda steps: F.transform(
                F.sequence(F.lit(1), count),
                lambda i: strip(F.left(F.array_join(F.slice(steps, i, F.lit(span)), ""), F.lit(max_chars))),
            ),
        )

    return let(text, lambda t: F.when(F.length(t) <= max_chars, F.array(t)).otherwise(windows(t)))


def overlapped(text: Column, max_chars: int, overlap: int) -> Column:
    """Hard split: an overlap as long as the window falls back to a quarter of it."""
    if overlap >= max_chars:
        overlap = max_chars // 4
    return F.filter(window_pieces(text, max_chars, max(max_chars - max(overlap, 0), 1)), lambda p: p != "")


def layout_pieces(text: Column, max_chars: int, overlap: int) -> Column:
    """As ``overlapped``, but an overlap too long only slows the windows down to one character a step."""
    return F.filter(window_pieces(text, max_chars, max(max_chars - overlap, 1)), lambda p: p != "")


def append_pieces(text: Column, max_chars: int = 1000, overlap: int = 120) -> Column:
    """Windows over the text without blank lines, as appended documents are cut."""
    if not 0 <= overlap < max_chars:
        raise ValueError("overlap must be at least 0 and below max_chars")
    return F.filter(window_pieces(drop_blank_lines(text), max_chars, max_chars - overlap), lambda p: p != "")


def as_chunks(docs: DataFrame, key: str, pieces: Column) -> DataFrame:
    """One row per piece: ``key, chunk_id, content``; ids restart at 0 in every document."""
    return unnest(docs, [key], pieces, "content", "chunk_id").select(key, "chunk_id", "content")


PROFILE_PROBS = {"p50": 0.50, "p90": 0.90, "p95": 0.95}


def length_profile(chunks: DataFrame, keys: list[str], content: str, max_chars: int) -> DataFrame:
    """p50/p90/p95/max of chunk lengths per group (floor-index rule), with the two sizing warnings."""
    sized = chunks.select(*keys, F.length(content).cast("double").alias("_len"))
    marks = quantiles(sized, keys, "_len", PROFILE_PROBS, rule="floor")
    top = sized.groupBy(*keys).agg(F.max("_len").alias("longest"), F.count("*").alias("chunks"))
    out = marks.join(top, keys) if keys else marks.select("*", top.select("longest").scalar().alias("longest"), top.select("chunks").scalar().alias("chunks"))
    return out.withColumns(
        {
            "too_small": F.col("p95") < int(max_chars * 0.45),
            "too_long": F.col("longest") > max_chars,
        }
    )
