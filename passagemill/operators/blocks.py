"""Heading and paragraph blocks of plain text, and the heading path over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.functions.text import clean_paragraph, strip
from passagemill.operators.spread import block_of, carry_last, unnest

# Numbering patterns of heading levels 1 to 4, and the longest line taken for a heading.
HEADING_PATTERNS = (
    (1, r"^[一二三四五六七八九十百]+[、．.]"),
    (2, r"^[（(][一二三四五六七八九十]+[）)]"),
    (3, r"(?U)^\d+[.．]\s"),
    (4, r"(?U)^[（(]\d+[）)]"),
)
HEADING_MAX_CHARS = 40
SENTENCE_END = r"[，。；！？,;!?]$"
IMPLICIT_LEVEL = 2

LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def heading_level(line: Column) -> Column:
    """1..4 by numbering, 2 for a short line without closing punctuation, else 0."""
    text = strip(line)
    level = F.when((text == "") | (F.length(text) > HEADING_MAX_CHARS), 0)
    for value, pattern in HEADING_PATTERNS:
        level = level.when(F.regexp_like(text, F.lit(pattern)), value)
    return level.when(~F.regexp_like(text, F.lit(SENTENCE_END)), IMPLICIT_LEVEL).otherwise(0)


def text_blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Blocks of plain text: ``key, pos, type, level, text``, with ``pos`` increasing inside a document.

    Paragraphs are separated by blank lines; a first line that reads as a heading
    becomes a block of its own. Narrow: no shuffle.
    """
    paras = F.transform(F.split(strip(F.col(text)), r"(?U)\n\s*\n", -1), strip)
    rows = unnest(docs, [key], F.filter(paras, lambda p: p != ""), "_raw", "_para")
    rows = rows.withColumn("_lines", F.split("_raw", LINE_BREAK, -1))
    rows = rows.withColumn("_level", heading_level(F.col("_lines")[0]))
    is_heading = F.col("_level") > 0
    rest = clean_paragraph(F.array_join(F.slice("_lines", F.lit(2), F.size("_lines")), "\n"), newlines=False)
    body = F.when(is_heading, rest).otherwise(clean_paragraph(F.col("_raw"), newlines=False))

    def block(kind: str, level: Column, content: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), level.cast("int").alias("level"), content.alias("text"))

    parts = F.array(
        F.when(is_heading, block("heading", F.col("_level"), strip(F.col("_lines")[0]))),
        F.when(body != "", block("paragraph", F.lit(0), body)),
    )
    flat = unnest(rows, [key, "_para"], parts, "_block", "_part").where(F.col("_block").isNotNull())
    return flat.select(key, (F.col("_para") * 2 + F.col("_part")).alias("pos"), "_block.*")


def heading_paths(blocks: DataFrame, key: str, levels: int = 6, sep: str = " > ") -> DataFrame:
    """Add ``headings``, the path of open headings at each block.

    A heading of level L stays open until a heading of the same or a smaller level
    follows, so the latest heading of L is open exactly when it comes after the
    latest heading of every smaller level.
    """
    slots = [f"_h{n}" for n in range(1, levels + 1)]
    mine = F.struct(F.col("pos").alias("pos"), F.col("text").alias("text"))
    marked = blocks.withColumns(
        {s: F.when((F.col("type") == "heading") & (F.col("level") == n), mine) for n, s in enumerate(slots, 1)}
    )
    carried = carry_last(marked, [key], ["pos"], slots, block_of(F.col("pos")))
    shown, newest = [], F.lit(-1).cast("bigint")
    for s in slots:
        pos = F.coalesce(F.col(s)["pos"], F.lit(-1))
        shown.append(F.when(pos > newest, F.col(s)["text"]))
        newest = F.greatest(newest, pos)
    return carried.withColumn("headings", F.concat_ws(sep, *shown)).drop(*slots)
