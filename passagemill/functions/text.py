"""Cleaning and shaping of text columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Section titles after which a document carries no body text.
TAIL_MARKERS = ("参考文献", "利益冲突")

# Whitespace as Python's str.strip sees it (Unicode White_Space plus four separators).
_SPACE = r"[\s\x1c-\x1f]"


def let(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` applied to ``c``, which is computed once even when used many times or inside a lambda."""
    return F.element_at(F.transform(F.array(c), use), 1)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)^{_SPACE}+|{_SPACE}+$", "")


def norm(c: Column) -> Column:
    """Missing, blank and padded values all become one form: a stripped string."""
    return strip(F.coalesce(c.cast("string"), F.lit("")))


def blank_to_null(c: Column) -> Column:
    return F.nullif(norm(c), F.lit(""))


def collapse_spaces(c: Column) -> Column:
    """Runs of whitespace become one blank, ends trimmed, null-safe."""
    return F.trim(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), rf"(?U){_SPACE}+", " "))


def unify_newlines(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


def truncate_tail(c: Column, markers: Sequence[str] = TAIL_MARKERS) -> Column:
    """Cut at the first occurrence of each marker in turn; a marker at the very start does not cut."""
    for marker in markers:
        at = F.locate(marker, c)
        c = F.when(at > 1, F.substring(c, F.lit(1), at - 1)).otherwise(c)
    return c


def clean_paragraph(c: Column, newlines: bool = True) -> Column:
    if newlines:
        c = unify_newlines(c)
    c = F.regexp_replace(c, "DOI:[^\n]*", "")
    c = F.regexp_replace(c, "\n{3,}", "\n\n")
    c = F.regexp_replace(c, "[ \t]{2,}", " ")
    return strip(c)


def drop_blank_lines(c: Column) -> Column:
    """Each line trimmed, empty lines removed."""
    lines = F.transform(F.split(unify_newlines(c), "\n", -1), strip)
    return F.array_join(F.filter(lines, lambda line: line != ""), "\n")


# Spacing repairs for text pulled out of page layouts, in the order they apply.
LAYOUT_REPAIRS_FIRST = (
    (r"(?<![a-zA-Z\p{Nd}])([a-zA-Z\p{Nd}]) (?=[a-zA-Z\p{Nd}](?![a-zA-Z\p{Nd}]))", "$1"),
    (r"([A-Z]) ([a-z])(?![a-zA-Z])", "$1$2"),
    (r"(\p{Nd}+) \. (\p{Nd}+)", "$1.$2"),
    (r"\( ", "("),
    (r" \)", ")"),
    (r"' ", "'"),
    (r" '", "'"),
    (r" ([，。、；：！？‰°])", "$1"),
    (r" %", "%"),
    (r" ,", ","),
)
LAYOUT_CITATION = r"\[ ?\p{Nd}+(?:[, ]+\p{Nd}+)* ?\]"
LAYOUT_REPAIRS_LAST = (
    (r" ([≥≤><≈]) ", "$1"),
    (r"[ \t]+", " "),
    (r"\n{3,}", "\n\n"),
    (r"(?U)(?<![A-Za-z])(?:text|equation_inline)(?![A-Za-z])[\s\x1c-\x1f]*", ""),
    (r"(?U)[\s\x1c-\x1f]{2,}", " "),
)


def _squeeze_matches(c: Column, pattern: str) -> Column:
    """Drop blanks inside every match of ``pattern``, leaving the text around it alone."""

    def squeezed(text: Column) -> Column:
        around = F.split(text, pattern, -1)
        inside = F.transform(
            F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.replace(m, F.lit(" "), F.lit(""))
        )
        return F.array_join(F.zip_with(around, inside, lambda a, m: F.concat(a, F.coalesce(m, F.lit("")))), "")

    return let(c, lambda t: F.when(F.regexp_like(t, F.lit(pattern)), squeezed(t)).otherwise(t))


def repair_layout_spacing(c: Column) -> Column:
    """Undo the stray blanks page-layout extraction leaves in words, numbers and citations."""
    for pattern, put in LAYOUT_REPAIRS_FIRST:
        c = F.regexp_replace(c, pattern, put)
    c = _squeeze_matches(c, LAYOUT_CITATION)
    for pattern, put in LAYOUT_REPAIRS_LAST:
        c = F.regexp_replace(c, pattern, put)
    return strip(c)


def drop_hidden_markup(c: Column) -> Column:
    """Optional first pass for whole web pages: comments, scripts and styles carry no text."""
    return F.regexp_replace(c, r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>", " ")


def tags_to_spacing(c: Column) -> Column:
    c = F.regexp_replace(c, r"(?i)<br\s*/?>", "\n")
    c = F.regexp_replace(c, r"(?i)</(p|div|tr|li|h[0-9])>", "\n")
    c = F.regexp_replace(c, r"<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def strip_html(c: Column) -> Column:
    return repair_layout_spacing(tags_to_spacing(c))


def clip(c: Column, limit: int, suffix: str = "...(truncated)") -> Column:
    """Stripped text cut to ``limit`` characters; 0 or less means no limit."""
    text = strip(F.coalesce(c, F.lit("")))
    if limit <= 0:
        return text
    return let(text, lambda t: F.when(F.length(t) > limit, F.concat(F.left(t, F.lit(limit)), F.lit(suffix))).otherwise(t))


LONG_CLIP_SUFFIX = "\n...[truncated]"


def truncate_utf8(c: Column, max_bytes: Column | int) -> Column:
    """Longest prefix of at most ``max_bytes`` bytes that does not end inside a character."""
    limit = max_bytes if isinstance(max_bytes, Column) else F.lit(max_bytes)

    def cut(x: Column) -> Column:
        raw, most = F.encode(x["text"], "UTF-8"), x["most"]
        prefixes = [F.substring(raw, F.lit(1), F.greatest(most - back, F.lit(0))).cast("string") for back in range(4)]
        whole = [F.when(F.is_valid_utf8(p), p) for p in prefixes]
        return F.when(F.octet_length(x["text"]) <= most, x["text"]).otherwise(F.coalesce(*whole))

    return let(F.struct(c.alias("text"), limit.alias("most")), cut)


def heading_prefixed(headings: Column, content: Column) -> Column:
    """Passage text for encoding: heading line, then content."""
    head, body = strip(F.coalesce(headings, F.lit(""))), strip(F.coalesce(content, F.lit("")))
    return F.when(head != "", F.concat(head, F.lit("\n"), body)).otherwise(body)


def keyword_text(source: Column, headings: Column, content: Column) -> Column:
    return F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in (source, headings, content)])


# Labels of a retrieved passage in prompts.
SOURCE_LABEL, HEADING_LABEL, CONTENT_LABEL = "来源: ", "标题: ", "内容: "


def labelled_passage(source: Column, headings: Column, content: Column) -> Column:
    """Three labelled lines, as a reranker or a prompt reads a passage."""
    part = [F.coalesce(c, F.lit("")) for c in (source, headings, content)]
    return F.concat(
        F.lit(SOURCE_LABEL), part[0], F.lit("\n" + HEADING_LABEL), part[1], F.lit("\n" + CONTENT_LABEL), part[2]
    )


def page_range(pages: Column) -> Column:
    """``p3``, ``p3-p7`` or an empty string."""
    low, high = F.array_min(pages), F.array_max(pages)
    span = F.when(low == high, F.concat(F.lit("p"), low.cast("string"))).otherwise(
        F.concat(F.lit("p"), low.cast("string"), F.lit("-p"), high.cast("string"))
    )
    return F.coalesce(span, F.lit(""))


# Markers of a question and of its context inside a prompt.
QUESTION_MARK, CONTEXT_MARK = "问题：", "检索资料："


def question_of_prompt(c: Column, question_mark: str = QUESTION_MARK, context_mark: str = CONTEXT_MARK) -> Column:
    """Text after the last question marker and before the next context marker."""
    after = F.substring_index(strip(F.coalesce(c, F.lit(""))), question_mark, -1)
    return collapse_spaces(F.substring_index(after, context_mark, 1))


def claims(c: Column, min_chars: int = 8, most: int = 24) -> Column:
    """The first ``most`` sentence-like claims of an answer that are long enough to check."""
    parts = F.split(F.coalesce(c, F.lit("")), rf"(?U)(?<=[。！？!?；;]){_SPACE}+|\n+", -1)
    return F.slice(F.filter(F.transform(parts, collapse_spaces), lambda p: F.length(p) >= min_chars), 1, most)


def first_filled(*cols: Column) -> Column:
    """First candidate with text left after whitespace collapse, else an empty string."""
    return F.coalesce(*[F.nullif(collapse_spaces(c), F.lit("")) for c in cols], F.lit(""))


def tags(c: Column, most: int = 20) -> Column:
    return F.slice(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), norm), lambda t: t != ""), 1, most)


def answer_markdown(c: Column) -> Column:
    """Real newlines, literal ``\\n`` resolved when it is the only kind, a blank after heading marks."""
    text = unify_newlines(F.coalesce(c, F.lit("")))
    escaped = F.contains(text, F.lit("\\n")) & ~F.contains(text, F.lit("\n"))
    text = F.when(escaped, F.replace(text, F.lit("\\n"), F.lit("\n"))).otherwise(text)
    return F.regexp_replace(text, r"(^|\n)(\s{0,3}#{1,6})([^\s#])", "$1$2 $3")
