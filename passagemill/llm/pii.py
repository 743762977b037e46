"""Personal data in texts: proposed by patterns, confirmed by checks, weighed by the words around them.

Each kind has a pattern that proposes spans (leftmost, non-overlapping within the kind), a check
that confirms them (the Luhn sum of card numbers, the remainder by 97 of IBANs, ranges of
digits) and a confidence that a context word nearby raises. The ``BASE`` kinds keep every
confirmed span; the kinds that the library adds keep those whose score reaches ``LEAST_SCORE``.

Everything is one row-wise expression of Spark's own functions: no shuffle, no Python. Splitting
a text at a pattern gives the gaps between its matches; running sums of gap and match lengths
are the places, kept in blocks so that a text with very many matches costs about its length.
The patterns never read a run of characters twice: a match can only begin at the start of a
run or where the last match ended, and what they repeat is not given back.

Defined results: places are code points of the whole text, the end exclusive; a null text is
empty and has no spans; every row is judged by itself, so repeated rows, null ids and ids with
several texts change nothing; spans of different kinds may overlap; all columns of the table
stay in ``doc``, whatever their names; an empty table gives no rows. The context of a span
reaches ``BEFORE`` code points back and ``AFTER`` on, but not past a neighbour of its own kind.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.functions.text import let

BEFORE, AFTER, CONTEXT_GAIN, LEAST_SCORE = 48, 24, 0.3, 0.6
#: Matches whose running sums are made together.
BLOCK = 512


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    confirmed: Callable[[Column], Column]
    confidence: float
    context: tuple[str, ...]
    base: bool = False
    #: A string without which no match is possible; spares most texts the pattern.
    needs: str = ""


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def byte_parts(c: Column) -> Column:
    """All dotted parts are at most 255, leading zeros or not."""
    short = lambda p: let(F.regexp_replace(p, "^0+", ""), lambda z: (F.length(z) <= 3) & (F.concat(F.lit("0"), F.left(z, F.lit(3))).cast("int") <= 255))
    return F.forall(F.split(c, r"\."), short)


def luhn_number(c: Column) -> Column:
    return let(digits(c), lambda d: F.length(d).between(12, 19) & F.call_function("luhn_check", F.left(d, F.lit(19))))


def phone_length(c: Column) -> Column:
    return F.length(digits(c)).between(9, 15)


def iban_remainder(c: Column) -> Column:
    """The first four characters moved to the end, letters as 10 to 35: the number leaves 1 by 97."""

    def remainder(turned: Column) -> Column:
        places = F.sequence(F.lit(1), F.length(turned))
        code = lambda i: F.ascii(F.substring(turned, i, F.lit(1)))
        add = lambda r, i: let(code(i), lambda a: F.when(a < 58, r * 10 + a - 48).otherwise(r * 100 + a - 55) % 97)
        return F.aggregate(places, F.lit(0), add)

    def valid(x: Column) -> Column:
        return F.length(x).between(15, 34) & (remainder(F.concat(F.substring(x, F.lit(5), F.lit(34)), F.left(x, F.lit(4)))) == 1)

    return let(F.regexp_replace(c, " ", ""), valid)


def issued_number(c: Column) -> Column:
    """A social security number of a range that is given out."""
    return ~F.rlike(c, F.lit("^(?:000|666|9)|-00-|-0000$"))


def calendar_day(c: Column) -> Column:
    return F.try_to_date(c, "yyyy-MM-dd").isNotNull()


_NO_WORD_BEFORE, _NO_WORD_AFTER = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda c: F.lit(True), 0.9, ("mail", "email", "e-mail", "contact", "write"), True, "@"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", byte_parts, 0.6, ("ip", "address", "host", "login", "server"), True, "."),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", luhn_number, 0.7, ("card", "visa", "mastercard", "amex", "credit", "debit"), True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", phone_length, 0.6, ("phone", "tel", "call", "mobile", "fax", "whatsapp"), True, "+"),
    Kind("iban", _NO_WORD_BEFORE + r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)" + _NO_WORD_AFTER, iban_remainder, 0.8, ("iban", "account", "bank", "bic", "transfer")),
    Kind("ssn", _NO_WORD_BEFORE + r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + _NO_WORD_AFTER, issued_number, 0.4, ("ssn", "social security"), False, "-"),
    Kind("birth", _NO_WORD_BEFORE + r"(?:19|20)[0-9]{2}-[01][0-9]-[0-3][0-9]" + _NO_WORD_AFTER, calendar_day, 0.3, ("born", "birth", "birthday", "dob"), False, "-"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def running_sums(widths: Column) -> Column:
    """The sum of all values before each one; long arrays are folded block by block."""

    def sums(values: Column, start: Column) -> Column:
        return F.aggregate(values, F.array(start), lambda done, w: F.concat(done, F.array(F.element_at(done, -1) + w)))

    def blocks(w: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(w) - 1) / BLOCK).cast("int"))
        part = lambda i: F.slice(w, i * BLOCK + 1, F.lit(BLOCK))
        totals = F.transform(numbers, lambda i: F.aggregate(part(i), F.lit(0).cast("long"), lambda a, x: a + x))
        inside = lambda starts: F.flatten(F.transform(numbers, lambda i: let(part(i), lambda p: F.slice(sums(p, F.get(starts, i)), F.lit(1), F.size(p)))))
        return let(sums(totals, F.lit(0).cast("long")), inside)

    return F.when(F.size(widths) > 0, let(widths, blocks)).otherwise(F.array().cast("array<bigint>"))


def spans_of(text: Column, kind: Kind, order: int) -> Column:
    """Confirmed spans of one kind as ``start, listed, end, kind, score``."""
    pattern = F.lit(kind.pattern)
    near = F.lit(rf"(?:^|[^a-z])(?:{'|'.join(kind.context)})(?:[^a-z]|$)")
    lowered = lambda c: F.translate(c, _UPPER, _LOWER)

    def spans(x: Column) -> Column:
        gaps, hits = x["gaps"], x["hits"]
        widths = F.transform(hits, lambda h, i: (F.length(F.get(gaps, i)) + F.length(h)).cast("long"))

        def placed(before: Column) -> Column:
            def span(h: Column, i: Column) -> Column:
                start = F.get(before, i) + F.length(F.get(gaps, i))
                told = F.rlike(lowered(F.right(F.get(gaps, i), F.lit(BEFORE))), near) | F.rlike(lowered(F.left(F.get(gaps, i + 1), F.lit(AFTER))), near)
                score = F.least(F.lit(1.0), F.lit(kind.confidence) + F.when(told, CONTEXT_GAIN).otherwise(0.0))
                fields = (start.alias("start"), F.lit(order).alias("listed"), (start + F.length(h)).alias("end"), F.lit(kind.name).alias("kind"), score.alias("score"))
                return F.when(kind.confirmed(h), F.struct(*fields))

            kept = (lambda s: s.isNotNull()) if kind.base else (lambda s: s.isNotNull() & (s["score"] >= LEAST_SCORE))
            return F.filter(F.transform(hits, span), kept)

        return let(running_sums(widths), placed)

    parts = F.struct(F.split(text, kind.pattern, -1).alias("gaps"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("hits"))
    none = F.array().cast("array<struct<start:bigint,listed:int,end:bigint,kind:string,score:double>>")
    possible = F.rlike(text, pattern)
    if kind.needs:
        possible = F.contains(text, F.lit(kind.needs)) & possible
    return F.when(possible, let(parts, spans)).otherwise(none)


def written(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def found(docs: DataFrame, text_col: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """``doc`` (the row), ``base`` and ``spans``: arrays of ``start, listed, end, kind, score`` by start and listed kind."""
    rows = docs.select(F.struct("*").alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))
    each = [(k, spans_of(F.col("body"), k, i)) for i, k in enumerate(kinds)]
    of = lambda base: [c for k, c in each if k.base == base]
    rows = rows.select("doc", F.array_sort(F.concat(*of(True))).alias("base"), F.concat(*of(False)).alias("added"))
    return rows.select("doc", "base", F.array_sort(F.concat("base", "added")).alias("spans"))


def counted(spans: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """``doc`` with the number of base spans of each kind, the digest of their places, and all spans as text."""
    number = lambda name: F.size(F.filter("base", lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")
    digest = F.sha2(F.encode(written(F.col("base")), "UTF-8"), 256)
    return spans.select("doc", *[number(k.name) for k in kinds if k.base], digest.alias("base_sha256"), written(F.col("spans")).alias("spans"))
