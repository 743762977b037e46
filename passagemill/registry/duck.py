"""Snippets of DuckDB SQL shared by the checks."""

from __future__ import annotations

# Whitespace as Python sees it; RE2's \s is ASCII only.
WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def collapse(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{WS}+', ' ', 'g'), ' ')"


def newlines(x: str) -> str:
    return rf"regexp_replace({x}, '\r\n?', chr(10), 'g')"


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower(coalesce({x}, '')), '[一-鿿]|[A-Za-z0-9_]+')"


def hash_int(*parts: str) -> str:
    joined = " || ':' || ".join(f"cast({p} as varchar)" for p in parts)
    return f"cast('0x' || substr(md5({joined}), 1, 8) as bigint)"


def hash_mod(n: int, *parts: str) -> str:
    return f"({hash_int(*parts)} % {n})"


def cut_before(x: str, marker: str) -> str:
    """Text before ``marker`` unless it starts the text."""
    return f"case when instr({x}, '{marker}') > 1 then left({x}, instr({x}, '{marker}') - 1) else {x} end"


def clip(x: str, limit: int, suffix: str) -> str:
    s = strip(f"coalesce({x}, '')")
    return f"case when length({s}) > {limit} then left({s}, {limit}) || '{suffix}' else {s} end"


def with_(*ctes: str, select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + select
