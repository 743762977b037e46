"""Identifiers, file names and reproducible choices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from passagemill.functions.text import let, norm, strip, truncate_utf8

# What stands in for a missing source or title.
UNKNOWN_SOURCE, UNKNOWN_TITLE = "未知来源", "未知"

_UNSAFE = r'[<>:"/\\|?*]'


def hash_int(*parts: Column | str | int) -> Column:
    """A 32-bit number from the md5 of ``a:b:c``; the same on every engine, run and partitioning."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    digest = F.md5(F.concat_ws(":", *[c.cast("string") for c in cols]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def hash_mod(n: int, *parts: Column | str | int) -> Column:
    return F.pmod(hash_int(*parts), F.lit(n))


def source_or_default(c: Column) -> Column:
    return F.coalesce(F.nullif(norm(c), F.lit("")), F.lit(UNKNOWN_SOURCE))


def title_or_default(c: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(UNKNOWN_TITLE))


def ingest_key(source: Column) -> Column:
    """Catalogue key of a document: sha1 of its source."""
    return F.sha1(F.encode(source_or_default(source), "UTF-8"))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    """File name without its last suffix; a leading dot belongs to the name."""
    return F.regexp_replace(file_name(path), r"(?<=[^.])\.[^.]+$", "")


def suffix(path: Column) -> Column:
    return F.regexp_extract(file_name(path), r"[^.](\.[^.]+)$", 1)


def safe_file_name(data_id: Column, fallback: Column) -> Column:
    base = F.when(F.coalesce(data_id, F.lit("")) != "", stem(data_id)).otherwise(stem(F.coalesce(fallback, F.lit(""))))
    name = F.coalesce(F.nullif(strip(base), F.lit("")), F.lit("result"))
    return F.regexp_replace(name, _UNSAFE, "_")


def safe_path(c: Column) -> Column:
    """Path fragment without empty or dot segments and without characters unsafe in file names."""
    parts = F.split(F.replace(norm(c), F.lit("\\"), F.lit("/")), "/", -1)
    kept = F.filter(parts, lambda p: ~p.isin("", ".", ".."))
    clean = F.transform(
        kept, lambda p: F.coalesce(F.nullif(strip(F.regexp_replace(p, _UNSAFE, "_")), F.lit("")), F.lit("unknown"))
    )
    return F.array_join(clean, "/")


def document_id(path: Column, max_bytes: int = 128) -> Column:
    """The path itself when short enough, else ``category/stem__hash.ext`` within ``max_bytes`` bytes."""

    def hashed(p: Column) -> Column:
        ext = F.coalesce(F.nullif(suffix(p), F.lit("")), F.lit(".pdf"))
        digest = F.left(F.md5(F.encode(p, "UTF-8")), F.lit(10))
        category = F.when(F.contains(p, F.lit("/")), F.substring_index(p, "/", 1)).otherwise(F.lit("root"))
        prefix = F.concat(F.coalesce(F.nullif(truncate_utf8(category, 32), F.lit("")), F.lit("root")), F.lit("/"))
        parts = F.struct(prefix.alias("prefix"), stem(p).alias("stem"), F.concat(F.lit("__"), digest, ext).alias("tail"))

        def fitted(x: Column) -> Column:
            room = F.lit(max_bytes) - F.octet_length(x["prefix"]) - F.octet_length(x["tail"])
            short = truncate_utf8(x["stem"], F.greatest(room, F.lit(0)))
            named = F.concat(x["prefix"], F.coalesce(F.nullif(short, F.lit("")), F.lit("f")), x["tail"])
            return F.when(room < 1, F.concat(F.lit("f/"), F.substring(x["tail"], 3, max_bytes))).otherwise(named)

        return truncate_utf8(let(parts, fitted), max_bytes)

    return let(path, lambda p: F.when(F.octet_length(p) <= max_bytes, p).otherwise(hashed(p)))


def path_fields(path: Column) -> dict[str, Column]:
    """``title``, ``source`` and ``category`` of a corpus file from its path under the corpus root.

    An extracted ``<category>/<doc>/full.md`` stands for the original ``<category>/<doc>.pdf``.
    """
    parts = F.split(path, "/", -1)
    folder = F.regexp_replace(path, r"/[^/]*$", "")
    extracted = (F.lower(file_name(path)) == "full.md") & (F.size(parts) >= 2)
    return {
        "title": F.when(extracted, file_name(folder)).otherwise(stem(path)),
        "source": F.when(extracted, F.concat(folder, F.lit(".pdf"))).otherwise(path),
        "category": F.when(F.size(parts) >= 2, F.element_at(parts, 1)).otherwise(F.lit("")),
    }
