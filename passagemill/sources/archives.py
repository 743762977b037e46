"""Text members of ZIP archives."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill.functions.keys import file_name
from passagemill.functions.text import strip
from passagemill.operators.spread import ordered_concat
from passagemill.sources.files import scan_files

# Members worth keeping, and those that are running text.
KEPT_SUFFIXES = r"(?i)\.(md|markdown|txt|json)$"
TEXT_SUFFIXES = r"(?i)\.(md|markdown|txt)$"


HELD = 1 << 20  # characters of members handed back to Spark at a time


def _unzip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["archive", "place", "member", "text"]
    kinds = [pa.string(), pa.int32(), pa.string(), pa.string()]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    rows, size = [], 0
    for batch in batches:
        for path, raw in zip(batch.column(0), batch.column(1)):
            with zipfile.ZipFile(io.BytesIO(raw.as_py())) as archive:
                for place, member in enumerate(m for m in archive.infolist() if not m.is_dir()):
                    if member.filename.lower().endswith((".md", ".markdown", ".txt", ".json")):
                        text = archive.read(member).decode("utf-8", errors="replace")
                        rows.append((path.as_py(), place, member.filename, text))
                        size += len(text) + 100
                        if size >= HELD:
                            yield made(rows)
                            rows, size = [], 0
    if rows:
        yield made(rows)


def read_archives(spark: SparkSession, root: str) -> DataFrame:
    return archive_members(scan_files(spark, root, "*.zip"))


def archive_members(files: DataFrame) -> DataFrame:
    """``path, archive, place, member, text`` of the kept members of ZIP files ``path, content``; some megabytes of members at a time."""
    members = files.select("path", "content").mapInArrow(_unzip, "archive string, place int, member string, text string")
    kept = members.where(F.regexp_like("member", F.lit(KEPT_SUFFIXES))).withColumnRenamed("archive", "path")
    return kept.select("path", file_name(F.col("path")).alias("archive"), "place", "member", "text")


def archive_texts(members: DataFrame) -> DataFrame:
    """``path, archive, text``: running-text members of each archive joined by blank lines, in archive order."""
    rows = members.where(F.regexp_like("member", F.lit(TEXT_SUFFIXES)) & (strip(F.col("text")) != ""))
    rows = rows.withColumn("text", strip(F.col("text")))
    return ordered_concat(rows, ["path", "archive"], ["place"], "text", "text_joined", F.floor(F.col("place") / 64), "\n\n").withColumnRenamed(
        "text_joined", "text"
    )
