"""Corpus files as rows."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagemill.functions.rowwise import rowwise
from passagemill.functions.text import unify_newlines


BOM = "\ufeff"


def scan_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """``path, relative_path, modificationTime, length, content`` of all files under ``root``."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    )
    return files.withColumn("relative_path", relative_to(F.col("path"), root))


def relative_to(path: Column, root: str) -> Column:
    base = root.rstrip("/") + "/"
    at = F.locate(base, path)
    return F.when(at > 0, F.substring(path, at + len(base), F.length(path))).otherwise(path)


@rowwise(T.StringType(), pa.string())
def _decode_gbk(raw: bytes | None) -> str | None:
    return None if raw is None else raw.decode("gbk", errors="replace")


def read_texts(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """``relative_path, text`` of text files; see ``decoded``."""
    return decoded(scan_files(spark, root, pattern).select("relative_path", "content"))


def decoded(files: DataFrame) -> DataFrame:
    """``content`` as ``text``: UTF-8, else GBK with replacement characters. Only the rest reaches Python."""
    keys = [c for c in files.columns if c != "content"]
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    # Files are read once; Python gets the bytes of the others only.
    rest = _decode_gbk(F.when(~valid, F.col("content")))
    return files.select(*keys, unify_newlines(F.when(valid, F.col("content").cast("string")).otherwise(rest)).alias("text"))


def inventory(spark: SparkSession, root: str, extensions: tuple[str, ...] = ("pdf", "txt"), keyword: str = "") -> DataFrame:
    """Name, path, extension, size and time of files, newest first; file contents are never read."""
    files = scan_files(spark, root).select(
        F.substring_index("relative_path", "/", -1).alias("name"),
        F.col("relative_path").alias("path"),
        F.lower(F.regexp_extract("relative_path", r"\.([^./]+)$", 1)).alias("ext"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("updated_at"),
    )
    found = files.where(F.col("ext").isin(*extensions))
    word = keyword.strip().lower()
    if word:
        found = found.where(F.contains(F.lower("path"), F.lit(word)))
    return found.orderBy(F.col("updated_at").desc(), "path")


def unprocessed(files: DataFrame, manifest: DataFrame, keys: list[str] | None = None, force: bool = False) -> DataFrame:
    """Files whose result is not in the manifest of finished work (same path and time), or all when forced."""
    return files if force else files.join(manifest.select(*(keys or ["path", "modificationTime"])), keys or ["path", "modificationTime"], "left_anti")


def unextracted(files: DataFrame, folders: DataFrame) -> DataFrame:
    """Files without a filled result folder beside them whose name starts with the file's stem.

    ``files`` is ``parent, stem``; ``folders`` is ``parent, name``. Equal names are matched
    by key; only the rest is matched by prefix, inside its own parent folder.
    """
    rest = files.join(folders.select("parent", F.col("name").alias("stem")).distinct(), ["parent", "stem"], "left_anti")
    # All prefixes of a folder name turn the prefix test into an equality.
    prefixes = folders.select("parent", F.explode(F.transform(F.sequence(F.lit(1), F.length("name")), lambda n: F.left("name", n))).alias("stem"))
    return rest.join(prefixes.distinct(), ["parent", "stem"], "left_anti")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, quoted fields over several lines, and a byte order mark if there is one."""
    rows = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    return rows.withColumnsRenamed({c: c.removeprefix(BOM) for c in rows.columns if c.startswith(BOM)})


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with header; the first column name carries the byte order mark in every part file."""
    first = rows.columns[0]
    rows.withColumnRenamed(first, BOM + first).write.mode("errorifexists").csv(path, header=True, quote='"', escape='"')


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Chunk files by category; the folder as a whole is the combined index."""
    chunks.write.mode("append").partitionBy("category").parquet(path)


def write_metadata(chunks: DataFrame, path: str) -> None:
    chunks.drop("content").write.mode("errorifexists").parquet(path)


def write_summary(summary: DataFrame, path: str) -> None:
    """A one-row summary as one JSON file."""
    summary.coalesce(1).write.mode("errorifexists").json(path)
