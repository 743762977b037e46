"""From files to a searchable index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill.functions.keys import path_fields
from passagemill.functions.text import heading_prefixed
from passagemill.operators import catalogue, index
from passagemill.operators.chunkers import chunk_markdown, chunk_plain
from passagemill.operators.encode import Encoder, encode, hashing_encoder
from passagemill.sources.files import read_texts


def chunk_files(spark: SparkSession, root: str, max_chars: int = 768, overlap: int = 120) -> DataFrame:
    """Chunks of all Markdown and text files under ``root`` with title, source and category from the path."""
    parts = [
        chunk(read_texts(spark, root, pattern), "relative_path", "text", max_chars, overlap)
        for chunk, pattern in ((chunk_markdown, "*.md"), (chunk_plain, "*.txt"))
    ]
    rows = parts[0].unionByName(parts[1])
    fields = [c.alias(n) for n, c in path_fields(F.col("relative_path")).items()]
    return rows.select("chunk_id", *fields, "headings", "content")


def index_of(chunks: DataFrame, encoder: Callable[[], Encoder] = hashing_encoder) -> DataFrame:
    """Numbered chunks with the vector of their passage text."""
    numbered = index.assign_ids(chunks)
    passages = numbered.withColumn("_passage", heading_prefixed(F.col("headings"), F.col("content")))
    return encode(passages, numbered.columns, "_passage", encoder)


def refreshed_catalogue(old: DataFrame, indexed: DataFrame) -> DataFrame:
    return catalogue.refresh(old, catalogue.documents_of(indexed), F.current_timestamp())
