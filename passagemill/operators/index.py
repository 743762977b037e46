"""The chunk-and-vector table: ids, snapshots of it, appends and deletes.

Every operation is a pure function from the old table to the new one; the
snapshot store in ``passagemill.sources.snapshots`` makes the result current.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.functions.predicates import require
from passagemill.functions.text import heading_prefixed, norm
from passagemill.operators.encode import Encoder, encode, hashing_encoder
from passagemill.operators.spread import dense_ids, unnest
from passagemill.operators.windows import append_pieces


def assign_ids(chunks: DataFrame, source: str = "source", chunk_id: str = "chunk_id", explicit: str | None = None) -> DataFrame:
    """Add ``vec_id``: the explicit id where given, else the row's position in the whole table.

    ``chunk_id`` restarts in every document and never serves as an id by itself.
    """
    numbered = dense_ids(chunks, source, chunk_id, "_position")
    if explicit is None:
        return numbered.withColumnRenamed("_position", "vec_id")
    given = F.col(explicit).cast("string")
    ok = given.isNull() | F.regexp_like(given, F.lit(r"^\d+$"))
    checked = require(numbered, ok, "vector ids must be integers of at least 0")
    return checked.withColumn("vec_id", F.coalesce(given.cast("bigint"), F.col("_position"))).drop("_position")


def duplicate_ids(chunks: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """Ids used more than once, with their count; empty for a valid index."""
    return chunks.groupBy(id_col).agg(F.count("*").alias("uses")).where(F.col("uses") > 1)


def alignment_report(chunks: DataFrame, vectors: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """One row: rows on each side, rows without a partner, and whether the two sides fit together."""
    left = chunks.select(id_col, F.lit(True).alias("_chunk"))
    right = vectors.select(id_col, F.lit(True).alias("_vector"))
    both = left.join(right, id_col, "full_outer")
    counts = both.agg(
        F.count("_chunk").alias("chunks"),
        F.count("_vector").alias("vectors"),
        F.count_if(F.col("_vector").isNull()).alias("chunks_without_vector"),
        F.count_if(F.col("_chunk").isNull()).alias("vectors_without_chunk"),
    )
    return counts.withColumn("aligned", (F.col("chunks_without_vector") == 0) & (F.col("vectors_without_chunk") == 0))


def build_index(chunks: DataFrame, vectors: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """Chunks with their vectors, one to one.

    The job fails on vectors of different lengths, on an id that either side has twice or
    not at all, and on a chunk or vector without its partner.
    """
    widest = vectors.agg(F.max(F.size("embedding"))).scalar()
    same = require(vectors.select(id_col, "embedding"), F.size("embedding") == widest, "embedding dimension mismatch")
    # One row per id and side, carrying the first partner; the count tells whether there were more.
    one = same.groupBy(id_col).agg(F.first("embedding").alias("embedding"), F.count("*").alias("_vectors"))
    rest = [c for c in chunks.columns if c != id_col]
    held = chunks.groupBy(id_col).agg(F.first(F.struct(*rest)).alias("_chunk"), F.count("*").alias("_chunks"))
    both = held.join(one, F.equal_null(held[id_col], one[id_col]), "full_outer").select(
        F.coalesce(held[id_col], one[id_col]).alias(id_col), "_chunk", "embedding", "_chunks", "_vectors"
    )
    both = require(both, F.col("_chunks").isNotNull() & F.col("_vectors").isNotNull() & F.col(id_col).isNotNull(), "chunks and vectors are not aligned")
    both = require(both, (F.col("_chunks") == 1) & (F.col("_vectors") == 1), "duplicate vector ids")
    return both.select(id_col, *[F.col("_chunk")[c].alias(c) for c in rest], "embedding").select(*chunks.columns, "embedding")


def append_documents(
    index: DataFrame,
    documents: DataFrame,
    max_chars: int = 1000,
    overlap: int = 120,
    encoder: Callable[[], Encoder] = hashing_encoder,
) -> DataFrame:
    """The index with new documents cut, encoded and numbered after its largest id.

    ``documents`` is ``source, headings, category, version, text``, one row per source.
    """
    fields = [
        norm(F.col("source")).alias("source"),
        F.coalesce(F.nullif(norm(F.col("headings")), F.lit("")), norm(F.col("source"))).alias("headings"),
        norm(F.col("category")).alias("category"),
        norm(F.col("version")).alias("version"),
    ]
    pieces = unnest(documents, fields, append_pieces(F.col("text"), max_chars, overlap), "content", "chunk_id")
    numbered = dense_ids(pieces, "source", "chunk_id", "_n")
    last = F.coalesce(index.agg(F.max("vec_id")).scalar(), F.lit(-1))
    chunks = numbered.withColumn("vec_id", last + 1 + F.col("_n")).drop("_n")
    passages = chunks.withColumn("_passage", heading_prefixed(F.col("headings"), F.col("content")))
    encoded = encode(passages, chunks.columns, "_passage", encoder)
    return index.unionByName(encoded, allowMissingColumns=True)


def delete_sources(index: DataFrame, sources: DataFrame) -> DataFrame:
    """The index without the chunks of the listed sources (exact match after trimming); ids stay as they are."""
    gone = sources.select(norm(F.col("source")).alias("_source")).distinct()
    return index.join(gone, norm(index["source"]) == F.col("_source"), "left_anti")


def delete_report(index: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows before and after a delete, counted in one pass over the index."""
    gone = sources.select(norm(F.col("source")).alias("_source"), F.lit(True).alias("_gone")).distinct()
    marked = index.select(norm(F.col("source")).alias("_source")).join(gone, "_source", "left")
    return marked.agg(F.count("*").alias("before"), F.count_if(F.col("_gone").isNull()).alias("after"))


