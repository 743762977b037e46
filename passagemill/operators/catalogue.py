"""The document catalogue and the index status, as functions from old state to new state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.functions.keys import ingest_key, source_or_default, title_or_default
from passagemill.functions.predicates import catalogue_match
from passagemill.functions.text import norm
from passagemill.operators.positions import between
from passagemill.operators.spread import dense_ids

# Where a catalogue row comes from, and the states of the index.
FROM_INDEX, FROM_UPLOAD, FROM_HAND = "faiss_sync", "text_upload", "manual"
STATES = ("dirty", "running", "synced", "error")

FIELDS = ("title", "category", "source", "version", "tags", "updated_by", "ingest_source")
COLUMNS = ("id", *FIELDS, "ingest_key", "created_at", "updated_at", "is_deleted")


def documents_of(chunks: DataFrame, order: str = "vec_id") -> DataFrame:
    """One row per source: title and category of its first chunk, all its categories as sorted tags."""
    rows = chunks.select(
        ingest_key(F.col("source")).alias("ingest_key"),
        F.struct(
            title_or_default(F.col("title")).alias("title"),
            F.nullif(norm(F.col("category")), F.lit("")).alias("category"),
            source_or_default(F.col("source")).alias("source"),
        ).alias("first"),
        F.nullif(norm(F.col("category")), F.lit("")).alias("tag"),
        F.col(order).alias("_order"),
    )
    grouped = rows.groupBy("ingest_key").agg(
        F.min_by("first", "_order").alias("first"), F.array_sort(F.collect_set("tag")).alias("tags")
    )
    return grouped.select("ingest_key", "first.*", F.lit(None).cast("string").alias("version"), "tags")


def upsert(
    catalogue: DataFrame, incoming: DataFrame, ingest_source: str, now: Column, updated_by: Column | None = None, last_id: Column | None = None
) -> DataFrame:
    """Merge rows by ``ingest_key``: the incoming row wins and revives a deleted one, new rows get new ids.

    New ids follow ``last_id``, the largest ever given; without it, the largest in the catalogue.

    ``incoming`` has one row per key and the catalogue fields it sets.
    """
    by = updated_by if updated_by is not None else F.lit(None)
    fresh = incoming.withColumns({"ingest_source": F.lit(ingest_source), "updated_by": by.cast("bigint")})
    if "updated_by" not in incoming.columns and updated_by is None:
        kept_by = F.col("old.updated_by")  # an index sync does not touch who edited a row
    else:
        kept_by = F.col("new.updated_by")
    joined = catalogue.alias("old").join(
        fresh.withColumn("_new", F.lit(True)).alias("new"), F.col("old.ingest_key") == F.col("new.ingest_key"), "full_outer"
    )
    is_new = F.col("new._new").isNotNull()
    values = {f: F.when(is_new, F.col(f"new.{f}")).otherwise(F.col(f"old.{f}")) for f in FIELDS if f != "updated_by"}
    merged = joined.select(
        F.col("old.id").alias("id"),
        *[c.alias(f) for f, c in values.items()],
        F.when(is_new, kept_by).otherwise(F.col("old.updated_by")).alias("updated_by"),
        F.coalesce(F.col("new.ingest_key"), F.col("old.ingest_key")).alias("ingest_key"),
        F.coalesce(F.col("old.created_at"), now).alias("created_at"),
        F.when(is_new, now).otherwise(F.col("old.updated_at")).alias("updated_at"),
        F.when(is_new, F.lit(False)).otherwise(F.col("old.is_deleted")).alias("is_deleted"),
    )
    last = F.coalesce(last_id if last_id is not None else catalogue.agg(F.max("id")).scalar(), F.lit(0))
    added = dense_ids(
        fresh.join(catalogue.select("ingest_key"), "ingest_key", "left_anti").select("ingest_key", F.lit(0).cast("bigint").alias("_p")),
        "ingest_key", "_p", "_n",
    )
    numbered = merged.join(added.select("ingest_key", "_n"), "ingest_key", "left")
    return numbered.withColumn("id", F.coalesce("id", last + 1 + F.col("_n"))).select(*COLUMNS)


def refresh(catalogue: DataFrame, documents: DataFrame, now: Column) -> DataFrame:
    """Full refresh from the index: earlier index rows go, rows entered otherwise stay, then upsert.

    The ids of removed rows are not given again.
    """
    kept = catalogue.where(F.col("ingest_source") != FROM_INDEX)
    return upsert(kept, documents, FROM_INDEX, now, last_id=catalogue.agg(F.max("id")).scalar())


def patch(rows: DataFrame, changes: DataFrame, key: str, fields: list[str], live: Column | None = None) -> DataFrame:
    """Set the fields a change gives; a null in the change keeps the old value. One change per key."""
    c = changes.select(F.col(key).alias("_key"), F.lit(True).alias("_hit"), *[F.col(f).alias(f"_new_{f}") for f in fields])
    joined = rows.join(c, rows[key] == F.col("_key"), "left")
    hit = F.col("_hit").isNotNull() & (live if live is not None else F.lit(True))
    return joined.withColumns({f: F.when(hit, F.coalesce(f"_new_{f}", f)).otherwise(F.col(f)) for f in fields}).select(*rows.columns)


def soft_delete(rows: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    """Mark the listed rows as deleted; nothing is removed."""
    marks = gone.select(F.col(key).alias("_key")).distinct().withColumn("_gone", F.lit(True))
    joined = rows.join(marks, rows[key] == F.col("_key"), "left")
    return joined.withColumn("is_deleted", F.col("is_deleted") | F.col("_gone").isNotNull()).select(*rows.columns)


def status_after(event: Column, failed: Column) -> Column:
    """State the index enters on an event: edits make it dirty, jobs run and end synced or in error."""
    return (
        F.when(event == "start", F.lit("running"))
        .when((event == "finish") & failed, F.lit("error"))
        .when(event == "finish", F.lit("synced"))
        .otherwise(F.lit("dirty"))
    )


def current_status(log: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Latest state, error and successful sync from an append-only log ``ts, seq, status, error``."""
    at = F.struct("ts", "seq")
    done = F.col("status") == "synced"
    out = log.groupBy(*(keys or [])).agg(
        F.max_by("status", at).alias("status"),
        F.max_by(F.struct("error"), at).alias("_e"),
        F.max(F.when(done, F.col("ts"))).alias("last_reindexed_at"),
        F.max("ts").alias("updated_at"),
    )
    return out.select(*(keys or []), "status", F.col("_e.error").alias("last_error"), "last_reindexed_at", "updated_at")


def page(catalogue: DataFrame, keyword: str = "", number: int = 1, size: int = 10) -> DataFrame:
    """One page of the live catalogue, newest first, with the total number of matches on every row."""
    number, size = max(number, 1), min(max(size, 1), 50)
    hits = catalogue.where(catalogue_match(keyword))
    total = hits.agg(F.count("*")).scalar()
    rows = between(hits, [F.col("updated_at").desc(), F.col("id").desc()], (number - 1) * size, size)
    return rows.withColumn("total", total)
