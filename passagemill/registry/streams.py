"""Streaming jobs and file readers over data written from the given tables."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagemill.functions.rowwise import rowwise
from passagemill.plans import inputs
from passagemill.registry import Registry, duck
from passagemill.registry.corpus import STATUS_LOG, _NO_BLANK, _scratch, _windows_sql, status_log
from passagemill.registry.curation import _roll
from passagemill.registry.judging import MESSAGES
from passagemill.session import STATE_STORE, read_table
from passagemill.sources import archives, files
from passagemill.streaming import answers, status, upkeep

area = Registry()


def _fed(spark, df, name, parts, start):
    """Write the parts of ``df`` one after the other, and after each run the stream that ``start`` makes over all that is there.

    Every run takes up from the checkpoint of the one before, as a job does that was stopped.
    """
    path = _scratch(spark, name)
    changed = {"spark.sql.streaming.noDataMicroBatches.enabled": "false", "spark.sql.streaming.stateStore.providerClass": STATE_STORE}
    before = {setting: spark.conf.get(setting) for setting in changed}
    try:
        # A job with timeouts asks for further empty batches for ever; a run here ends with the data.
        for setting, value in changed.items():
            spark.conf.set(setting, value)
        for part in parts:
            df.where(part).write.mode("append").parquet(path)
            start(spark.readStream.schema(df.schema).parquet(path)).awaitTermination()
    finally:
        for setting, value in before.items():
            spark.conf.set(setting, value)


def _drained(spark, df, name, parts, job, mode="append"):
    """The rows that the streaming ``job`` makes of the parts of ``df``."""
    out, state = _scratch(spark, f"{name}-out"), _scratch(spark, f"{name}-state")

    def start(stream):
        writer = job(stream).writeStream.outputMode(mode).option("checkpointLocation", state)
        return writer.foreachBatch(lambda rows, _: rows.write.mode("append").parquet(out)).trigger(availableNow=True).start()

    _fed(spark, df, name, parts, start)
    return spark.read.parquet(out)


@area.query(
    "w1_answer_stream",
    duck.with_(
        MESSAGES, f"r AS (SELECT id AS request, text, {_roll} AS roll FROM msgs WHERE role = 'assistant')",
        select="""SELECT request, CASE WHEN roll = 0 THEN 'error' ELSE 'done' END AS status,
          CASE WHEN roll = 0 THEN NULL WHEN roll > 9 THEN text || ' ' ELSE text END AS answer, CASE WHEN roll > 1 THEN length(text) END AS completion_tokens FROM r WHERE roll <> 1""",
    ),
)
def _w1(spark, folder):
    events = inputs.generation_events(spark, folder)
    return _drained(spark, events, "answers", [F.col("seq") < 5, F.col("seq") >= 5], answers.answer_stream)


@area.query(
    "w2_index_upkeep",
    duck.with_(
        """final AS (SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN 'v2 ' || text ELSE text END AS text FROM documents
          WHERE doc_id % 3 = 1 OR (doc_id % 3 = 2 AND doc_id % 2 = 0))""",
        *_windows_sql(_NO_BLANK, 1000, 880, table="final"),
        select="SELECT 'c/' || doc_id AS source, chunk_id, content FROM chunks",
    ),
)
def _w2(spark, folder):
    docs = read_table(spark, folder, "documents")

    def change(rows, seq, op, text):
        return rows.select(
            F.lit(seq).cast("bigint").alias("seq"), op.alias("op"), F.concat(F.lit("c/"), F.col("doc_id").cast("string")).alias("source"),
            F.lit("").alias("headings"), F.col("lang").alias("category"), F.lit("").alias("version"), text.alias("text"),
        )

    first = change(docs.where(F.col("doc_id") % 2 == 0), 1, F.lit("upsert"), F.col("text"))
    later = docs.where(F.col("doc_id") % 3 < 2)
    gone = F.when(F.col("doc_id") % 3 == 0, "delete").otherwise("upsert")
    second = change(later, 2, gone, F.concat(F.lit("v2 "), F.col("text")))
    stale = change(later, 1, F.lit("upsert"), F.lit("overtaken by the later change of its batch"))
    batch = F.when(F.col("text").startswith("overtaken") | (F.col("seq") == 2), 2).otherwise(1)
    changes = first.unionByName(second).unionByName(stale)
    index = upkeep.ChangingIndex(spark, _scratch(spark, "index"))
    state = _scratch(spark, "index-state")
    _fed(spark, changes, "changes", [batch == 1, batch == 2], lambda stream: upkeep.follow(stream, index, state))
    return index.read().select("source", "chunk_id", "content")


@area.query(
    "w3_status_stream",
    duck.with_(
        STATUS_LOG,
        "ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, seq DESC) AS rn FROM log)",
        select="""SELECT user_id, max(status) FILTER (WHERE rn = 1) AS status, max(CASE WHEN status = 'error' THEN 'failed at ' || seq END) FILTER (WHERE rn = 1) AS last_error,
          epoch_us(max(ts)) AS updated_at FROM ranked GROUP BY user_id""",
    ),
)
def _w3(spark, folder):
    log = status_log(read_table(spark, folder, "events"))
    middle = log.agg(F.timestamp_micros(F.avg(F.unix_micros(F.col("ts").cast("timestamp"))).cast("bigint"))).scalar()
    early = F.col("ts") < middle
    spans = _drained(spark, log, "log", [early, ~early], lambda stream: status.status_stream(stream, ["user_id"]), "update")
    latest = status.folded(spans, ["user_id"])
    return latest.select("user_id", "status", "last_error", F.unix_micros(F.col("updated_at").cast("timestamp")).alias("updated_at"))


# ---- files -------------------------------------------------------------------------------------


def _text_folder(spark, folder):
    """The documents as text files, one folder for each source; a document ends with a line break."""
    path = _scratch(spark, "texts")
    docs = read_table(spark, folder, "documents").where("text is not null")
    docs.select("source", "text").write.partitionBy("source").text(path)
    return path


_SIZES = "SELECT source, cast(sum(strlen(text) + 1) AS bigint) AS bytes{} FROM documents WHERE text IS NOT NULL GROUP BY source"


@area.query("s1_scan_files", _SIZES.format(""))
def _s1(spark, folder):
    found = files.scan_files(spark, _text_folder(spark, folder), "*.txt")
    source = F.regexp_extract("relative_path", "^source=([^/]+)/", 1)
    return found.groupBy(source.alias("source")).agg(F.sum(F.length("content")).alias("bytes"))


@area.query("s3_inventory", _SIZES.format(", 'txt' AS ext, true AS named"))
def _s3(spark, folder):
    found = files.inventory(spark, _text_folder(spark, folder), ("txt",), "SOURCE=")
    source = F.regexp_extract("path", "^source=([^/]+)/", 1)
    named = F.bool_and(F.endswith("path", F.col("name")) & ~F.contains("name", F.lit("/")))
    return found.groupBy(source.alias("source"), "ext").agg(F.sum("size").alias("bytes"), named.alias("named"))


_IN_GBK = r"[^\x00-\x7fáàéèêíìóòúùü]"


@rowwise(T.BinaryType(), pa.binary())
def _as_gbk(text: str | None) -> bytes | None:
    return None if text is None else text.encode("gbk")


@area.query(
    "s2_decoded_texts",
    f"SELECT doc_id, {duck.newlines('t')} AS text FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text ELSE regexp_replace(text, '{_IN_GBK}', '', 'g') END AS t FROM documents)",
)
def _s2(spark, folder):
    """UTF-8 bytes for even ids; GBK bytes, of the letters that GBK has, for odd ones."""
    docs = read_table(spark, folder, "documents")
    even = F.col("doc_id") % 2 == 0
    other = _as_gbk(F.when(~even, F.regexp_replace("text", _IN_GBK, "")))
    return files.decoded(docs.select("doc_id", F.when(even, F.encode("text", "UTF-8")).otherwise(other).alias("content")))


@rowwise(T.BinaryType(), pa.binary())
def _zipped(x: str, y: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("b/full.MD", x)
        z.writestr("a/skip.bin", "no")
        z.writestr("a/notes.txt", " " + y)
        z.writestr("layout.json", "{}")
        z.writestr("empty.txt", " ")
    return out.getvalue()


@area.query(
    "s13_archive_texts",
    f"SELECT doc_id || '.zip' AS archive, {duck.strip('text')} || chr(10) || chr(10) || source AS text FROM documents WHERE {duck.strip('text')} <> ''",
)
def _s13(spark, folder):
    docs = read_table(spark, folder, "documents")
    made = docs.select(F.concat(F.lit("in/"), F.col("doc_id").cast("string"), F.lit(".zip")).alias("path"), _zipped("text", "source").alias("content"))
    return archives.archive_texts(archives.archive_members(made)).drop("path")


@area.query("s10_unextracted", "SELECT doc_id AS id FROM documents WHERE doc_id % 3 = 0")
def _s10(spark, folder):
    """Result folders exist for two documents in three, half of them with a mark behind the stem."""
    docs = read_table(spark, folder, "documents").select("doc_id", F.col("source").alias("parent"), F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("stem"))
    mark = F.when(F.col("doc_id") % 2 == 0, F.lit("_out")).otherwise(F.lit(""))
    done = docs.where(F.col("doc_id") % 3 != 0).select("parent", F.concat("stem", mark).alias("name"))
    return files.unextracted(docs, done).select(F.col("doc_id").alias("id"))
