"""An index kept current from a stream of document changes.

Each micro-batch adds one small folder of new chunks and one of replaced sources;
the table itself is never rewritten by a batch. Readers drop chunks whose source was
replaced later, and ``compact`` folds everything into one snapshot now and then.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.utils import AnalysisException

from passagemill.functions.text import norm
from passagemill.operators.encode import Encoder, hashing_encoder
from passagemill.operators.index import append_documents

CHUNK_COLUMNS = "source string, headings string, category string, version string, chunk_id bigint, content string, vec_id bigint, embedding array<float>"
LOG_COLUMNS = "version bigint, key string, last_id bigint, base boolean"


class ChangingIndex:
    """Chunks with vectors under ``root``, changed batch by batch. One writer at a time."""

    def __init__(self, spark: SparkSession, root: str, encoder: Callable[[], Encoder] = hashing_encoder) -> None:
        self.spark, self.root, self.encoder = spark, root.rstrip("/"), encoder

    def log(self) -> DataFrame:
        try:
            return self.spark.read.schema(LOG_COLUMNS).json(f"{self.root}/log")
        except AnalysisException:
            return self.spark.createDataFrame([], LOG_COLUMNS)

    def _tables(self) -> tuple[DataFrame, DataFrame]:
        """Committed chunk and replacement rows since the last compaction."""
        log = self.log()
        versions = sorted(r["version"] for r in log.select("version").collect())
        bases = [r["version"] for r in log.where("base").collect()]
        live = [v for v in versions if v >= max(bases, default=0)]
        return self._part("added", f"{CHUNK_COLUMNS}, since bigint", live), self._part("replaced", "source string, since bigint", live)

    def _part(self, name: str, schema: str, versions: list[int]) -> DataFrame:
        paths = [f"{self.root}/{name}/v{v}" for v in versions]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        added, replaced = self._tables()
        newest = replaced.groupBy("source").agg(F.max("since").alias("_until"))
        current = added.join(newest, "source", "left")
        return current.where(F.col("_until").isNull() | (F.col("since") >= F.col("_until"))).drop("_until", "since")

    def _commit(self, version: int, key: str, added: DataFrame, replaced: DataFrame, base: bool = False) -> None:
        # Overwriting is safe: a folder counts only once its version is in the log.
        added.withColumn("since", F.lit(version).cast("bigint")).write.mode("overwrite").parquet(f"{self.root}/added/v{version}")
        replaced.withColumn("since", F.lit(version).cast("bigint")).write.mode("overwrite").parquet(f"{self.root}/replaced/v{version}")
        top = self._part("added", f"{CHUNK_COLUMNS}, since bigint", [version]).agg(F.max("vec_id").alias("m")).collect()[0]["m"]
        last = self.log().agg(F.max("last_id").alias("m")).collect()[0]["m"]
        known = [x for x in (top, last) if x is not None]
        row = self.spark.createDataFrame([(version, key, max(known, default=-1), base)], LOG_COLUMNS)
        row.coalesce(1).write.mode("append").json(f"{self.root}/log")

    def apply(self, changes: DataFrame, key: str) -> bool:
        """Apply ``seq, op (upsert|delete), source, headings, category, version, text``; False when ``key`` was applied before.

        The last change of a source within the batch counts.
        """
        log = self.log()
        if log.where(F.col("key") == key).limit(1).count():
            return False
        last = log.agg(F.max("version").alias("v"), F.max("last_id").alias("i")).collect()[0]
        rest = [c for c in changes.columns if c != "source"]
        keyed = changes.withColumn("source", norm(F.col("source")))
        latest = keyed.groupBy("source").agg(F.max_by(F.struct(*rest), "seq").alias("_c")).select("source", "_c.*")
        start = self.spark.createDataFrame([(last["i"],)], "vec_id bigint")  # new ids follow the largest ever given
        new = append_documents(start, latest.where(F.col("op") == "upsert"), encoder=self.encoder).where(F.col("source").isNotNull())
        names = [c.split()[0] for c in CHUNK_COLUMNS.split(", ")]
        self._commit((last["v"] or 0) + 1, key, new.select(*names), latest.select("source"))
        return True

    def compact(self) -> int:
        version = (self.log().agg(F.max("version").alias("v")).collect()[0]["v"] or 0) + 1
        self._commit(version, f"compact-{version}", self.read(), self.spark.createDataFrame([], "source string"), base=True)
        return version


def follow(changes: DataFrame, index: ChangingIndex, checkpoint: str, **trigger) -> StreamingQuery:
    """Run the stream of changes into the index; a batch replayed after a failure is applied once.

    A batch is known by the id that its stream's checkpoint gives it and its number, so streams
    that start anew, or run beside each other, do not take each other's batches for replays.
    """

    def batch(rows: DataFrame, number: int) -> None:
        stream = rows.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or checkpoint
        index.apply(rows, f"{stream}-{number}")

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
