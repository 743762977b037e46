"""Versioned Parquet snapshots of one table, and a manifest of finished inputs.

A snapshot is written to its own folder first and becomes current when a row for
it is appended to the commit log, so a job lost half way leaves the old snapshot
in place, and the snapshot before it serves as the backup.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

LOG_SCHEMA = "version bigint, folder string, key string, rows bigint"


class SnapshotStore:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def log(self) -> DataFrame:
        try:
            return self.spark.read.schema(LOG_SCHEMA).json(f"{self.root}/log")
        except AnalysisException:
            return self.spark.createDataFrame([], LOG_SCHEMA)

    def current(self) -> tuple[int, str] | None:
        """Version and folder of the newest committed snapshot."""
        top = self.log().orderBy(F.col("version").desc()).limit(1).collect()
        return (top[0]["version"], top[0]["folder"]) if top else None

    def read(self, version: int | None = None) -> DataFrame:
        if version is None:
            now = self.current()
            if now is None:
                raise FileNotFoundError(f"no committed snapshot under {self.root}")
            return self.spark.read.parquet(f"{self.root}/{now[1]}")
        row = self.log().where(F.col("version") == version).limit(1).collect()
        if not row:
            raise FileNotFoundError(f"no snapshot {version} under {self.root}")
        return self.spark.read.parquet(f"{self.root}/{row[0]['folder']}")

    def commit(self, table: DataFrame, key: str | None = None, partition_by: list[str] | None = None) -> int:
        """Write ``table`` as the next version. A ``key`` already committed is not written again."""
        if key is not None:
            done = self.log().where(F.col("key") == key).limit(1).collect()
            if done:
                return done[0]["version"]
        now = self.current()
        version = (now[0] if now else 0) + 1
        folder = f"version={version}-{uuid.uuid4().hex[:8]}"
        table.write.mode("errorifexists").partitionBy(*(partition_by or [])).parquet(f"{self.root}/{folder}")
        rows = self.spark.read.parquet(f"{self.root}/{folder}").count()
        entry = self.spark.createDataFrame([(version, folder, key, rows)], LOG_SCHEMA)
        entry.coalesce(1).write.mode("append").json(f"{self.root}/log")
        return version
