"""Session defaults and the few settings the library reads back from a session."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Keeps the state of streams on disk and takes list and timed state, which the answer stream needs.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(master: str | None = None, app: str = "passagemill", **conf: str) -> SparkSession:
    """A session with the settings the library is tuned for.

    On a cluster leave ``master`` unset (spark-submit supplies it) and keep the
    cluster's own shuffle sizing; adaptive execution then coalesces and splits.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": STATE_STORE,
        "spark.ui.enabled": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_folder(spark: SparkSession) -> str:
    """Shared folder for stored intermediate tables: the cluster's own setting, or a fresh one in local mode.

    On a cluster a folder of the driver's machine would leave every executor with its own part,
    so there the setting must be made.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = current.get() if current.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="passagemill-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read from there, so that no use computes it again."""
    path = f"{checkpoint_folder(df.sparkSession)}/passagemill/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Tables of long texts, where the work per row is worth far more than moving the row once.
TEXT_TABLES = ("documents", "pages", "conversations")


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the folder; texts in fewer splits than there are cores are dealt out to all of them.

    A table of cluster size has more splits than cores and is read where it lies.
    """
    table = spark.read.parquet(os.path.join(folder, f"{name}.parquet"))
    cores = spark.sparkContext.defaultParallelism
    if name in TEXT_TABLES and table.rdd.getNumPartitions() < cores:
        return table.repartition(cores)
    return table
