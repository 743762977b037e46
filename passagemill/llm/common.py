"""What the operators of this package share: stored intermediate tables and key hashes."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill.session import checkpoint_folder


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share."""
    return f"{checkpoint_folder(spark)}/passagemill-llm/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read from there.

    Cuts the lineage so that a lost executor costs a re-read, and keeps costly rows from
    being computed once for each use.
    """
    path = path or shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a stored table that a later one has replaced."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def hash_pair(*parts: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes; together they identify a key among 10^15 and more."""
    return F.xxhash64(*parts), F.xxhash64(F.lit(7), *parts)
