"""Every operator as a query over the given tables, with the equivalent DuckDB SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Named queries of one area and their SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def add(fn: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"query registered twice: {name}")
            self.queries[name] = lambda spark, folder: plain_types(fn(spark, folder))
            if sql:
                self.sql[name] = sql
            return fn

        return add


def plain_types(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint and fractions as double, as the SQL side gives them."""

    def widened(field: T.StructField):
        if isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            return F.col(field.name).cast("bigint").alias(field.name)
        if isinstance(field.dataType, (T.FloatType, T.DecimalType)):
            return F.col(field.name).cast("double").alias(field.name)
        return F.col(field.name)

    return df.select(*[widened(f) for f in df.schema.fields])


def all_queries() -> dict[str, Query]:
    return {name: fn for area in _areas() for name, fn in area.queries.items()}


def all_sql() -> dict[str, str]:
    return {name: sql for area in _areas() for name, sql in area.sql.items()}


def _areas() -> list[Registry]:
    import importlib

    return [importlib.import_module(f"passagemill.registry.{name}").area for name in AREAS]


AREAS = ["texts", "retrieval", "corpus", "judging", "curation", "streams"]
