"""Python functions of one value as Arrow functions of a column."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS = 256  # rows that a task holds as Python objects at a time


def rowwise(spark_type: T.DataType, made: pa.DataType) -> Callable[[Callable], Callable[..., Column]]:
    """Decorator: a function of one row's values as a column function; ``made`` is ``spark_type`` in Arrow's terms.

    Spark hands a task thousands of rows at once. Only ``ROWS`` of them are Python objects at any time,
    the others stay in Arrow's form, and results leave the task as they are made.
    """

    def wrap(use: Callable) -> Callable[..., Column]:
        def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
            for columns in batches:
                columns = (columns,) if isinstance(columns, pa.Array) else columns
                for at in range(0, len(columns[0]), ROWS):
                    yield pa.array([use(*row) for row in zip(*(c.slice(at, ROWS).to_pylist() for c in columns))], made)

        # Spark reads the kind of function from these.
        run.__annotations__ = {"batches": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
        return F.arrow_udf(run, spark_type)

    return wrap
