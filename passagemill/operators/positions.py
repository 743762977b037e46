"""Places of rows in one global order, without a task that sees them all.

Rows are dealt to ranges of the order by quantiles that Spark samples, so a range holds about
the same number of rows wherever the values lie. The sums of the ranges, one small row each,
tell what stands before a range; inside it a window does the rest. The dealt rows are stored
once: sampling anew for a second pass could cut elsewhere.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagemill.session import stored

#: A slice that ends by this place is taken by Spark's own top rows, which hold as many rows per task.
TOP_ROWS = 10_000


def dealt_by_range(df: DataFrame, order: Sequence[str | Column], ranges: int | None = None) -> DataFrame:
    """The rows with their range in ``_range``, which rises with the order. Rows equal in the order share a range."""
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "ranges")


def running_totals(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, out: str, ranges: int | None = None) -> DataFrame:
    """``out``: the sum of ``value`` over the rows of the same keys up to and with each row, by ``order``.

    ``order`` must tell the rows of a key apart, else equal rows stand in any order.
    """
    rows = dealt_by_range(df.withColumn("_value", value), [*keys, *order], ranges)
    here = Window.partitionBy("_range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each range and key: a window over them is over as many rows as there are ranges.
    totals = rows.groupBy("_range", *keys).agg(F.sum("_value").alias("_total"))
    totals = totals.withColumn("_before", F.coalesce(F.sum("_total").over(earlier), F.lit(0))).drop("_total")
    summed = rows.withColumn(out, F.sum("_value").over(here))
    both = _by_keys(summed, totals, ["_range", *keys])
    return both.withColumn(out, F.col(out) + F.col("_before")).drop("_range", "_value", "_before")


def _by_keys(rows: DataFrame, few: DataFrame, keys: Sequence[str]) -> DataFrame:
    """An inner join in which null keys meet."""
    named = few.select(*[F.col(k).alias(f"_of{k}") for k in keys], *[c for c in few.columns if c not in keys])
    same = [rows[k].eqNullSafe(named[f"_of{k}"]) for k in keys]
    return rows.join(named, same).drop(*[f"_of{k}" for k in keys])


def between(df: DataFrame, order: Sequence[Column], start: int = 0, most: int = 0) -> DataFrame:
    """Rows from place ``start`` (0 is the first), at most ``most`` of them (0 = all), in order.

    Only the ranges that hold such places are ranked; the others are told by their counts.
    """
    start = max(start, 0)
    if most > 0 and start + most <= TOP_ROWS:
        return df.orderBy(*order).offset(start).limit(most)
    if not start and most <= 0:
        return df.orderBy(*order)
    rows = dealt_by_range(df, order)
    counts = rows.groupBy("_range").agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    counts = counts.where(F.col("_before") + F.col("_n") > start)
    if most > 0:
        counts = counts.where(F.col("_before") < start + most)
    kept = rows.join(F.broadcast(counts), "_range")
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    kept = kept.withColumn("_place", place).where(F.col("_place") >= start)
    if most > 0:
        kept = kept.where(F.col("_place") < start + most)
    return kept.orderBy("_place").select(*df.columns)
