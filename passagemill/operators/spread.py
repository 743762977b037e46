"""Ordered work inside groups that may be very large.

A plain window puts a whole group into one task. The functions here cut each
group into consecutive blocks, work inside (group, block), and carry one summary
row per block across the group, so a group holding a third of all rows is still
processed by many tasks. ``block`` must not decrease along the order, and should
keep a block at some thousand rows, e.g. ``floor(position / 4096)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 4096


def block_of(position: Column, rows: int = BLOCK_ROWS) -> Column:
    return F.floor(position / rows).cast("bigint")


def computed_once(df: DataFrame, **cols: Column) -> DataFrame:
    """Add columns that later steps use many times, behind a step the optimizer does not merge.

    Without it an expensive expression is copied into every use of its column.
    """
    made = F.struct(*[c.alias(n) for n, c in cols.items()])
    return df.select("*", F.inline(F.array(made)))


def unnest(df: DataFrame, keep: Sequence[str | Column], array: Column, value: str, pos: str | None = None) -> DataFrame:
    """One row per array element, with its position from 0 as ``pos`` if asked for.

    A plain explode makes the optimizer test the array for emptiness as early as it
    can, which computes it twice and, below a shuffle, in fewer tasks.
    """
    rows = df.select(*keep, F.posexplode_outer(array).alias("_pos", value)).where(F.col("_pos").isNotNull())
    return rows.withColumn(pos, F.col("_pos").cast("bigint")).drop("_pos") if pos else rows.drop("_pos")


def _joined(df: DataFrame, summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(summary, [*keys, "_block"], "left")


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, out: str, block: Column) -> DataFrame:
    """Inclusive running sum of ``value`` along ``order`` within ``keys``."""
    rows = df.withColumn("_block", block).withColumn("_value", value)
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*keys, "_block").agg(F.sum("_value").alias("_sum"))
    sums = sums.select(*keys, "_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inner = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = rows.withColumn("_local", F.sum("_value").over(inner))
    return _joined(local, sums, keys).withColumn(out, F.col("_local") + F.col("_before")).drop(
        "_block", "_value", "_local", "_before"
    )


def next_value(df: DataFrame, keys: Sequence[str], order: Sequence[str], col: str, out: str, block: Column) -> DataFrame:
    """Value of ``col`` in the following row of the group; null in the last row."""
    rows = df.withColumn("_block", block)
    heads = rows.groupBy(*keys, "_block").agg(F.min_by(F.struct(col), F.struct(*order)).alias("_head"))
    following = Window.partitionBy(*keys).orderBy("_block")
    heads = heads.select(*keys, "_block", F.lead("_head").over(following).alias("_next_head"))
    inner = Window.partitionBy(*keys, "_block").orderBy(*order)
    local = rows.withColumn("_next", F.lead(F.struct(col)).over(inner))
    return _joined(local, heads, keys).withColumn(out, F.coalesce("_next", "_next_head")[col]).drop(
        "_block", "_next", "_next_head"
    )


def carry_last(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str], block: Column) -> DataFrame:
    """Replace each of ``cols`` by its latest non-null value at or before the row."""
    rows = df.withColumn("_block", block)
    tails = rows.groupBy(*keys, "_block").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(f"_tail_{c}") for c in cols]
    )
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    tails = tails.select(*keys, "_block", *[F.last(f"_tail_{c}", True).over(before).alias(f"_tail_{c}") for c in cols])
    inner = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = rows.withColumns({c: F.last(c, True).over(inner) for c in cols})
    return _joined(local, tails, keys).withColumns({c: F.coalesce(c, f"_tail_{c}") for c in cols}).drop(
        "_block", *[f"_tail_{c}" for c in cols]
    )


def ordered_concat(df: DataFrame, keys: Sequence[str], order: Sequence[str], text: str, out: str, block: Column, sep: str = "") -> DataFrame:
    """Texts of a group joined in order: per block first, then the block strings."""

    def joined(pairs: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(pairs), lambda p: p["t"]), sep)

    blocks = (
        df.withColumn("_block", block)
        .groupBy(*keys, "_block")
        .agg(joined(F.collect_list(F.struct(*order, F.col(text).alias("t")))).alias("t"))
    )
    return blocks.groupBy(*keys).agg(joined(F.collect_list(F.struct("_block", "t"))).alias(out))


def dense_ids(df: DataFrame, key: str, position: str, out: str, block_rows: int = BLOCK_ROWS, buckets: int = 4096) -> DataFrame:
    """Consecutive ids from 0 over the whole table, ordered by (sha1(key), key, position).

    The count per (key, block) is summed along each of ``buckets`` hash ranges of
    the key, and the bucket totals (at most ``buckets`` rows) along the table, so no
    window holds more than one block of rows or one bucket of block counts.
    """
    rows = df.withColumn("_hash", F.sha1(F.encode(F.col(key), "UTF-8"))).withColumn("_block", block_of(F.col(position), block_rows))
    digits = max(1, (buckets - 1).bit_length() // 4)
    rows = rows.withColumn("_bucket", F.left("_hash", F.lit(digits)))
    counts = rows.groupBy("_bucket", "_hash", key, "_block").agg(F.count("*").alias("_n"))
    in_bucket = Window.partitionBy("_bucket").orderBy("_hash", key, "_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(in_bucket), F.lit(0)))
    totals = counts.groupBy("_bucket").agg(F.sum("_n").alias("_n"))
    over_buckets = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_bucket", F.coalesce(F.sum("_n").over(over_buckets), F.lit(0)).alias("_offset"))
    inner = Window.partitionBy("_bucket", "_hash", key, "_block").orderBy(position)
    numbered = rows.withColumn("_rn", F.row_number().over(inner).cast("bigint"))
    return (
        numbered.join(starts.drop("_n"), ["_bucket", "_hash", key, "_block"])
        .join(F.broadcast(offsets), "_bucket")  # at most `buckets` rows
        .withColumn(out, F.col("_offset") + F.col("_start") + F.col("_rn") - 1)
        .drop("_bucket", "_hash", "_block", "_start", "_offset", "_rn")
    )


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of every group. ``min_by`` combines before the shuffle, so hot keys cost nothing extra."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


QUANTILE_RULES = ("floor", "half_even", "linear")


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: dict[str, float],
    rule: str = "linear",
    accuracy: int = 10000,
) -> DataFrame:
    """Exact quantiles per group under one of three rank rules, without sorting a group in one task.

    ``floor`` and ``half_even`` pick the element at that rounding of ``(n-1)*q``;
    ``linear`` interpolates between the neighbours. An approximate percentile gives
    a narrow band around each wanted rank; rows below the band are only counted and
    the rows of the band, grouped by value, are ranked.
    """
    if rule not in QUANTILE_RULES:
        raise ValueError(f"unknown quantile rule: {rule}")
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_x"))
    slack = 4.0 / accuracy
    edges = [p for q in probs.values() for p in (max(0.0, q - slack), min(1.0, q + slack))]
    bands = rows.groupBy(*keys).agg(
        F.count("*").alias("_n"),
        F.min("_x").alias("_low"),
        F.max("_x").alias("_high"),
        F.percentile_approx("_x", edges, accuracy).alias("_edges"),
    )
    few = F.col("_n") <= 5 * accuracy  # then the band is the whole (bounded) group; beyond, it spans 20 ranks and more
    wanted = []
    for i, (name, q) in enumerate(probs.items()):
        pos = (F.col("_n") - 1) * F.lit(q)
        low = F.bround(pos) if rule == "half_even" else F.floor(pos)
        wanted.append(
            F.struct(
                F.lit(name).alias("name"),
                low.cast("bigint").alias("lo"),
                (F.ceil(pos) if rule == "linear" else low).cast("bigint").alias("hi"),
                (pos - F.floor(pos)).alias("frac"),
                F.when(few | F.lit(q - slack <= 0), F.col("_low")).otherwise(F.col("_edges")[2 * i]).alias("from"),
                F.when(few | F.lit(q + slack >= 1), F.col("_high")).otherwise(F.col("_edges")[2 * i + 1]).alias("to"),
            )
        )
    bands = bands.select(*keys, F.array(*wanted).alias("_wanted"))
    joined = rows.join(bands, list(keys)) if keys else rows.withColumn("_wanted", bands.select("_wanted").scalar())
    # Each row serves a wanted rank either as one more row below its band or as a member of it.
    served = joined.select(*keys, "_x", F.explode("_wanted").alias("_w"))
    served = served.where(F.col("_x") <= F.col("_w.to"))
    spot = F.when(F.col("_x") >= F.col("_w.from"), F.col("_x"))
    counts = served.groupBy(*keys, "_w", spot.alias("_v")).agg(F.count("*").alias("_c"))
    upto = Window.partitionBy(*keys, "_w").orderBy(F.col("_v").asc_nulls_first()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    ranked = counts.withColumn("_end", F.sum("_c").over(upto)).where(F.col("_v").isNotNull())
    first, last = F.col("_end") - F.col("_c"), F.col("_end") - 1

    def at(rank: str) -> Column:
        return F.min(F.when((first <= F.col(rank)) & (F.col(rank) <= last), F.col("_v")))

    picked = ranked.groupBy(*keys, "_w").agg(at("_w.lo").alias("_a"), at("_w.hi").alias("_b"))
    blend = F.col("_a") * (1 - F.col("_w.frac")) + F.col("_b") * F.col("_w.frac")
    result = F.when(F.col("_w.lo") == F.col("_w.hi"), F.col("_a")).otherwise(blend)
    named = picked.select(*keys, F.col("_w.name").alias("_name"), result.alias("_q"))
    wide = [F.max(F.when(F.col("_name") == name, F.col("_q"))).alias(name) for name in probs]
    return named.groupBy(*keys).agg(*wide) if keys else named.agg(*wide)
