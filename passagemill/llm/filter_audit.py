"""How five text filters act on each other: what every order of them removes, step by step and part by part.

Each document becomes a mask of the filters it fails, and documents are counted in cells
``(part, mask)`` of at most 32 per part. A Gray-code walk then visits all 32 subsets of filters,
toggling one filter at a time: a cell holds the number of active filters it fails, and the
running survivors change only when that number leaves or reaches zero. The 32 stored states
give every step of every order as a difference of two of them.

A document fails the copies filter if a smaller id holds the same text. Copies are counted
per text, part and label first, so a text that a third of all rows share is a few rows when
its smallest id is looked up, and no row is compared with another.

Defined results: a null text is empty, and equal to an empty one; a row without id has no smaller id and
is none, so it never fails as a copy; rows that share id and text are not copies of each other; a
document is labelled if any row of its id in the labels says so, and rows without id are not labelled;
a null part is the empty string; a table without rows has no parts and gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
FEWEST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SIGNS = 200, 50, 3, "#$%&*|"
COUNTS = ("n", "good", "toxic")
#: Rows without id are dealt over this many join keys.
SALTS = 256

_CAPITALS, _SIGNS = bytes(range(65, 91)), SIGNS.encode()


def failures(data: bytes, code_points: int) -> int:
    """The mask of the filters A to D that a text fails; ``data`` is its UTF-8."""
    words = data.split()  # on ASCII white space
    failed = len(words) < FEWEST_WORDS
    failed |= (100 * len(set(words)) < LEAST_DISTINCT * len(words)) << 1
    failed |= (100 * (len(data) - len(data.translate(None, _CAPITALS))) > MOST_CAPITALS * code_points) << 2
    failed |= (len(data.translate(None, _SIGNS)) < len(data)) << 3
    return int(failed)


def _masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``id, part, text`` to ``id, part, mask, digest``."""
    for batch in batches:
        masks, digests = [], []
        for text in batch.column("text"):
            text = text.as_py()
            data = text.encode("utf-8", "surrogatepass")
            masks.append(failures(data, len(text)))
            digests.append(xxhash.xxh3_128_digest(data))
        made = [pa.array(masks, pa.int32()), pa.array(digests, pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("part"), *made], ["id", "part", "mask", "digest"])


def subset_states(cells: dict[int, tuple[int, ...]], filters: int = len(FILTERS)) -> list[tuple[int, ...]]:
    """Survivors of every subset of filters, by a Gray-code walk; ``cells`` maps a failure mask to its counts."""
    alive = [sum(column) for column in zip(*cells.values())]
    states: list = [None] * (1 << filters)
    active, subset = dict.fromkeys(cells, 0), 0
    states[0] = tuple(alive)
    for step in range(1, 1 << filters):
        toggled = step & -step
        subset ^= toggled
        for mask, counts in cells.items():
            if not mask & toggled:
                continue
            before = active[mask]
            active[mask] = after = before + (1 if subset & toggled else -1)
            if (before == 0) != (after == 0):
                sign = -1 if after else 1
                alive = [a + sign * c for a, c in zip(alive, counts)]
        states[subset] = tuple(alive)
    return states


def audited(cells: dict[int, tuple[int, ...]], filters: str = FILTERS) -> list[tuple]:
    """``(filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)`` of all orders."""
    states = subset_states(cells, len(filters))
    fails = {f: sum(c[0] for m, c in cells.items() if m >> i & 1) for i, f in enumerate(filters)}
    rows, shapley = [], dict.fromkeys(filters, 0)
    for order in permutations(filters):
        subset = 0
        for step, f in enumerate(order, 1):
            bit = 1 << filters.index(f)
            before, after = states[subset], states[subset | bit]
            removed, good, toxic = (b - a for b, a in zip(before, after))
            shapley[f] += removed
            rows.append(("".join(order), step, after[0], removed, fails[f] - removed, cells.get(bit, (0,))[0], good, toxic, f))
            subset |= bit
    return [(*row[:-1], shapley[row[-1]]) for row in rows]


_OUT = ("filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
AUDIT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.int32(), *[pa.int64()] * 7]
    for batch in batches:
        for part, cells in zip(batch.column("part").to_pylist(), batch.column("cells").to_pylist()):
            rows = audited({c["mask"]: tuple(c[k] for k in COUNTS) for c in cells})
            columns = [pa.array(values, kind) for values, kind in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(rows), pa.string()), *columns], ["part", *_OUT])


def failure_cells(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang"
) -> DataFrame:
    """``part, mask, n, good, toxic``: documents by the set of filters that they fail."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), blank(part_col).alias("part"), blank(text_col).alias("text"))
    rows = rows.mapInArrow(_masked, "id long, part string, mask int, digest binary")

    said = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    told = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id"))
    told = told.agg(said("quality").alias("good"), said("toxic").alias("toxic")).where("good or toxic").withColumn("salt", F.lit(0))
    # Rows without id meet no label; the salt keeps them from meeting in one task.
    salt = F.when(F.col("id").isNull(), F.pmod(F.xxhash64("digest", "part"), F.lit(SALTS)).cast("int")).otherwise(0)
    marked = rows.withColumn("salt", salt).join(told, ["id", "salt"], "left")
    marked = marked.select("id", "part", "mask", "digest", *[F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("good", "toxic")])

    kind = ("digest", "mask", "part", "good", "toxic")
    by_id = marked.groupBy(*kind, "id").agg(F.count("*").alias("n"))
    least = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n")))
    texts = by_id.groupBy(*kind).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("nameless"), least.alias("least"))
    first = F.min("least.id").over(Window.partitionBy("digest"))
    firsts = F.when(F.col("least.id") == first, F.col("least.n")).otherwise(0)
    texts = texts.withColumn("originals", F.col("nameless") + F.coalesce(firsts, F.lit(0)))

    sides = F.array(
        F.struct(F.col("mask").alias("mask"), F.col("originals").alias("n")),
        F.struct((F.col("mask") + COPY).alias("mask"), (F.col("n") - F.col("originals")).alias("n")),
    )
    split = texts.select("part", "good", "toxic", F.explode(sides).alias("side")).where("side.n > 0")

    def total(c: Column) -> Column:
        return F.sum(F.when(c, F.col("side.n")).otherwise(0))

    return split.groupBy("part", F.col("side.mask").alias("mask")).agg(
        F.sum("side.n").alias("n"), total(F.col("good")).alias("good"), total(F.col("toxic")).alias("toxic")
    )


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per part, order of the filters and step (see ``AUDIT``); a part has at most 32 cells."""
    cells = failure_cells(docs, labels, id_col, text_col, part_col)
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", *COUNTS)).alias("cells"))
    return parts.mapInArrow(_audits, AUDIT)
