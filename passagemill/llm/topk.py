"""Exact top-k inner products of a query set against all vectors, tile by tile.

Vectors are packed where they lie into shards of at most ``SHARD_ROWS`` rows and queries
into blocks of at most ``QUERY_ROWS``. Shards are dealt to cells of about ``CELL_ROWS``
vectors; each query block visits each cell once. A tile (one query block against one
shard) is one matrix product with a partial selection, the tiles of a cell are merged in
the task that makes them, and the cells' lists are merged by a tree of groupings with a
fixed fan-in. A task holds one tile and one block's running lists, and nothing is
broadcast. A block of 1,024 queries costs 256 KB per visit and does 8.6 GFLOP for it, so
the products, not the copies, set the time.

Components are floor(256 x); products are exact integers (in doubles while every partial
sum stays below 2^53, else in 64-bit integers, and the job fails beyond those).

Defined results: vectors that are null or hold null, NaN or infinite components take no
part, and no more do rows without id; vectors meet only vectors of their own dimension;
every row is a candidate, also repeated ones, except rows with the query's id; equal
query rows (same id and vector) are one query. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARD_ROWS, QUERY_ROWS, CELL_ROWS, FAN_IN = 4096, 1024, 65_536, 32
SCALE = 256.0
PACKED = "dim int, ids binary, matrix binary"
LISTS = "query_id long, query_key binary, cell long, best array<struct<lost:long,vec_id:long>>"


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, v``: usable vectors as arrays of longs."""
    x = F.col(vector_col)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * SCALE).cast("long"))
    rows = vectors.where(F.col(id_col).isNotNull() & x.isNotNull()).where(~bad)
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("v"))


def _packer(rows_per_block: int):
    """Arrow batches of ``vec_id, v`` to blocks ``dim, ids, matrix`` whose rows ascend by id."""

    def block(ids: np.ndarray, matrix: np.ndarray) -> dict:
        order = np.argsort(ids, kind="stable")
        return {"dim": matrix.shape[1], "ids": ids[order].tobytes(), "matrix": np.ascontiguousarray(matrix[order]).tobytes()}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list] = {}
        schema = pa.schema([("dim", pa.int32()), ("ids", pa.binary()), ("matrix", pa.binary())])
        for batch in batches:
            ids, lists = batch.column("vec_id").to_numpy(), batch.column("v")
            sizes = np.diff(lists.offsets.to_numpy())
            flat, first = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(sizes)])
            out = []
            for dim in np.unique(sizes):
                rows = np.flatnonzero(sizes == dim)
                matrix = flat[first[rows][:, None] + np.arange(dim)[None, :]]
                held = waiting.setdefault(int(dim), [])
                held.append((ids[rows], matrix))
                if sum(len(i) for i, _ in held) >= rows_per_block:
                    i, m = (np.concatenate(x) for x in zip(*held))
                    whole = len(i) // rows_per_block * rows_per_block
                    out += [block(i[a : a + rows_per_block], m[a : a + rows_per_block]) for a in range(0, whole, rows_per_block)]
                    waiting[int(dim)] = [(i[whole:], m[whole:])] if whole < len(i) else []
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
        for held in waiting.values():
            if held:
                yield pa.RecordBatch.from_pylist([block(*(np.concatenate(x) for x in zip(*held)))], schema=schema)

    return pack


def tile_best(q_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, shard: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the (score, id) of its k best rows of one shard, own id left out; ``ids`` ascend."""
    top = lambda m: int(np.abs(m).max(initial=0))
    bound = top(queries) * top(shard) * max(1, queries.shape[1])
    if bound >= 2**63:
        raise ArithmeticError("inner products of these vectors do not fit 64 bits")
    if bound < 2**53:
        scores = (queries.astype(np.float64) @ shard.astype(np.float64).T).astype(np.int64)
    else:
        scores = queries @ shard.T
    own_from, own_to = np.searchsorted(ids, q_ids, "left"), np.searchsorted(ids, q_ids, "right")
    n, out = len(ids), []
    if bound < 2**62 // max(1, n):
        # One number orders by score and then by place, hence by id; all are distinct, so selection is exact.
        keys = scores * n + (n - 1 - np.arange(n))
        for i in np.flatnonzero(own_to > own_from):
            keys[i, own_from[i] : own_to[i]] = np.iinfo(np.int64).min
        if n > k:
            part = np.argpartition(keys, n - k, axis=1)[:, n - k :]
        else:
            part = np.broadcast_to(np.arange(n), keys.shape)
        for i, some in enumerate(part):
            some = some[np.argsort(-keys[i, some], kind="stable")] if (own_to[i] == own_from[i]) else np.array(
                sorted((j for j in some if not own_from[i] <= j < own_to[i]), key=lambda j: -int(keys[i, j])), np.int64
            )
            out.append((scores[i, some], ids[some]))
        return out
    for i in range(len(q_ids)):
        rest = np.concatenate([np.arange(own_from[i]), np.arange(own_to[i], n)])
        some = rest[np.lexsort((ids[rest], -scores[i, rest]))[:k]]
        out.append((scores[i, some], ids[some]))
    return out


def _tiles(k: int):
    """Joined rows (query block, shard) to per-query lists; consecutive tiles of one block and cell are merged."""
    kind = pa.list_(pa.struct([("lost", pa.int64()), ("vec_id", pa.int64())]))
    schema = pa.schema([("query_id", pa.int64()), ("query_key", pa.binary()), ("cell", pa.int64()), ("best", kind)])

    def emit(cell: int, q_ids: np.ndarray, q_matrix: np.ndarray, lists: list) -> pa.RecordBatch:
        rows = [
            {"query_id": int(q), "query_key": v.tobytes(), "cell": cell, "best": [{"lost": -int(s), "vec_id": int(i)} for s, i in zip(*best)]}
            for q, v, best in zip(q_ids, q_matrix, lists)
        ]
        return pa.RecordBatch.from_pylist(rows, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, q_ids, queries, lists = None, None, None, None
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda name: batch.column(name)[row].as_py()  # noqa: B023, E731
                dim, key = get("dim"), (get("cell"), get("q_ids"), get("q_matrix"))
                if key != now:
                    if now is not None:
                        yield emit(now[0], q_ids, queries, lists)
                    now, q_ids = key, np.frombuffer(key[1], np.int64)
                    queries, lists = np.frombuffer(key[2], np.int64).reshape(len(q_ids), dim), None
                ids = np.frombuffer(get("ids"), np.int64)
                found = tile_best(q_ids, queries, ids, np.frombuffer(get("matrix"), np.int64).reshape(len(ids), dim), k)
                if lists is None:
                    lists = found
                else:
                    for i, (a, b) in enumerate(zip(lists, found)):
                        s, v = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
                        best = np.lexsort((v, -s))[:k]
                        lists[i] = (s[best], v[best])
        if now is not None:
            yield emit(now[0], q_ids, queries, lists)

    return run


def exact_top_k(
    queries: DataFrame, vectors: DataFrame, k: int = 5, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS,
    cell_rows: int = CELL_ROWS, fan_in: int = FAN_IN,
) -> DataFrame:
    """``query_id, rank, vec_id, score`` from two tables of ``vec_id, v``."""
    spark = vectors.sparkSession
    # Enough cells to use the cluster; beyond that one per `cell_rows`, so a cell never grows with the table.
    cells = max(-(-vectors.count() // cell_rows), 2 * spark.sparkContext.defaultParallelism)
    dealt = vectors.repartition(cells, F.xxhash64("vec_id", "v")) if shard_rows * cells > cell_rows else vectors
    shards = dealt.mapInArrow(_packer(shard_rows), PACKED).withColumn("cell", F.pmod(F.xxhash64("ids", "matrix"), F.lit(cells)))
    blocks = queries.distinct().mapInArrow(_packer(query_rows), PACKED)
    all_cells = F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long"))
    visits = blocks.select("dim", F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"), F.explode(all_cells).alias("cell"))
    tiles = visits.hint("merge").join(shards, ["cell", "dim"]).select("cell", "dim", "q_ids", "q_matrix", "ids", "matrix")
    lists = tiles.mapInArrow(_tiles(k), LISTS)
    while cells > fan_in:  # a tree: each level leaves one list per query and `fan_in` cells
        cells = -(-cells // fan_in)
        lists = lists.groupBy("query_id", "query_key", F.floor(F.col("cell") / fan_in).alias("cell")).agg(_merged(k).alias("best"))
    merged = lists.groupBy("query_id", "query_key").agg(_merged(k).alias("best"))
    ranked = merged.select("query_id", F.posexplode("best").alias("pos", "hit"))
    return ranked.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.lost")).alias("score"))


def _merged(k: int) -> Column:
    return F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k)
