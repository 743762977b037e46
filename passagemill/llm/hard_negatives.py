"""Hard negatives: rows of another label whose score lies in a band below each positive's score.

Scores are exact integer inner products of quantised vectors. Vectors are packed where they lie
into index blocks. In a block they stand by falling length, cut into length buckets, and each
bucket holds one list per coordinate of its rows in order of the normalised component.
An anchor that looks for scores in ``[low, high]`` skips the buckets too short for ``low``. In
another bucket the angle between anchor and row is confined, which confines the angle
between the row and each axis: for the anchor's largest components (its focus coordinates) this
is a range of the bucket's lists. Rows in all ranges are verified exactly. Where the ranges are
wide the bucket is verified by one matrix product for all such anchors. ``low`` rises while
an anchor's lists fill up, so the long buckets in front narrow the later ones.

Two rounds visit all blocks with all blocks of anchors: the first finds each anchor's positives, the second
for each positive the best rows of its band. Lists of different cells are merged by
groupings of fixed fan-in. A task holds one index block and one block of anchors; nothing is broadcast.

Defined results: rows without id, label or vector, and rows with a null or non-finite component, take
no part; vectors meet only vectors of their own dimension; a row with the anchor's id is no
partner of it; repeated rows are partners each on their own, while equal anchor rows (id, label and
vector) are one anchor; positives of equal score keep the order of their ids; a positive
with a negative score has an empty band; anchors without positives, and positives without rows in
their band, give no rows; an empty table gives an empty result. The job fails if products do not fit 64 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.llm.common import stored

SCALE = 256.0
BLOCK_ROWS, BUCKET_ROWS, ANCHOR_ROWS, CELL_ROWS, FAN_IN = 8192, 2048, 512, 65_536, 32
#: Within a bucket lengths fall to this share of its longest vector.
SHORTEST = 0.9
FOCUS = 6
#: Anchors whose ranges together would leave more than this share of a bucket, if components were
#: independent, are verified together by a matrix product; gathering rows one anchor at a time pays below it.
NARROW = 0.05
#: Room for the rounding of angles and normalised components.
SLACK = 1e-7

INDEX = "dim int, ids binary, labels binary, lengths binary, cuts binary, matrix binary, lists binary"
ANCHORS = "dim int, anchor_ids binary, keys binary, positives binary"
LISTS = "anchor_id long, anchor_key binary, place int, positive_id long, positive_score long, cell long, best array<struct<lost:long,vec_id:long>>"
_BEST = pa.list_(pa.struct([("lost", pa.int64()), ("vec_id", pa.int64())]))
_LISTS = pa.schema([("anchor_id", pa.int64()), ("anchor_key", pa.binary()), ("place", pa.int32()), ("positive_id", pa.int64()), ("positive_score", pa.int64()), ("cell", pa.int64()), ("best", _BEST)])


def labelled(vectors: DataFrame, label: Column, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, label, v``: rows that take part, components as floor(256 x)."""
    x = F.col(vector_col)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * SCALE).cast("long"))
    rows = vectors.where(F.col(id_col).isNotNull() & label.isNotNull() & x.isNotNull()).where(~bad)
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), whole.alias("v"))


# ---- packing -----------------------------------------------------------------------------------


def _narrowed(a: np.ndarray) -> np.ndarray:
    """The same whole numbers in the smallest type that holds them."""
    low, high = int(a.min(initial=0)), int(a.max(initial=0))
    kind = next(k for k in (np.int16, np.int32, np.int64) if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
    return np.ascontiguousarray(a, kind)


def _whole(data: bytes, cells: int) -> np.ndarray:
    return np.frombuffer(data, {2: np.int16, 4: np.int32, 8: np.int64}[len(data) // cells if cells else 8])


def bucket_cuts(lengths: np.ndarray, rows: int) -> np.ndarray:
    """Starts of the buckets of falling ``lengths``, and the end."""
    cuts = [0]
    while cuts[-1] < len(lengths):
        at = cuts[-1]
        # Falling lengths are rising when negated; at least one row, at most `rows`.
        end = int(np.searchsorted(-lengths, -SHORTEST * lengths[at], "right"))
        cuts.append(min(max(end, at + 1), at + rows, len(lengths)))
    return np.array(cuts, np.int32)


def index_block(ids: np.ndarray, labels: np.ndarray, matrix: np.ndarray, bucket_rows: int = BUCKET_ROWS) -> dict:
    """One packed row of the index: rows by falling length, buckets, sorted coordinate lists."""
    lengths = np.sqrt((matrix.astype(np.float64) ** 2).sum(1))
    order = np.lexsort((ids, -lengths))
    ids, labels, lengths, matrix = ids[order], labels[order], lengths[order], matrix[order]
    cuts = bucket_cuts(lengths, bucket_rows)
    lists = [np.argsort(_normal(matrix[a:b], lengths[a:b]), axis=0, kind="stable").T.astype(np.uint16).ravel() for a, b in zip(cuts, cuts[1:])]
    parts = {"ids": ids, "labels": labels, "lengths": lengths, "cuts": cuts, "matrix": _narrowed(matrix), "lists": np.concatenate(lists)}
    return {"dim": matrix.shape[1]} | {k: v.tobytes() for k, v in parts.items()}


def _normal(matrix: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return matrix / np.where(lengths > 0, lengths, 1.0)[:, None]


def _by_dimension(rows_per_block: int, columns: int, block: Callable, schema: pa.Schema):
    """Arrow batches of ``columns`` scalar columns and a list of longs, packed per length of the list."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list] = {}
        for batch in batches:
            lists = batch.column(columns)
            sizes = np.diff(lists.offsets.to_numpy())
            flat, first = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(sizes)])
            scalars = [batch.column(i).to_numpy() for i in range(columns)]
            for dim in np.unique(sizes):
                rows = np.flatnonzero(sizes == dim)
                held = waiting.setdefault(int(dim), [])
                held.append([*(s[rows] for s in scalars), flat[first[rows][:, None] + np.arange(dim)[None, :]]])
                if sum(len(h[0]) for h in held) >= rows_per_block:
                    whole = [np.concatenate(x) for x in zip(*held)]
                    full = len(whole[0]) // rows_per_block * rows_per_block
                    for a in range(0, full, rows_per_block):
                        yield pa.RecordBatch.from_pylist([block(*(x[a : a + rows_per_block] for x in whole))], schema=schema)
                    waiting[int(dim)] = [[x[full:] for x in whole]] if full < len(whole[0]) else []
        for held in waiting.values():
            if held:
                yield pa.RecordBatch.from_pylist([block(*(np.concatenate(x) for x in zip(*held)))], schema=schema)

    return pack


_INDEX = pa.schema([("dim", pa.int32()), *[(n, pa.binary()) for n in ("ids", "labels", "lengths", "cuts", "matrix", "lists")]])
_ANCHORS = pa.schema([("dim", pa.int32()), *[(n, pa.binary()) for n in ("anchor_ids", "keys", "positives")]])


def _index_packer(rows: int, bucket_rows: int):
    if bucket_rows > 65_536:
        raise ValueError("a bucket holds at most 65,536 rows, places in it are 16-bit numbers")
    return _by_dimension(rows, 2, lambda ids, labels, matrix: index_block(ids, labels, matrix, bucket_rows), _INDEX)


def _anchor_packer(rows: int):
    """``vec_id, label, v`` to blocks of anchors without positives; a key is the label and the vector."""

    def block(ids: np.ndarray, labels: np.ndarray, matrix: np.ndarray) -> dict:
        keys = np.concatenate([labels[:, None], matrix], axis=1).astype(np.int64)
        return {"dim": matrix.shape[1], "anchor_ids": ids.tobytes(), "keys": keys.tobytes(), "positives": b""}

    return _by_dimension(rows, 2, block, _ANCHORS)


def _with_positives(rows: int):
    """``anchor_id, anchor_key, best`` to blocks of anchors; a positive is ``id, score, 1``, padded with zeros."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list] = {}

        def block(size: int, held: list) -> pa.RecordBatch:
            most = max(len(best) for *_, best in held)
            positives = np.zeros((len(held), most, 3), np.int64)
            for i, (*_, best) in enumerate(held):
                for j, hit in enumerate(best):
                    positives[i, j] = hit["vec_id"], -hit["lost"], 1
            row = {"dim": size // 8 - 1, "anchor_ids": np.array([i for i, *_ in held], np.int64).tobytes(), "keys": b"".join(k for _, k, _ in held), "positives": positives.tobytes()}
            return pa.RecordBatch.from_pylist([row], schema=_ANCHORS)

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor_id", "anchor_key", "best"))):
                held = waiting.setdefault(len(row[1]), [])
                held.append(row)
                if len(held) == rows:
                    yield block(len(row[1]), waiting.pop(len(row[1])))
        for size, held in waiting.items():
            yield block(size, held)

    return pack


# ---- search ------------------------------------------------------------------------------------


def axis_ranges(cosines: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of a row's normalised component on an axis.

    ``cosines`` are the anchor's own components on the axes (anchors x axes); the cosine between
    anchor and row lies between ``least`` and ``most``. The angles of row, anchor and axis obey
    the triangle inequality on the sphere.
    """
    axis = np.arccos(np.clip(cosines, -1, 1))
    wide, close = (np.arccos(np.clip(c, -1, 1))[:, None] for c in (least, most))
    nearest = np.maximum(0, np.maximum(axis - wide, close - axis))
    farthest = np.where(axis + close > np.pi, 2 * np.pi - axis - close, np.minimum(np.pi, axis + wide))
    return np.cos(farthest) - SLACK, np.cos(nearest) + SLACK


class Block:
    """An index block with its anchors' exact verification."""

    def __init__(self, dim: int, ids: bytes, labels: bytes, lengths: bytes, cuts: bytes, matrix: bytes, lists: bytes) -> None:
        self.dim, self.ids, self.labels = dim, np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
        self.lengths, self.cuts = np.frombuffer(lengths, np.float64), np.frombuffer(cuts, np.int32)
        n = len(self.ids)
        self.matrix, self.lists = _whole(matrix, n * dim).reshape(n, dim), np.frombuffer(lists, np.uint16)
        self.top = int(np.abs(self.matrix.astype(np.int64)).max(initial=0))

    def buckets(self) -> Iterator[tuple[int, int, np.ndarray]]:
        for a, b in zip(self.cuts, self.cuts[1:]):
            yield int(a), int(b), self.lists[a * self.dim : b * self.dim].reshape(self.dim, b - a)


class Anchors:
    def __init__(self, dim: int, ids: bytes, keys: bytes, positives: bytes) -> None:
        self.ids = np.frombuffer(ids, np.int64)
        whole = np.frombuffer(keys, np.int64).reshape(len(self.ids), dim + 1)
        self.keys = [row.tobytes() for row in whole]
        self.labels, self.matrix = whole[:, 0], whole[:, 1:]
        self.positives = np.frombuffer(positives, np.int64).reshape(len(self.ids), -1, 3)
        self.lengths = np.sqrt((self.matrix.astype(np.float64) ** 2).sum(1))
        self.cosines = _normal(self.matrix, self.lengths)
        self.focus = np.argsort(-np.abs(self.cosines), axis=1, kind="stable")[:, :FOCUS]
        self.top = int(np.abs(self.matrix).max(initial=0))


def products(a: np.ndarray, b: np.ndarray, bound: int) -> np.ndarray:
    """Exact ``a @ b.T``; every partial sum is at most ``bound``."""
    if bound >= 2**63 // 100:
        raise ArithmeticError("inner products of these vectors do not fit 64 bits")
    if bound < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def candidates(anchors: Anchors, which: np.ndarray, low: np.ndarray, high: np.ndarray, block: Block, a: int, b: int, lists: np.ndarray):
    """For each of ``which`` anchors the rows of a bucket that lie in all its ranges, or None where the ranges are wide."""
    longest, shortest = block.lengths[a], block.lengths[b - 1]
    found: list = [None] * len(which)
    some = np.flatnonzero((low[which] > 0) & (anchors.lengths[which] > 0)) if longest > 0 else np.empty(0, np.int64)
    if not len(some):
        return found
    at = which[some]
    least = np.minimum(1, low[at] / (anchors.lengths[at] * longest)) - SLACK
    with np.errstate(divide="ignore"):
        most = np.where(shortest > 0, high[at] / (anchors.lengths[at] * shortest), 1) + SLACK
    focus = anchors.focus[at]
    lower, upper = axis_ranges(np.take_along_axis(anchors.cosines[at], focus, 1), least, np.minimum(1, most))
    begin, end = np.zeros(focus.shape, np.int64), np.zeros(focus.shape, np.int64)
    normal = _normal(block.matrix[a:b], block.lengths[a:b])
    for axis in np.unique(focus):
        users = focus == axis
        values = normal[lists[axis], axis]
        begin[users], end[users] = np.searchsorted(values, lower[users], "left"), np.searchsorted(values, upper[users], "right")
    width = np.maximum(0, end - begin)
    best = width.argmin(1)
    for i in np.flatnonzero((width / (b - a)).prod(1) <= NARROW):
        j = best[i]
        rows = lists[focus[i, j], begin[i, j] : max(begin[i, j], end[i, j])].astype(np.int64)
        for k in range(focus.shape[1]):  # the other ranges, on the rows that are left
            if k != j and len(rows):
                values = normal[rows, focus[i, k]]
                rows = rows[(values >= lower[i, k]) & (values <= upper[i, k])]
        found[some[i]] = rows
    return found


class Wanted:
    """The running lists of a block of anchors; ``same`` tells whether partners have the anchor's label."""

    def __init__(self, anchors: Anchors, k: int, least: int, most: int, same: bool) -> None:
        self.anchors, self.k, self.same, n = anchors, k, same, len(anchors.ids)
        self.low, self.high = np.full(n, -np.inf), np.full(n, np.inf)
        # A list: its scores and ids in order, and the least and largest score that it takes.
        self.lists: list[list[list]] = []
        for i in range(n):
            bands = [(-np.inf, np.inf)] if same else [(-(-least * int(s) // 100), most * int(s) // 100) for _, s, there in anchors.positives[i] if there]
            self.lists.append([[np.empty(0, np.int64), np.empty(0, np.int64), lo, hi] for lo, hi in bands])
            self._bound(i)

    def _bound(self, i: int) -> None:
        open_ = [b for b in self.lists[i] if b[2] <= b[3]]
        self.low[i] = min((max(lo, s[-1]) if len(s) == self.k else lo for s, _, lo, _ in open_), default=np.inf)
        self.high[i] = max((hi for *_, hi in open_), default=-np.inf)

    def add(self, i: int, scores: np.ndarray, ids: np.ndarray) -> None:
        fit = (scores >= self.low[i]) & (scores <= self.high[i])
        if not fit.any():
            return
        scores, ids = scores[fit], ids[fit]
        for band in self.lists[i]:
            held, held_ids, lo, hi = band
            fit = (scores >= (max(lo, held[-1]) if len(held) == self.k else lo)) & (scores <= hi)
            if fit.any():
                s, v = np.concatenate([held, scores[fit]]), np.concatenate([held_ids, ids[fit]])
                if len(s) > 4 * self.k:  # ties of the k-th score stay
                    near = s >= np.partition(s, len(s) - self.k)[len(s) - self.k]
                    s, v = s[near], v[near]
                best = np.lexsort((v, -s))[: self.k]
                band[0], band[1] = s[best], v[best]
        self._bound(i)

    def visit(self, block: Block) -> None:
        anchors = self.anchors
        bound = anchors.top * block.top * max(1, block.dim)
        for a, b, lists in block.buckets():
            reach = anchors.lengths * block.lengths[a] * (1 + SLACK)
            alive = np.flatnonzero(self.low <= reach)
            if not len(alive):
                if (self.low == np.inf).all() or block.lengths[a] <= 0:
                    break
                continue
            rows = candidates(anchors, alive, self.low, self.high, block, a, b, lists)
            ids, labels, matrix = block.ids[a:b], block.labels[a:b], block.matrix[a:b]
            for i, some in zip(alive, rows):
                if some is None:
                    continue
                some = some[((labels[some] == anchors.labels[i]) == self.same) & (ids[some] != anchors.ids[i])]
                if len(some):
                    self.add(i, products(anchors.matrix[i : i + 1], matrix[some], bound)[0], ids[some])
            wide = np.array([i for i, some in zip(alive, rows) if some is None], np.int64)
            if not self.same and len(wide):
                scores = products(anchors.matrix[wide], matrix, bound)
                for i, line in zip(wide, scores):
                    other = (labels != anchors.labels[i]) & (ids != anchors.ids[i])
                    self.add(i, line[other], ids[other])
            elif len(wide):
                for label in np.unique(anchors.labels[wide]):
                    partners, mine = np.flatnonzero(labels == label), wide[anchors.labels[wide] == label]
                    if len(partners):
                        scores, names = products(anchors.matrix[mine], matrix[partners], bound), ids[partners]
                        for i, line in zip(mine, scores):
                            other = names != anchors.ids[i]
                            self.add(i, line[other], names[other])

    def rows(self, cell: int) -> list[dict]:
        out = []
        for i, bands in enumerate(self.lists):
            for place, (scores, ids, *_) in enumerate(bands):
                if len(scores):
                    positive, score = (None, None) if self.same else (int(x) for x in self.anchors.positives[i, place, :2])
                    best = [{"lost": -int(s), "vec_id": int(v)} for s, v in zip(scores, ids)]
                    out.append({"anchor_id": int(self.anchors.ids[i]), "anchor_key": self.anchors.keys[i], "place": place, "positive_id": positive, "positive_score": score, "cell": cell, "best": best})
        return out


def _visits(k: int, least: int, most: int, same: bool):
    """Joined rows (anchors, index block) to lists; consecutive visits of the same anchors and cell share theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, wanted = None, None
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda name: batch.column(name)[row].as_py()  # noqa: B023, E731
                key = (get("cell"), get("dim"), get("anchor_ids"), get("keys"), get("positives"))
                if key != now:
                    if wanted:
                        yield pa.RecordBatch.from_pylist(wanted.rows(now[0]), schema=_LISTS)
                    now, wanted = key, Wanted(Anchors(*key[1:]), k, least, most, same)
                wanted.visit(Block(key[1], *(get(n) for n in ("ids", "labels", "lengths", "cuts", "matrix", "lists"))))
        if wanted:
            yield pa.RecordBatch.from_pylist(wanted.rows(now[0]), schema=_LISTS)

    return run


def _merged(lists: DataFrame, cells: int, k: int, fan_in: int) -> DataFrame:
    """One list for each anchor and place; no grouping takes more than ``fan_in`` lists of one key."""
    names = ("anchor_id", "anchor_key", "place", "positive_id", "positive_score")
    best = F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best")
    while cells > fan_in:
        cells = -(-cells // fan_in)
        lists = lists.groupBy(*names, F.floor(F.col("cell") / fan_in).alias("cell")).agg(best)
    return lists.groupBy(*names).agg(best)


def hard_negatives(
    vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90,
    block_rows: int = BLOCK_ROWS, bucket_rows: int = BUCKET_ROWS, anchor_rows: int = ANCHOR_ROWS, cell_rows: int = CELL_ROWS, fan_in: int = FAN_IN,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` from two tables of ``vec_id, label, v``.

    A positive is one of the ``positives`` best rows of the anchor's label. Its negatives are the best
    rows of other labels with scores from ``least`` to ``most`` percent of its own.
    """
    spark = vectors.sparkSession
    cells = max(-(-vectors.count() // cell_rows), 2 * spark.sparkContext.defaultParallelism)
    dealt = vectors.repartition(cells, F.xxhash64("vec_id", "v"))
    index = dealt.mapInArrow(_index_packer(block_rows, bucket_rows), INDEX)
    index = stored(index.withColumn("cell", F.pmod(F.xxhash64("ids", "lengths"), F.lit(cells))), "hard-negative-index")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long"))).alias("cell")

    def searched(blocks: DataFrame, k: int, same: bool) -> DataFrame:
        visits = blocks.select("dim", "anchor_ids", "keys", "positives", every).hint("merge").join(index, ["cell", "dim"])
        return _merged(visits.mapInArrow(_visits(k, least, most, same), LISTS), cells, k, fan_in)

    first = searched(anchors.distinct().mapInArrow(_anchor_packer(anchor_rows), ANCHORS), positives, True)
    first = stored(first.select("anchor_id", "anchor_key", "best"), "hard-negative-positives")
    second = searched(first.mapInArrow(_with_positives(anchor_rows), ANCHORS), negatives, False)
    ranked = second.select("anchor_id", "positive_id", "positive_score", "place", F.posexplode("best").alias("pos", "hit"))
    return ranked.select(
        "anchor_id", "positive_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("negative_id"),
        "positive_score", (-F.col("hit.lost")).alias("negative_score"),
    )
