"""Hard negatives against a comparison of all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagemill.llm import hard_negatives

SMALL = {"block_rows": 64, "bucket_rows": 16, "anchor_rows": 8, "cell_rows": 100, "fan_in": 2}
SCHEMA = "vec_id long, embedding array<float>, label int, v string, ids long, cell string, keys int, best double, dim string"
EXTRA = ("x", 1, "y", 2, 0.5, "d")


def plain(rows, anchors, positives=5, negatives=10, least=30, most=90):
    """``rows``: (id, label, vector); every row is a partner but those with the anchor's id and those of other dimension."""
    out = []
    for i, label, x in anchors:
        scored = [(-sum(a * b for a, b in zip(x, y)), j, m) for j, m, y in rows if j != i and len(y) == len(x)]
        same = sorted((s, j) for s, j, m in scored if m == label)[:positives]
        for s, j in same:
            band = sorted((t, n) for t, n, m in scored if m != label and least * -s <= 100 * -t <= most * -s)[:negatives]
            out += [(i, j, r, n, -s, -t) for r, (t, n) in enumerate(band, 1)]
    return sorted(out)


def check(vectors, anchor="vec_id % 100 = 0", **sizes):
    df = hard_negatives.labelled(vectors, F.col("label")).cache()
    rows = [(r["vec_id"], r["label"], tuple(r["v"])) for r in df.collect()]
    anchors = [(r["vec_id"], r["label"], tuple(r["v"])) for r in df.where(anchor).distinct().collect()]
    got = sorted(map(tuple, hard_negatives.hard_negatives(df, df.where(anchor), **sizes).collect()))
    assert got == plain(rows, anchors)
    return got


def test_given_vectors(spark, data):
    assert check(spark.read.parquet(f"{data}/embeddings.parquet"), "vec_id % 10 = 0")


def test_small_blocks_and_deep_trees(spark, data):
    assert check(spark.read.parquet(f"{data}/embeddings.parquet"), "vec_id % 10 = 0", **SMALL)


@pytest.mark.parametrize("sizes", [{}, SMALL])
def test_clusters_and_many_lengths(spark, sizes):
    """Directions in clusters and lengths over three decades: buckets are skipped and ranges are narrow; many ties."""
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(6, 8))
    rows = []
    for i in range(900):
        x = (centres[i % 6] + draw.normal(size=8) * 0.1) * 10 ** draw.uniform(-2, 1)
        rows.append((i, [float(c) for c in x], int(draw.integers(0, 3)), *EXTRA))
    rows += [(1000 + i, [1.0] * 8, i % 2, *EXTRA) for i in range(300)]
    vectors = spark.createDataFrame(rows, SCHEMA)
    assert check(vectors, "vec_id % 50 = 0", **sizes)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (2, [0.5, 0.5], 2), (2, [0.5, 0.5], 2), (3, [0.6, 0.4], 2),
        (4, None, 1), (5, [nan, 1.0], 1), (6, [inf, 1.0], 2), (7, [None, 1.0], 2), (8, [1.0, 1.0], None), (None, [1.0, 1.0], 1),
        (9, [1.0, 0.5, 0.1], 1), (10, [1.0, 0.5, 0.2], 1), (11, [0.5, 0.4, 0.2], 2), (12, [], 1), (13, [], 2), (14, [], 1),
        (15, [0.0, 0.0], 1), (16, [0.0, 0.0], 2), (17, [-1.0, -0.5], 1), (18, [-0.5, -0.3], 2), (19, [3.0, 3.0], 7), (0, [0.2, 0.9], 2), (0, [1.0, 0.5], 1),
    ]
    vectors = spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA)
    for sizes in ({}, SMALL):
        assert check(vectors, "true", **sizes)
    assert check(vectors.limit(0)) == []
    assert check(vectors, "false") == []


def test_products_beyond_64_bits_fail(spark):
    vectors = spark.createDataFrame([(0, [1e15, 1e15], 1, *EXTRA), (1, [1e15, 1e15], 1, *EXTRA)], SCHEMA.replace("array<float>", "array<double>"))
    df = hard_negatives.labelled(vectors, F.col("label"))
    with pytest.raises(Exception, match="64 bits"):
        hard_negatives.hard_negatives(df, df).collect()


def test_ranges_hold_all_rows_of_the_band():
    """Whatever the cosine's bounds, a row within them is within every axis range; and ranges do narrow."""
    draw = np.random.default_rng(8)
    for dim in (1, 2, 3, 8):
        x, y = draw.normal(size=(400, dim)), draw.normal(size=(400, dim))
        y[:200] = x[:200] + 0.3 * y[:200]
        x, y = (m / np.sqrt((m**2).sum(1))[:, None] for m in (x, y))
        cosine = (x * y).sum(1)
        least, most = cosine - draw.uniform(0, 0.2, 400), cosine + draw.uniform(0, 0.2, 400)
        least[:50], most[:50] = cosine[:50], cosine[:50]
        low, high = hard_negatives.axis_ranges(x, least, most)
        assert ((low <= y) & (y <= high)).all()
        if dim > 2:
            assert (high - low).min() < 0.5


def test_pruning_spares_most_rows():
    """On clustered vectors of about one length the ranges leave a small part of a bucket to verify."""
    draw = np.random.default_rng(4)
    centres = draw.normal(size=(20, 6))
    points = centres[np.arange(2000) % 20] + 0.05 * draw.normal(size=(2000, 6))
    matrix = np.floor(1024 * points / np.sqrt((points**2).sum(1))[:, None]).astype(np.int64)
    packed = hard_negatives.index_block(np.arange(2000), np.zeros(2000, np.int64), matrix)
    block = hard_negatives.Block(*(packed[n] for n in ("dim", "ids", "labels", "lengths", "cuts", "matrix", "lists")))
    keys = np.concatenate([np.zeros((20, 1), np.int64), matrix[:20]], axis=1)
    anchors = hard_negatives.Anchors(6, np.arange(20).tobytes(), keys.tobytes(), b"")
    low, verified = 0.9 * anchors.lengths**2, 0
    for a, b, lists in block.buckets():
        long_enough = np.flatnonzero(low <= anchors.lengths * block.lengths[a])
        for i, rows in zip(long_enough, hard_negatives.candidates(anchors, long_enough, low, np.full(20, np.inf), block, a, b, lists)):
            verified += b - a if rows is None else len(rows)
            reached = np.flatnonzero(block.matrix[a:b].astype(np.int64) @ anchors.matrix[i] >= low[i])
            assert rows is None or set(reached) <= set(rows)
    assert verified < 0.2 * 20 * 2000
