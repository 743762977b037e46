"""Global places and running totals against plain sorting."""

import random
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from passagemill.operators import positions, stats


@pytest.fixture(scope="module")
def rows(spark):
    draw = random.Random(2)
    data = [(draw.choice(["a", "b", None]), draw.choice([0.5, -1.0, draw.random(), 1e9 * draw.random()]), i) for i in range(3000)]
    return data, spark.createDataFrame(data, "k string, x double, i long").repartition(7)


@pytest.mark.parametrize("start, most", [(0, 5), (100, 250), (2990, 50), (5000, 3), (0, 0), (17, 0), (-3, 4), (700, 1500)])
@pytest.mark.parametrize("top", [10_000, 0])
def test_between(monkeypatch, rows, start, most, top):
    monkeypatch.setattr(positions, "TOP_ROWS", top)
    data, df = rows
    order = sorted(data, key=lambda r: (-r[1], r[2]))[max(start, 0) :]
    want = order[:most] if most else order
    got = positions.between(df, [F.col("x").desc(), F.col("i")], start, most)
    assert [tuple(r) for r in got.collect()] == want and got.columns == df.columns


def test_running_totals(rows):
    data, df = rows
    got = {(r.k, r.x, r.i): r.upto for r in positions.running_totals(df, ["k"], ["x", "i"], F.col("i"), "upto", 5).collect()}
    for k in ("a", "b", None):
        mine = sorted((x, i) for key, x, i in data if key == k)
        assert [got[k, x, i] for x, i in mine] == list(accumulate(i for _, i in mine))


def test_ranges_are_even_wherever_the_values_lie(spark):
    """All values below 1/64, and one far away: no range holds over twice the mean."""
    df = spark.range(20_000).select((F.col("id") / 20_000 / 64).alias("x")).union(spark.createDataFrame([(1e9,)], "x double"))
    counts = [r["count"] for r in positions.dealt_by_range(df, ["x"], 8).groupBy("_range").count().collect()]
    assert len(counts) == 8 and max(counts) <= 2 * 20_001 / 8


def test_signed_rank_of_many_small_values(spark):
    draw = random.Random(9)
    diffs = [draw.choice([-1, 1]) * draw.randrange(1, 400) / 400 / 64 for _ in range(3000)] + [1e9, -0.5, 0.0]
    frame = spark.createDataFrame([("m", d) for d in diffs], "metric string, diff double")
    row = stats.signed_rank(frame).first()
    sizes = sorted(abs(d) for d in diffs if d)
    first, count = {}, {}
    for i, s in enumerate(sizes, 1):
        first.setdefault(s, i)
        count[s] = count.get(s, 0) + 1
    rank = lambda d: first[abs(d)] + (count[abs(d)] - 1) / 2
    up, down = (sum(rank(d) for d in diffs if d * sign > 0) for sign in (1, -1))
    assert (row.n, row.w) == (len(sizes), min(up, down))


def test_bootstrap_leaves(spark):
    """Many leaves: the same interval however rows are dealt, and about that of the normal approximation."""
    draw = random.Random(4)
    diffs = [draw.gauss(0.3, 1) for _ in range(2500)] + [0.25] * 300
    frame = spark.createDataFrame([("m", d) for d in diffs] + [("one", 2.0)] * 5, "metric string, diff double")
    a, b = ({r.metric: (r.ci_low, r.ci_high) for r in stats.bootstrap_ci(frame.repartition(n), 800, leaf_values=100).collect()} for n in (1, 6))
    assert a == b and a["one"] == (2.0, 2.0)
    mean = sum(diffs) / len(diffs)
    error = (sum((d - mean) ** 2 for d in diffs) / len(diffs) ** 2) ** 0.5
    assert abs(a["m"][0] - (mean - 1.96 * error)) < 0.25 * error and abs(a["m"][1] - (mean + 1.96 * error)) < 0.25 * error
    single = stats.bootstrap_ci(frame, 800, leaf_values=10**6).where("metric = 'm'").first()
    assert abs(single.ci_low - a["m"][0]) < 0.25 * error
