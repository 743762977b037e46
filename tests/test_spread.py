"""Skew-safe ordered operations against plain windows."""

import random
import statistics

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from passagemill.operators import spread


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(9)}", i, rng.choice([None, "a", "b", "c"]), rng.randrange(50)) for i in range(900)]
    rng.shuffle(data)
    return spark.createDataFrame(data, "k string, pos long, v string, n long").cache()


def same(a, b):
    assert sorted(a.collect(), key=repr) == sorted(b.select(*a.columns).collect(), key=repr)


def test_running_sum(rows):
    w = Window.partitionBy("k").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    same(spread.running_sum(rows, ["k"], ["pos"], F.col("n"), "s", spread.block_of(F.col("pos"), 40)), rows.withColumn("s", F.sum("n").over(w)))


def test_next_value(rows):
    w = Window.partitionBy("k").orderBy("pos")
    same(spread.next_value(rows, ["k"], ["pos"], "v", "s", spread.block_of(F.col("pos"), 7)), rows.withColumn("s", F.lead("v").over(w)))


def test_carry_last(rows):
    w = Window.partitionBy("k").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    same(spread.carry_last(rows, ["k"], ["pos"], ["v"], spread.block_of(F.col("pos"), 9)), rows.withColumn("v", F.last("v", True).over(w)))


def test_ordered_concat(rows):
    got = {r.k: r.t for r in spread.ordered_concat(rows.where("v is not null"), ["k"], ["pos"], "v", "t", spread.block_of(F.col("pos"), 11)).collect()}
    want = {}
    for r in sorted(rows.collect(), key=lambda r: r.pos):
        if r.v:
            want[r.k] = want.get(r.k, "") + r.v
    assert got == want


def test_dense_ids_are_consecutive_and_ordered(rows):
    got = spread.dense_ids(rows, "k", "pos", "id", block_rows=16).orderBy("id").collect()
    assert [r.id for r in got] == list(range(900))
    for a, b in zip(got, got[1:]):
        assert a.k != b.k or a.pos < b.pos


def test_first_rows(rows):
    got = {r.k: r.pos for r in spread.first_rows(rows, ["k"], ["pos"]).collect()}
    want = {}
    for r in rows.collect():
        want[r.k] = min(r.pos, want.get(r.k, 1 << 60))
    assert got == want


@pytest.mark.parametrize("rule", spread.QUANTILE_RULES)
@pytest.mark.parametrize("accuracy", [10000, 100])
def test_quantiles(spark, rule, accuracy):
    """A low accuracy makes the bands narrow, so that the counting below them is exercised."""
    rng = random.Random(5)
    data = [("a", rng.choice([rng.random(), 0.5])) for _ in range(2001)] + [("b", 1.0), ("c", 3.0), ("c", 4.0), ("b", None)]
    df = spark.createDataFrame(data, "k string, x double")
    probs = {"p0": 0.0, "p50": 0.5, "p90": 0.9, "p99": 0.995, "p100": 1.0}
    got = {r.k: r for r in spread.quantiles(df, ["k"], "x", probs, rule, accuracy).collect()}
    for k in "abc":
        xs = sorted(x for j, x in data if j == k and x is not None)
        for name, q in probs.items():
            pos = (len(xs) - 1) * q
            low = int(pos)
            if rule == "floor":
                want = xs[low]
            elif rule == "half_even":
                want = xs[round(pos)]
            else:
                want = xs[low] + (xs[min(low + 1, len(xs) - 1)] - xs[low]) * (pos - low)
            assert got[k][name] == pytest.approx(want), (k, name)
    whole = spread.quantiles(df, [], "x", {"p50": 0.5}, "linear").collect()[0].p50
    assert whole == pytest.approx(statistics.median(x for _, x in data if x is not None))
