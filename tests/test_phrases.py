"""Texts that contain phrases, against a comparison of all."""

import random

import pytest

from passagemill.operators import phrases
from passagemill.plans import inputs


@pytest.fixture(scope="module")
def tables(spark):
    draw = random.Random(5)
    words = ["ab", "a", "b", "abc", "é", "药", "x.y", "\n", "the"]
    texts = [" ".join(draw.choice(words) for _ in range(draw.randint(0, 40))) for _ in range(120)]
    needles = ["", None, "ab", "ab", "nowhere", "b a"]
    for text in texts:
        parts = text.split(" ")
        at, n = draw.randrange(len(parts)), draw.randint(1, 6)
        cut = " ".join(parts[at : at + n])
        needles += [cut, cut[1:]]
    docs = [(i, t) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, texts[0])]
    items = list(enumerate(needles))
    expected = sorted((i, d) for i, n in items for d, t in docs if n is not None and t is not None and n in t)
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    return docs, spark.createDataFrame(items, "item_id long, text string"), expected


def test_scan_and_cells_equal_a_comparison_of_all(tables):
    docs, items, expected = tables
    asked = items.withColumnRenamed("text", "needle")
    assert sorted(map(tuple, phrases.by_scan(docs, asked).collect())) == expected
    cells = phrases.by_cells(docs, asked, most_phrases=40, most_letters=300, cell_letters=1000)
    assert sorted(map(tuple, cells.collect())) == expected


def test_more_phrases_than_an_automaton_takes(tables, monkeypatch):
    docs, items, expected = tables
    monkeypatch.setattr(phrases, "fits_one_automaton", lambda *_: False)
    pairs = inputs.containment_pairs(docs, items)
    assert sorted(map(tuple, pairs.collect())) == expected
    assert "NestedLoop" not in pairs._jdf.queryExecution().toString()


def test_no_phrases_or_texts(tables, spark):
    docs, items, _ = tables
    for some, asked in ((docs, items.limit(0)), (docs.limit(0), items)):
        named = asked.withColumnRenamed("text", "needle")
        assert phrases.by_scan(some, named).count() == 0
        assert phrases.by_cells(some, named).count() == 0
