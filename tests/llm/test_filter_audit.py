"""The filter audit against a plain replay of all 120 orders, document by document."""

import random
import re
from collections import defaultdict
from itertools import permutations

import pytest

from passagemill.llm import filter_audit

from .conftest import SCHEMA, filler, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def replay(docs, labels):
    """``docs``: (id, part, text); ``labels``: (id, quality, toxic)."""
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    first = {}
    for i, _, text in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    parts = defaultdict(list)
    for i, part, text in docs:
        text = text or ""
        found = WORD.findall(text)
        fails = set()
        if len(found) < 200:
            fails.add("A")
        if 100 * len(set(found)) < 50 * len(found):
            fails.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text):
            fails.add("C")
        if re.search(r"[#$%&*|]", text):
            fails.add("D")
        if i is not None and first[text] < i:
            fails.add("E")
        parts[part or ""].append((fails, i in good, i in toxic))
    out, removals = {}, defaultdict(int)
    for part, members in parts.items():
        for order in permutations("ABCDE"):
            left = members
            for step, f in enumerate(order, 1):
                gone = [m for m in left if f in m[0]]
                left = [m for m in left if f not in m[0]]
                redundant = sum(f in m[0] for m in members) - len(gone)
                unique = sum(m[0] == {f} for m in members)
                out[part, "".join(order), step] = [len(left), len(gone), redundant, unique, sum(m[1] for m in gone), sum(m[2] for m in gone)]
                removals[part, f] += len(gone)
    return {k: (*v, removals[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def computed(docs, labels):
    rows = filter_audit.filter_audit(docs, labels).collect()
    got = {tuple(r[:3]): tuple(r[3:]) for r in rows}
    assert len(got) == len(rows)
    return got


def plain(docs, labels):
    return replay([(r["doc_id"], r["lang"], r["text"]) for r in docs.collect()], [(r["doc_id"], r["quality"], r["toxic"]) for r in labels.collect()])


def test_given_documents(spark, data):
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    assert computed(docs, labels) == plain(docs, labels)


def test_odd_rows(odd_docs, odd_labels):
    assert computed(odd_docs, odd_labels) == plain(odd_docs, odd_labels)


def test_empty_tables(no_docs, odd_docs, odd_labels):
    assert computed(no_docs, odd_labels) == {}
    assert computed(odd_docs, odd_labels.limit(0)) == plain(odd_docs, odd_labels.limit(0))


def test_copies_and_mixed_failures(spark):
    """A third of all rows share one text; the rest fail every mixture of filters."""
    draw, rows = random.Random(5), []
    for i in range(600):
        text = words(i, draw.choice((150, 199, 200, 260)), draw.choice((20, 4000)))
        if draw.random() < 0.4:
            text = text.upper()
        if draw.random() < 0.3:
            text += draw.choice("#$%&*|")
        if i % 3 == 0:
            text = words(1, 40, 8)
        rows.append((draw.choice((i, i % 50, None)), text, draw.choice(("en", "de", None, "")), "s", 1) + filler("x"))
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, draw.choice((0, 1, None)), draw.choice((0, 1, None))) for i in range(0, 600, 2)] + [(4, 1, 1), (4, 0, 0)], "doc_id long, quality int, toxic int")
    assert computed(docs, labels) == plain(docs, labels)


@pytest.mark.parametrize("seed", range(5))
def test_walk_equals_direct_counts(seed):
    draw = random.Random(seed)
    cells = {m: (draw.randrange(100), draw.randrange(9), draw.randrange(9)) for m in draw.sample(range(32), 12)}
    for subset, state in enumerate(filter_audit.subset_states(cells)):
        assert state == tuple(sum(c[k] for m, c in cells.items() if not m & subset) for k in range(3))
