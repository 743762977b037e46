"""Verdicts, licence matches and the ordinal fit against versions written another way."""

import math
import random
import re
import unicodedata
from collections import defaultdict

import numpy as np

from passagemill.llm import licenses, packing, quality, toxicity

from .conftest import SCHEMA, filler

# ---- op7: divergence, references, guards ---------------------------------------------------------

SYMBOLS = set("#*$%&|<>^~=+@\\_{}[]")


def char_class(c):
    kind = unicodedata.category(c)
    if kind in ("Ll", "Lo", "Lm") or kind[0] == "M":
        return 0
    if kind in ("Lu", "Lt"):
        return 1
    if c in " \t\n\x0b\x0c\r":
        return 2
    if kind == "Nd":
        return 3
    if c in SYMBOLS:
        return 4
    return 5 if kind[0] == "P" else 6


def plain_histograms(text, lang):
    chars = [0] * 7
    for c in text:
        chars[char_class(c)] += 1
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    listed = quality.COMMON_WORDS.get(lang) or sorted({w for x in quality.COMMON_WORDS.values() for w in x})
    common = [sum(w in (x, x.capitalize(), x.upper()) for w in found) for x in listed]
    return np.array(chars, float), np.array([*common, len(found) - sum(common)], float), len(found)


def distance(p, q):
    m = (p + q) / 2
    part = lambda a: sum(x * math.log2(x / y) for x, y in zip(a, m) if x > 0)
    return math.sqrt(max(0.0, part(p) / 2 + part(q) / 2))


def test_divergence_and_verdicts(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = [(r["doc_id"], r["text"] or "", r["lang"]) for r in docs.collect()]
    made = {i: plain_histograms(t, lang) for i, t, lang in rows}
    assert len(made) == len(rows)
    of_lang = defaultdict(lambda: ([], []))
    times = defaultdict(int)
    for i, _, lang in rows:
        chars, common, _ = made[i]
        times[lang] += 1
        for kept, counts in zip(of_lang[lang], (chars, common)):
            if counts.sum():
                kept.append(counts / counts.sum())
    refs = {lang: [np.mean(x, axis=0) for x in both] for lang, both in of_lang.items() if times[lang] >= 20}
    assert refs
    judged = 0
    for r in quality.judged(docs).selectExpr("doc.doc_id AS i", "doc.lang AS lang", "base_failed", "divergence", "kept").collect():
        chars, common, n = made[r["i"]]
        if chars.sum() < 100 or n < 20 or r["lang"] not in refs:
            assert r["divergence"] is None and r["kept"] == (not r["base_failed"])
            continue
        far = 0.3 * distance(chars / chars.sum(), refs[r["lang"]][0]) + 0.7 * distance(common / common.sum(), refs[r["lang"]][1])
        assert abs(far - r["divergence"]) < 1e-9
        assert r["kept"] == (not r["base_failed"] and far <= 0.21 + 0.5 / math.sqrt(n))
        judged += 1
    assert judged > 50


# ---- op9: base places and alignments -------------------------------------------------------------


def plain_words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def plain_base(found):
    hits = []
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        parts = phrase.split()
        hits += [(i, label) for i in range(len(found)) if found[i : i + len(parts)] == parts]
    return sorted(hits)


def common_run(a, b):
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def plain_labels(found):
    """Labels of all templates that stand anywhere, each place of the text against each template."""
    out = set()
    for label, template, phrases in licenses.TEMPLATES:
        template = template.split()
        for start in range(len(found)):
            window = found[start : start + len(template) + licenses.DRIFT]
            holds = all(any(window[i : i + len(p.split())] == p.split() for i in range(len(window))) for p in phrases)
            if holds and common_run(template, window) / len(template) >= licenses.LEAST_SHARE:
                out.add(label)
                break
    return out


def planted():
    draw = random.Random(9)
    noise = "the license of this work you may read it in any software file version 2 and 4 terms public mit apache general by under é中".split()
    rows = []
    for i in range(150):
        text = [draw.choice(noise) for _ in range(draw.randint(0, 60))]
        for _ in range(draw.randint(0, 2)):
            _, template, phrases = draw.choice(licenses.TEMPLATES)
            part, must = template.split(), {w for p in phrases for w in p.split()}
            if len(part) > 12 and draw.random() < 0.5:  # one word put in, one left out; mandatory words stay
                free = [k for k, w in enumerate(part) if w not in must and not any(p.split()[0] == w for p in phrases)]
                del part[draw.choice(free)]
                part.insert(draw.choice([0, len(part)]), "inserted")
            at = draw.randint(0, len(text))
            text[at:at] = part
        made = " ".join(w.upper() if draw.random() < 0.2 else w for w in text)
        rows.append((i, re.sub(" ", lambda _: draw.choice([" ", ", ", "\n", "-", "\x00"]), made)))
    return [*rows, (900, None), (901, ""), (902, "MIT License"), (903, "mit-license mit license"), (903, "general public mit license")]


def test_licenses_of_planted_texts(spark):
    rows = planted()
    table = spark.createDataFrame([(i, t, "en", "s", 1) + filler("x") for i, t in rows], SCHEMA)
    got = sorted(
        (r["doc_id"], r["n_words"], r["n_base"], -1 if r["first_word"] is None else r["first_word"], -1 if r["last_word"] is None else r["last_word"], r["base_labels"], r["labels"])
        for r in licenses.scan(table).collect()
    )
    want, licensed = [], 0
    for i, text in rows:
        found = plain_words(text or "")
        base = plain_base(found)
        own = {label for _, label in base}
        every = own | plain_labels(found)
        licensed += bool(every - own)
        starts = [s for s, _ in base]
        want.append((i, len(found), len(base), min(starts, default=-1), max(starts, default=-1), ",".join(sorted(own)), ",".join(sorted(every))))
    assert licensed > 30
    assert got == sorted(want)


def test_scores_of_matches(spark):
    whole = licenses.TEMPLATES[8]
    table = spark.createDataFrame([(1, whole[1]), (2, "no such thing"), (3, "under the MIT license")], "doc_id long, text string")
    out = {r["doc_id"]: r for r in licenses.scan(table).collect()}
    assert (out[1]["score"], out[1]["labels"], out[2]["score"], out[3]["score"]) == (1.0, "bsd", 0.0, 1.0)
    assert [(m["label"], m["first_word"], m["last_word"]) for m in out[1]["matches"]] == [("bsd", 0, len(whole[1].split()) - 1)]


# ---- op6: the fit is the optimum ------------------------------------------------------------------


def penalised(x, y, weights, thresholds, ridge):
    total = 0.5 * ridge * sum(w * w for w in weights)
    for row, grade in zip(x, y):
        at_least = [1.0, *(1 / (1 + math.exp(t - float(row @ weights))) for t in thresholds), 0.0]
        total -= math.log(max(at_least[grade] - at_least[grade + 1], 1e-15))
    return total


def test_ordinal_fit_is_the_optimum():
    draw = np.random.default_rng(4)
    x = np.log1p(draw.poisson(0.7, (200, 4)))
    hidden = x @ np.array([2.0, -1.0, 0.5, 0.0]) + draw.logistic(size=200)
    y = np.searchsorted([0.5, 1.5, 2.5], hidden)
    weights, thresholds = toxicity.fitted(x, y, 3, ridge=0.5)
    best = penalised(x, y, weights, thresholds, 0.5)
    both = np.concatenate([weights, thresholds])
    for k in range(len(both)):  # no step along any parameter makes it better, and the slope is flat
        up, down = both.copy(), both.copy()
        up[k] += 1e-4
        down[k] -= 1e-4
        slope = (penalised(x, y, up[:4], up[4:], 0.5) - penalised(x, y, down[:4], down[4:], 0.5)) / 2e-4
        assert abs(slope) < 0.05
    for _ in range(200):
        other = both + draw.normal(scale=0.1, size=len(both))
        assert penalised(x, y, other[:4], np.sort(other[4:]), 0.5) > best - 1e-3


def test_a_remembered_word_is_looked_up_once():
    import public_tokenizers

    class Counted(dict):
        looked = 0

        def get(self, word, other=None):
            Counted.looked += 1
            return super().get(word, other)

        def __getitem__(self, word):
            Counted.looked += 1
            return super().__getitem__(word)

    words = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"), remembered=5)
    text = "one two, three four: five six seven eight " * 40
    first = words.encode(text)
    words.encode("other words push the older half away")
    assert words.older and words.encode(text) == first  # taken back from the older half
    words.words = Counted(words.words)
    words.remembered = 1000
    assert words.encode(text) == first and Counted.looked == len(words._words(text.encode()))
