"""License scans with a positional index of rare template words.

Templates are license texts and notices as word lists. The corpus gives every template
word its document frequency; each template is indexed by its rarest words with their
places. A file's words that are in the index vote for alignments (template, place in the
file minus place in the template); alignments on which several rare words agree, allowing
for a few words put in or left out, are compared with the template word by word, and hold
only if the template's mandatory phrases stand there too.

Every word of every text is looked up. Templates and their index do not depend on the
corpus' size and travel with the tasks; the frequencies cover all documents.

Defined results: a null text is empty; empty texts have no words, labels '' and score 0;
rows that repeat are scanned each on its own; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")  # of UTF-8 with A-Z lower-cased: runs of digits, letters a-z and all above ASCII

# Phrases whose places are counted, and their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Fixed values: (label, words of the license or notice, phrases that must stand in the matched place).
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ["permission is hereby granted free of charge", "without restriction"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", ["apache license"]),
    ("apache", "licensed under the apache license version 2 0", ["apache license"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["gnu general public license"]),
    ("gpl", "this work is licensed under the gnu general public license version 3", ["general public license"]),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ["lesser general public license"]),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", ["affero general public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software"]),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", ["eclipse public license"]),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0"]),
    ("cc-by", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ["creative commons attribution sharealike"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ["creative commons attribution noncommercial"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
]

RARE_WORDS, DRIFT, LEAST_SHARE = 6, 4, 0.7


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode("utf-8", "replace").lower())


def split_words(phrase: str) -> list[bytes]:
    return phrase.encode().split()


class LicenseIndex:
    """Postings of each template's rarest words: word -> [(template, place)]."""

    def __init__(self, doc_frequency: dict[str, int], n_docs: int, templates=TEMPLATES, rare_words: int = RARE_WORDS) -> None:
        self.labels = [label for label, _, _ in templates]
        self.words = [split_words(text) for _, text, _ in templates]
        self.mandatory = [[split_words(p) for p in phrases] for _, _, phrases in templates]
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.wanted: list[int] = []
        for t, words in enumerate(self.words):
            idf = {w: math.log((n_docs + 1) / (doc_frequency.get(w.decode(), 0) + 1)) for w in set(words)}
            rare = set(sorted(idf, key=lambda w: (-idf[w], w))[:rare_words])
            for place, word in enumerate(words):
                if word in rare:
                    self.postings[word].append((t, place))
            self.wanted.append(max(1, len(rare) // 2))
        self.base = [(split_words(p), label) for p, label in BASE_PHRASES.items()]
        self.last_words = {p[-1] for p, _ in self.base}
        self.lookup = frozenset(self.postings) | self.last_words

    def matches(self, words: list[bytes]) -> list[tuple[str, int, int, float]]:
        """``(label, first word, last word, share of the template found)`` of every verified alignment."""
        votes: dict[int, dict[int, set[bytes]]] = defaultdict(lambda: defaultdict(set))
        for place, word in enumerate(words):
            for t, q in self.postings.get(word, ()):
                votes[t][place - q].add(word)
        found = []
        for t, shifts in votes.items():
            done = None
            for shift in sorted(shifts):
                near = set().union(*(shifts[s] for s in range(shift, shift + DRIFT + 1) if s in shifts))
                if len(near) < self.wanted[t] or (done is not None and shift <= done):
                    continue
                share, first, last = self._share(words, t, shift)
                if share >= LEAST_SHARE and all(self._stands(words, p, first, last) for p in self.mandatory[t]):
                    found.append((self.labels[t], first, last, share))
                    done = shift + DRIFT
        return found

    def _share(self, words: list[bytes], t: int, shift: int) -> tuple[float, int, int]:
        """Template words met in order near their places; a word put in or left out moves the rest along."""
        template, drift, hits, first, last = self.words[t], 0, 0, None, shift
        for q, word in enumerate(template):
            for step in sorted(range(-1, DRIFT + 1), key=abs):
                at = shift + q + drift + step
                if 0 <= at < len(words) and at > (last if first is not None else -1) and words[at] == word:
                    drift, hits, last = drift + step, hits + 1, at
                    first = at if first is None else first
                    break
        return hits / len(template), first if first is not None else 0, last

    @staticmethod
    def _stands(words: list[bytes], phrase: list[bytes], first: int, last: int) -> bool:
        n = len(phrase)
        return any(words[i : i + n] == phrase for i in range(max(0, first), min(len(words), last + 1) - n + 1))

    def base_places(self, words: list[bytes]) -> list[tuple[int, str]]:
        found = []
        for place, word in enumerate(words):
            if word in self.last_words:
                for phrase, label in self.base:
                    start = place - len(phrase) + 1
                    if start >= 0 and words[start : place + 1] == phrase:
                        found.append((start, label))
        return found


def template_frequencies(docs: DataFrame, text_col: str = "text", templates=TEMPLATES) -> tuple[dict[str, int], int]:
    """In how many documents each template word stands, and the number of documents; at most one row per template word."""
    vocabulary = frozenset(w for _, text, _ in templates for w in split_words(text))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = defaultdict(int)
        total = 0
        for batch in batches:
            for text in batch.column(0):
                total += 1
                for word in vocabulary.intersection(words_of(text.as_py())):
                    seen[word] += 1
        names = [None, *(w.decode() for w in seen)]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([total, *seen.values()], pa.int64())], ["word", "n"])

    counted = docs.select(F.col(text_col).cast("string")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = {r["word"]: r["n"] for r in counted.collect()}
    return {w: n for w, n in found.items() if w is not None}, found.get(None, 0)


SCANNED = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "matches array<struct<label:string,first_word:long,last_word:long,share:double>>"
)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts and places of the base phrases, all labels, the best share, and the matched spans."""
    frequency, n_docs = template_frequencies(docs, text_col)
    index = LicenseIndex(frequency, n_docs)
    span = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("share", pa.float64())])
    kinds = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.float64(), pa.list_(span)]
    names = [part.split()[0] for part in SCANNED.split(", ")[:8]] + ["matches"]

    def one(text: str | None) -> tuple:
        words = words_of(text)
        if index.lookup.isdisjoint(words):
            return len(words), 0, None, None, "", "", 0.0, []
        base, spans = index.base_places(words), index.matches(words)
        starts = [start for start, _ in base]
        own = {label for _, label in base}
        score = max([*(s[3] for s in spans), 1.0 if base else 0.0])
        shown = [dict(zip(("label", "first_word", "last_word", "share"), s)) for s in spans]
        every = ",".join(sorted(own | {s[0] for s in spans}))
        return len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)), every, score, shown

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = list(zip(*(one(text.as_py()) for text in batch.column(1)))) or [()] * 8
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds[1:]))], names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCANNED)
