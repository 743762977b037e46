"""Texts that contain given phrases, all phrases in one pass over a text."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases, and letters in them, up to which one automaton holds them all (about 100 bytes a letter).
MOST_PHRASES, MOST_LETTERS = 20_000, 1_000_000
#: Letters of texts in a cell of the grid that takes over beyond that.
CELL_LETTERS = 16_000_000


class _Automaton:
    def __init__(self, keys: Iterable[int], phrases: Iterable[str]) -> None:
        by_phrase: dict[str, list[int]] = {}
        for key, phrase in zip(keys, phrases):
            by_phrase.setdefault(phrase, []).append(int(key))
        self.everywhere = by_phrase.pop("", [])  # an empty phrase is in every text
        self.inner = ahocorasick.Automaton()
        for phrase, owners in by_phrase.items():
            self.inner.add_word(phrase, owners)
        self.inner.make_automaton()

    def found(self, text: str) -> list[int]:
        hits = set(self.everywhere)
        if len(self.inner):
            for _, owners in self.inner.iter(text):
                hits.update(owners)
        return sorted(hits)

    def pairs(self, batch: pd.DataFrame) -> pd.DataFrame:
        rows = [(key, doc) for doc, text in zip(batch["doc_id"], batch["text"]) if text is not None for key in self.found(text)]
        return pd.DataFrame(rows, columns=["item_id", "doc_id"], dtype="int64")


def fits_one_automaton(items: DataFrame, most_phrases: int = MOST_PHRASES, most_letters: int = MOST_LETTERS) -> bool:
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("needle")), F.lit(0)).alias("letters")).first()
    return size.n <= most_phrases and size.letters <= most_letters


def by_scan(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``item_id, doc_id`` of every text that contains a phrase, for phrases that fit one automaton.

    The phrases go to all tasks; the texts are read where they lie and nothing is shuffled.
    """
    rows = items.where("item_id is not null and needle is not null").select("item_id", "needle").collect()
    keys, phrases = [r.item_id for r in rows], [r.needle for r in rows]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = _Automaton(keys, phrases)
        for batch in batches:
            yield automaton.pairs(batch)

    return docs.where("doc_id is not null and text is not null").select("doc_id", "text").mapInPandas(scan, "item_id long, doc_id long")


def by_cells(docs: DataFrame, items: DataFrame, most_phrases: int = MOST_PHRASES, most_letters: int = MOST_LETTERS, cell_letters: int = CELL_LETTERS) -> DataFrame:
    """The same for any number of phrases: blocks of phrases against blocks of texts, an automaton for each block of phrases.

    A text is sent once for each block of phrases, a phrase once for each block of texts.
    """
    items = items.where("item_id is not null and needle is not null").select("item_id", "needle")
    docs = docs.where("doc_id is not null and text is not null").select("doc_id", "text")

    def blocks(df: DataFrame, text: str, rows: int, letters: int) -> int:
        size = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("letters")).first()
        return max(-(-size.n // rows), -(-size.letters // letters), 1)

    # Blocks are of half the size on average, so that the fullest stays within it.
    across, down = blocks(items, "needle", max(most_phrases // 2, 1), max(most_letters // 2, 1)), blocks(docs, "text", 100_000, cell_letters)

    def every(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    texts = docs.withColumn("_down", F.pmod(F.xxhash64("doc_id"), F.lit(down)).cast("int")).withColumn("_across", every(across))
    asked = items.withColumn("_across", F.pmod(F.xxhash64("item_id"), F.lit(across)).cast("int")).withColumn("_down", every(down))

    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _Automaton(right["item_id"], right["needle"]).pairs(left)

    keys = ["_across", "_down"]
    return texts.groupBy(keys).cogroup(asked.groupBy(keys)).applyInPandas(cell, "item_id long, doc_id long")
