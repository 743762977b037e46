"""Repeated passages: exact runs of words that stand in more than one place.

Units are normalised, their digests grouped over the whole table, the earliest occurrence
by (id, place) is kept, and every other one is marked with its offsets in the original
text. Lines and paragraphs as units would miss passages that begin or end inside a line,
which most repeated passages do, so there are two kinds of unit: the whole text, and
every window of ``run`` words. Windows are only built where they can repeat: winnowing
picks, by content alone, at least one ``run / 2``-word anchor out of every run of ``run``
words; texts none of whose anchors occurs twice are out, and the others are windowed only
around their repeated anchors. This finds exactly the windows that a comparison of all
windows of all texts would find. Overlapping marked windows are joined into spans.

Hot passages: anchors and windows are counted by grouping with partial sums, and joins
with the repeated ones are between stored tables, so Spark can split a passage that a
third of all documents share.

Defined results: words are separated by ASCII white space and compared in lower case;
null, empty and shorter texts have no windows, and only texts with a word count as copies
of each other; a document without id takes a hash of its text as id; rows that share an
id and a text are one; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagemill.llm.common import stored
from passagemill.llm.near_dedup import Shingler, mix, with_ids

RUN = 50
BASE = np.uint64(0xD6E8FEB86659FD93)
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def anchors(word_hashes: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """``places, hashes`` of the anchors: of any ``run - size + 1`` successive windows of ``size = run // 2`` words the least."""
    size = run // 2
    width = run - size + 1
    n = len(word_hashes) - size + 1
    if n < width:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    grams = window_hashes(word_hashes, size)
    least = np.lib.stride_tricks.sliding_window_view(grams, width).argmin(1) + np.arange(n - width + 1)
    places = np.unique(least)
    return places, grams[places]


def window_hashes(word_hashes: np.ndarray, size: int) -> np.ndarray:
    """A polynomial hash of each window of ``size`` words."""
    n, total = len(word_hashes) - size + 1, np.uint64(0)
    for j in range(size):
        total = total * BASE + word_hashes[j : j + n]
    return mix(total)


def _hashed(run: int, wide: bool):
    """Arrow batches ``id, text`` to ``id, anchor`` rows, or to windows ``id, place, window, start, end`` with ``wide``.

    For windows a third column holds the repeated anchors of the text.
    """

    def run_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Shingler(1)
        for batch in batches:
            ids, found = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                _, hashes = anchors(words(text.as_py()), run)
                ids.append(np.full(len(hashes), doc_id, np.int64))
                found.append(hashes.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids or [[]]), pa.int64()), pa.array(np.concatenate(found or [[]]), pa.int64())], ["id", "anchor"])

    def run_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Shingler(1)
        for batch in batches:
            for doc_id, text, repeated in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                text = text.as_py()
                hashes = words(text)
                places, found = anchors(hashes, run)
                places = places[np.isin(found.view(np.int64), np.array(repeated.as_py(), np.int64))]
                last = len(hashes) - run
                # Windows that hold a repeated anchor start at most run - size words before it.
                start = np.unique((places[:, None] - np.arange(run - run // 2 + 1)[None, :]).ravel())
                start = start[(start >= 0) & (start <= last)]
                spans = np.array([m.span() for m in WORD.finditer(text)], np.int64)
                cols = [
                    pa.array(np.full(len(start), doc_id), pa.int64()), pa.array(start, pa.int64()),
                    pa.array(window_hashes(hashes, run)[start].view(np.int64), pa.int64()),
                    pa.array(spans[start, 0], pa.int64()), pa.array(spans[start + run - 1, 1], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(cols, ["id", "place", "window", "start", "end"])

    return run_windows if wide else run_anchors


def repeated_spans(docs: DataFrame, run: int = RUN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, start, end, n_words, first_id, whole``: spans (in code points) to remove, and the document that keeps the passage.

    ``whole`` marks a text that equals an earlier one altogether.
    """
    base = with_ids(docs, id_col, text_col).select("id", "h1", "h2", "text")
    keyed = base.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select("id", "h1", "h2", F.length("text").alias("size"))
    firsts = stored(keyed.groupBy("h1", "h2").agg(F.min("id").alias("first_id"), F.count("*").alias("n")), "text-copies")
    more = firsts.where(F.col("n") > 1)
    # Word counts of whole copies come from the text, so only its length travels.
    copies = keyed.join(more, ["h1", "h2"]).where(F.col("id") != F.col("first_id")).distinct()
    copies = copies.select("id", F.lit(0).cast("long").alias("start"), F.col("size").cast("long").alias("end"), "first_id", F.lit(True).alias("whole"))

    own = base.join(firsts.select(F.col("first_id").alias("id"), "h1", "h2").alias("f"), ["id", "h1", "h2"], "left_semi").dropDuplicates(["id", "h1", "h2"])
    texts = own.select("id", "text")
    marks = stored(texts.mapInArrow(_hashed(run, False), "id long, anchor long"), "anchors")
    shared = stored(marks.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("anchor"), "shared-anchors")
    wanted = marks.join(shared, "anchor").groupBy("id").agg(F.collect_set("anchor").alias("repeated"))
    windows = texts.join(wanted, "id").select("id", "text", "repeated").mapInArrow(
        _hashed(run, True), "id long, place long, window long, start long, end long"
    )
    windows = stored(windows, "windows")
    keepers = windows.groupBy("window").agg(F.min(F.struct("id", "place")).alias("keep"), F.count("*").alias("n")).where(F.col("n") > 1)
    keepers = stored(keepers.select("window", "keep"), "repeated-windows")
    marked = windows.join(keepers, "window").where(F.struct("id", "place") != F.col("keep"))
    marked = marked.select("id", "place", "start", "end", F.col("keep.id").alias("first_id"))
    in_doc = Window.partitionBy("id").orderBy("place")
    opens = F.coalesce(F.col("place") > F.lag("place").over(in_doc) + run, F.lit(True))
    spans = marked.withColumn("opens", opens).withColumn("span", F.sum(F.col("opens").cast("int")).over(in_doc))
    spans = spans.groupBy("id", "span").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), (F.max("place") + run - F.min("place")).alias("n_words"), F.min("first_id").alias("first_id")
    )
    spans = spans.select("id", "start", "end", "n_words", "first_id", F.lit(False).alias("whole"))
    return spans.unionByName(copies.withColumn("n_words", F.lit(None).cast("long")).select(*spans.columns))


def without_spans(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the marked spans cut out of the text; all other columns as they came."""
    cuts = spans.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cuts"))
    rows = with_ids(docs, id_col, text_col).select("doc", "id", "text").join(cuts, "id", "left")
    begin = F.struct(F.lit("").alias("kept"), F.lit(0).cast("long").alias("at"))

    def cut(a, c):
        part = F.substring(F.col("text"), (a["at"] + 1).cast("int"), F.greatest(c["start"] - a["at"], F.lit(0)).cast("int"))
        return F.struct(F.concat(a["kept"], part).alias("kept"), F.greatest(a["at"], c["end"]).alias("at"))

    done = F.aggregate("cuts", begin, cut, lambda a: F.concat(a["kept"], F.substring(F.col("text"), (a["at"] + 1).cast("int"), F.length("text"))))
    text = F.when(F.col("cuts").isNotNull(), done).otherwise(F.col("doc")[text_col])
    return rows.select(*[text.alias(c) if c == text_col else F.col("doc")[c].alias(c) for c in docs.columns])
