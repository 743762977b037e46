"""Best-fit packing of tokenised documents into sequences, planned on the length histogram.

The histogram of piece lengths (at most ``capacity`` rows) is all that the planner sees.
Best-fit decreasing over counts instead of documents gives, for each length, a list of
slots: consecutive ranks that go to consecutive sequences at one offset. Pieces are then
numbered within their length and take the slot of their rank by a join. The plan's size
depends on ``capacity`` only: a step moves whole classes of equally filled sequences and
splits at most one, so it has a few slots per length, whatever the number of documents.

A length shared by very many pieces is numbered in blocks of about ``BLOCK`` rows, whose
starts come from a table of counts, so no task holds all pieces of one length.

Defined results: a null or empty text is one piece that holds the end id alone; rows that
repeat an id are packed each on its own; pieces keep their document's order by ``piece``.
Extra columns are ignored.
"""

from __future__ import annotations

import bisect
import functools
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagemill.llm.common import stored

CAPACITY, END_ID = 4096, 1
BLOCK = 8192
#: Words whose ids a worker remembers; twice as many at most, since the older half stays readable.
REMEMBERED = 200_000

PIECES = "doc_id long, piece int, start long, length long, ids binary"


# Kinds of bytes: ASCII letters, signs that end a word for the tokenizer.
_LETTER, _SIGN = (np.zeros(256, bool) for _ in range(2))
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_SIGNS = ".,;:!?$&#%*()=+/-"
_SIGN[list(_SIGNS.encode())] = True
#: The Latin letters above ASCII that two bytes of UTF-8 hold, with the few other characters between them.
_LATIN = range(0xC0, 0x280)


def letters_before_signs(tokenizer) -> np.ndarray:
    """By code point below 2048: the characters of ``_LATIN`` that this tokenizer always parts from a sign after them.

    Asked of its normalizer and its way to part words: a letter whose lower case ends in a
    mark (the capital I with a dot) is not one of them, nor is an arithmetic sign.
    """
    parts = np.zeros(2048, bool)
    if tokenizer.pre_tokenizer is None:
        return parts
    normal = tokenizer.normalizer.normalize_str if tokenizer.normalizer else str
    for code in _LATIN:
        texts = [normal(before + chr(code) + sign) for before in ("", "a") for sign in _SIGNS]
        pieces = [tokenizer.pre_tokenizer.pre_tokenize_str(t) for t in texts]
        letter = normal(chr(code))[-1:].isalpha()
        parts[code] = letter and all(found and found[-1][1][0] == len(t) - 1 for t, found in zip(texts, pieces))
    return parts


class WordIds:
    """Token ids of texts, as little-endian unsigned 32-bit integers, with a memory of words.

    For tokenizers that drop white space, lower-case and never join an ASCII letter with a sign
    after it, the ids of a text are those of its words and trailing signs in a row. ``split``
    says so; without it whole texts are encoded. Words are cut at the plain space, the line
    break and between a sign and an ASCII letter, or one of ``letters_before_signs``, before it; anything
    else stays inside a word and is left to the tokenizer. A text's new words are encoded in one call and told apart by the
    tokens' places.
    """

    def __init__(self, path: str, split: bool = True, remembered: int = REMEMBERED) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.split, self.remembered = Tokenizer.from_file(path), split, remembered
        self.parted = letters_before_signs(self.tokenizer)
        self.words: dict[bytes, bytes] = {b"": b""}
        self.older: dict[bytes, bytes] = {}

    def encode(self, text: str) -> bytes:
        if not self.split:
            return self._ids([text])[0]
        if len(self.words) > self.remembered:
            self.older, self.words = self.words, {b"": b""}
        words = self._words(text.encode("utf-8", "replace"))
        ids = list(map(self.words.get, words))
        if None in ids:
            gaps = [k for k, found in enumerate(ids) if found is None]
            unseen = {words[k] for k in gaps}
            known = {w: self.older[w] for w in unseen if w in self.older}
            self.words.update(known)
            fresh = list(unseen.difference(known))
            if fresh:
                self.words.update(zip(fresh, self._ids([w.decode() for w in fresh])))
            for k in gaps:
                ids[k] = self.words[words[k]]
        return b"".join(ids)

    def _words(self, raw: bytes) -> list[bytes]:
        # Not where a mark could join a small letter only, nor where special tokens might be spelled in capitals.
        if b"\xcc" not in raw and b"\xcd" not in raw and b"<|" not in raw:
            raw = raw.lower()
        data = np.frombuffer(raw, np.uint8)
        at = np.flatnonzero(_SIGN[data])
        at = at[at > 1]
        if len(at):
            last, first = data[at - 1], data[at - 2]
            two_bytes = (last >= 0x80) & (first >= 0xC0) & (first < 0xE0)
            latin = two_bytes & self.parted[(first & 0x1F).astype(np.int64) << 6 | (last & 0x3F)]
            raw = np.insert(data, at[_LETTER[last] | latin], 32).tobytes()
        return raw.replace(b"\n", b" ").split(b" ")

    def _ids(self, words: list[str]) -> list[bytes]:
        encoded = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        raw = np.array(encoded.ids, "<u4").tobytes()
        if len(words) == 1:
            return [raw]
        starts = np.cumsum([0, *(len(w) + 1 for w in words)])
        places = np.fromiter((start for start, _ in encoded.offsets), np.int64, len(encoded.ids))
        ends = (4 * np.searchsorted(places, starts)).tolist()
        return [raw[a:b] for a, b in zip(ends, ends[1:])]


@functools.cache
def word_ids(path: str, split: bool) -> WordIds:
    """One per worker process: loading and learning are not repeated for each task."""
    return WordIds(path, split)


def tokenised(
    docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, split_words: bool = True,
    id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True,
) -> DataFrame:
    """``doc_id, piece, start, length, ids, ids_crc32``: each document's ids with the end id, cut into pieces of ``capacity``.

    ``ids`` holds little-endian unsigned 32-bit ids; it is null without ``with_ids``.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(path, split_words)
        end, step = np.array([end_id], "<u4").tobytes(), 4 * capacity
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = words.encode(text.as_py() or "") + end
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    rows.append((doc_id, k, at // 4, len(part) // 4, part if with_ids else None, zlib.crc32(part)))
            cols = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
            names = ["doc_id", "piece", "start", "length", "ids", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(cut, PIECES + ", ids_crc32 long")


def plan_slots(histogram: Iterable[tuple[int, int]], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over ``(length, count)``: ``(length, first_rank, n, per_sequence, first_sequence, offset)``.

    Ranks ``first_rank .. first_rank + n - 1`` of the length fill sequences from ``first_sequence``
    on, ``per_sequence`` to each, the first at ``offset``. Equally filled sequences form one class
    ``[first, count]``; a class moves as a whole while pieces last.
    """
    free: dict[int, list[list[int]]] = {}  # room left -> classes of sequences
    rooms: list[int] = []  # its keys, ascending
    slots, opened = [], 0

    def put(room: int, first: int, count: int) -> None:
        if room and count:
            if room not in free:
                bisect.insort(rooms, room)
                free[room] = []
            free[room].append([first, count])

    for length, left in sorted(histogram, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} ids does not fit {capacity}")
        rank = 0
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, count = free[room].pop()
                if not free[room]:
                    del free[room], rooms[at]
            else:  # as many new sequences as the rest can fill; the classes above take none of them
                room, first, count = capacity, opened, -(-left // (capacity // length))
                opened += count
            each = room // length
            full = min(count, left // each)
            if full:
                slots.append((length, rank, full * each, each, first, capacity - room))
                rank, left = rank + full * each, left - full * each
                put(room - each * length, first, full)
                first, count = first + full, count - full
            if count and left:  # fewer than one sequence's worth
                slots.append((length, rank, left, left, first, capacity - room))
                put(room - left * length, first, 1)
                rank, left, first, count = rank + left, 0, first + 1, count - 1
            if room < capacity:
                put(room, first, count)
    return slots


def best_fit(pieces: DataFrame, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """``pieces`` (with a ``length``) plus ``sequence_id`` and ``offset``.

    ``pieces`` is read three times, so pass a stored table. Rows are put in the order of a hash of
    all their columns, so lost tasks come out the same; equal rows are interchangeable.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    slots = spark.createDataFrame(
        plan_slots(counts.items(), capacity), "length long, first_rank long, n long, each long, first_sequence long, offset0 long"
    )
    blocks = spark.createDataFrame([(k, -(-n // block)) for k, n in counts.items()], "length long, blocks long")
    rows = pieces.select(F.struct("*").alias("row"), "length", F.xxhash64(*pieces.columns).alias("order"))
    # Both tables are bounded by the capacity, not by the documents.
    rows = rows.join(F.broadcast(blocks), "length").withColumn("block", F.pmod("order", "blocks"))
    per_block = rows.groupBy("length", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_block.select("length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start0"))
    inside = Window.partitionBy("length", "block").orderBy("order")
    ranked = rows.withColumn("rn", F.row_number().over(inside) - 1).join(starts, ["length", "block"])
    ranked = ranked.withColumn("rank", F.col("start0") + F.col("rn")).select("row", "length", "rank")
    after = F.col("rank") - F.col("first_rank")
    placed = ranked.join(F.broadcast(slots), "length").where((after >= 0) & (after < F.col("n")))
    return placed.select(
        "row.*",
        (F.col("first_sequence") + F.floor(after / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("offset0") + after % F.col("each") * F.col("length")).cast("long").alias("offset"),
    )


def sequences(placed: DataFrame) -> DataFrame:
    """``sequence_id, n_ids, ids``: the packed sequences themselves; a sequence holds at most the capacity."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    ids = F.aggregate(parts, F.lit(b""), lambda joined, p: F.concat(joined, p["ids"]))
    return placed.groupBy("sequence_id").agg(F.sum("length").alias("n_ids"), ids.alias("ids"))


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Tokenise and pack: ``doc_id, piece, start, length, ids, ids_crc32, sequence_id, offset``."""
    return best_fit(stored(tokenised(docs, path, capacity, with_ids=with_ids), "pieces"), capacity)
