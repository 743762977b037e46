"""Near-duplicate documents by ProbMinHash signatures, banding and exact verification.

A document is a set of shingles of five words. ProbMinHash lets the shingles of a document
arrive as Poisson processes whose rates are their weights; every arrival draws one of
``registers`` registers, which keeps the shingle that arrived first. A document is done as
soon as the next arrival of each shingle is later than the fullest register, so it costs
about n + k ln k arrivals and not n k. Two registers agree with the probability Jaccard
similarity of the documents. Every distinct shingle has the weight 1, however often it
occurs, so that this is the Jaccard similarity which the rule is about; weights by counts
would hide pairs whose differing shingles repeat. Equal band hashes make candidates. Pairs with a leader
are first held against an estimate by two bits of each register; all pairs that are left are held
against the exact Jaccard similarity of their shingle sets (``threshold``, 0.8 or more).

Large groups. Byte-equal texts become one node first. In a bucket of equal band hashes
every member is compared with one leader, that which shares buckets with most documents, so
n near copies fall into one class by about n comparisons. In a bucket whose other members
are still of two classes, those outside the largest class are looked for partners among the members of
other classes, by the rare shingles with which their sets begin in one common order
(``overlapping_prefixes``): two members of a bucket are in one class, or have been held
against each other, or cannot be similar. Nothing is dropped or capped. Classes
are the connected components of the verified links, found by alternating large-star and
small-star contraction on stored tables.

Defined results: words are separated by ASCII white space and compared in lower case; a
text of one to four words is one shingle; texts without any word (null, empty, blank) are
only alike if they are byte-equal, a null counting as empty; a document without id takes
a hash of its text in place of the id; rows that share an id are one document. The class
id is the smallest id of the class. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagemill.llm.common import delete_path, hash_pair, shared_path, stored

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 26, 5  # a pair at 0.8 shares no band with probability (1 - 0.8^5)^26 = 3e-5
LINKS = "a long, b long, similarity double"
#: Shingles signed at a time, which bounds a task's memory.
CHUNK = 150_000

STEP = 0x9E3779B97F4A7C15
GOLD = np.uint64(STEP)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: well-spread 64-bit numbers from counters."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Shingle hashes of texts; remembers the hashes of words."""

    def __init__(self, words: int = WORDS, remembered: int = 500_000) -> None:
        self.words, self.remembered, self.known = words, remembered, {}
        self.factors = mix(np.arange(1, words + 1, dtype=np.uint64) * GOLD) | np.uint64(1)

    def __call__(self, text: str | None) -> np.ndarray:
        """One hash per shingle, in order."""
        words = (text or "").lower().encode("utf-8", "surrogatepass").split()
        if not words:
            return np.empty(0, np.uint64)
        known = self.known
        if len(known) > self.remembered:
            known.clear()
        for word in set(words).difference(known):
            known[word] = xxhash.xxh64_intdigest(word)
        hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = max(1, len(words) - self.words + 1)
        total = np.zeros(n, np.uint64)
        for j, factor in enumerate(self.factors[: min(self.words, len(words))]):
            total += hashes[j : j + n] * factor
        return mix(total)


def signatures(shingles: list[np.ndarray], weights: list[np.ndarray], k: int) -> np.ndarray:
    """The ProbMinHash signature of each weighted set: ``(sets, k)`` shingle hashes, 0 for an empty set."""
    sets = len(shingles)
    element, weight = np.concatenate(shingles), np.concatenate(weights)
    owner = np.repeat(np.arange(sets), [len(s) for s in shingles])
    first, winner = np.full(sets * k, np.inf), np.zeros(sets * k, np.uint64)
    time, arrival = np.zeros(len(element)), 0
    while len(element):
        arrival += 1
        odd, even = (np.uint64(STEP * n & 0xFFFFFFFFFFFFFFFF) for n in (2 * arrival - 1, 2 * arrival))
        draw = mix(element + odd)
        uniform = ((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
        time = time - np.log(uniform) / weight
        place = owner * k + (mix(element + even) % np.uint64(k)).astype(np.int64)
        np.minimum.at(first, place, time)
        won = time == first[place]
        winner[place[won]] = element[won]
        # A shingle whose last arrival is later than every register of its set can change nothing any more.
        still = time < first.reshape(sets, k).max(1)[owner]
        element, weight, owner, time = element[still], weight[still], owner[still], time[still]
    return winner.reshape(sets, k)


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """``(sets, bands)`` hashes; the number of the band is part of the hash."""
    parts = signature[:, : bands * rows].reshape(len(signature), bands, rows)
    factors = mix(np.arange(1, rows + 1, dtype=np.uint64) * GOLD) | np.uint64(1)
    return mix((parts * factors).sum(2, dtype=np.uint64) + np.arange(1, bands + 1, dtype=np.uint64) * GOLD).view(np.int64)


SKETCHED = 32  # registers in one 64-bit number of a sketch, two bits of each


def sketches(signature: np.ndarray) -> np.ndarray:
    """Two bits of each register, packed into 64-bit numbers; registers that do not fill a number are left out."""
    n = signature.shape[1] // SKETCHED * SKETCHED
    bits = (mix(signature[:, :n]) & np.uint64(3)).reshape(len(signature), -1, SKETCHED)
    return (bits << (2 * np.arange(SKETCHED)).astype(np.uint64)).sum(2, dtype=np.uint64).view(np.int64)


def sketch_matches(a: Column, b: Column, registers: int) -> Column:
    """How many registers agree in both bits."""
    numbers = registers // SKETCHED
    odd = F.lit(0x5555555555555555)

    def differ(x: Column) -> Column:
        return F.bit_count((x.bitwiseOR(F.shiftrightunsigned(x, 1))).bitwiseAND(odd))

    unlike = sum((differ(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(numbers)), F.lit(0))
    return SKETCHED * numbers - unlike


def least_matches(threshold: float, registers: int, deviations: float = 3.7) -> int:
    """Matches that a pair at the threshold has but for a chance of 1e-4."""
    n = registers // SKETCHED * SKETCHED
    p = threshold + (1 - threshold) / 4
    return int(n * p - deviations * (n * p * (1 - p)) ** 0.5)


def _signed(bands: int, rows: int, words: int):
    """Arrow batches ending in ``text`` to the same columns without it and ``bands, size, sketch``."""
    k = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            texts, at = batch.column(batch.num_columns - 1), 0
            while at < batch.num_rows:
                begin, sets, held = at, [], 0
                while at < batch.num_rows and held < CHUNK:
                    values = np.unique(shingler(texts[at].as_py()))
                    sets.append(values)
                    held, at = held + len(values), at + 1
                sig = signatures(sets, [np.ones(len(s)) for s in sets], k)
                kept = [batch.column(i).slice(begin, at - begin) for i in range(batch.num_columns - 1)]
                names = batch.schema.names[:-1]
                hashes = band_hashes(sig, bands, rows)
                made = pa.array([h if len(s) else [] for h, s in zip(hashes, sets)], pa.list_(pa.int64()))
                sizes = pa.array([len(s) for s in sets], pa.int64())
                sketch = pa.array(list(sketches(sig)), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*kept, made, sizes, sketch], [*names, "bands", "size", "sketch"])

    return run


def _shingled(words: int):
    """Arrow batches of ``id, text`` to ``id, size, shingles``: the sorted distinct shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            sets = [np.unique(shingler(text.as_py())) for text in batch.column("text")]
            made = [pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *made], ["id", "size", "shingles"])

    return run


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``id, size, shingles`` to one row ``id, size, token`` for each shingle."""
    for batch in batches:
        sets = [np.frombuffer(s.as_py(), np.int64) for s in batch.column("shingles")]
        for begin in range(0, len(sets), 256):
            some = sets[begin : begin + 256]
            n = [len(s) for s in some]
            ids, sizes = (np.repeat(batch.column(c).to_numpy()[begin : begin + 256], n) for c in ("id", "size"))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(sizes), pa.array(np.concatenate(some))], ["id", "size", "token"])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The exact Jaccard similarity of pairs of shingle sets."""
    for batch in batches:
        exact = []
        for x, y in zip(batch.column("shingles_a"), batch.column("shingles_b")):
            x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            exact.append(both / max(1, len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(exact, pa.float64())], ["a", "b", "similarity"])


def with_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc`` (the row), ``id, h1, h2, text``: the id, or a hash of the text where it is null, and two hashes of the text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    h1, h2 = hash_pair(text)
    rows = docs.select(F.struct("*").alias("doc"), F.col(id_col).cast("long").alias("given"), text.alias("text"), h1.alias("h1"), h2.alias("h2"))
    return rows.select("doc", F.coalesce("given", "h1").alias("id"), "h1", "h2", "text")


def verified_pairs(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``a, b, similarity`` of pairs of ids; ``texts`` holds ``id, shingles``."""
    left = texts.select(F.col("id").alias("a"), F.col("shingles").alias("shingles_a"))
    right = texts.select(F.col("id").alias("b"), F.col("shingles").alias("shingles_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "shingles_a", "shingles_b").mapInArrow(_compared, LINKS)


def overlapping_prefixes(members: DataFrame, texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``a, b``: pairs of different roots of which one is loose, without losing any that is similar.

    ``members`` is ``id, root, loose`` (one row an id), ``texts`` holds ``id, size, shingles``. All sets are put in one order,
    rare shingles first. Similar sets x and y have ``need = ceil(t / (1 + t) (|x| + |y|))``
    shingles in common, and all of them stand at or after the first common one, so in both sets
    at least ``need`` places are left there. Hence the first common shingle is among the first
    ``|x| - ceil(t |x|) + 1`` of either, and in the smaller set (in both, if equal) among the
    first ``|x| - ceil(2 t / (1 + t) |x|) + 1``, its head. Shingles that only one member has
    count as places and take part in nothing.
    """
    rows = texts.join(members.select("id"), "id").select("id", "size", "shingles").mapInArrow(_shingle_rows, "id long, size long, token long")
    rows = stored(rows, "shingle-rows")
    counts = stored(rows.groupBy("token").agg(F.count("*").alias("n")).where("n > 1"), "shared-shingles")
    held = rows.join(counts, "token").groupBy("id", "size").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("tokens"))
    unshared = F.col("size") - F.size("tokens")
    # Rounding in floating point must not cut a place off, hence the small amount taken away before rounding up.
    up = lambda c: F.ceil(c - 1e-9)
    head, prefix = (F.col("size") - up(F.col("size") * t) + 1 for t in (2 * threshold / (1 + threshold), threshold))
    first = F.slice("tokens", F.lit(1), F.greatest(F.lit(0), prefix - unshared).cast("int"))
    placed = held.join(members, "id").select("id", "size", "root", "loose", unshared.alias("unshared"), head.alias("head"), F.posexplode(first).alias("at", "shingle"))
    place = F.col("unshared") + F.col("at")
    placed = placed.select("id", "size", "root", "loose", F.col("shingle.token").alias("token"), place.alias("place"), (place < F.col("head")).alias("in_head"))
    # The first common shingle is in the head of one of the two: heads meet heads (0), loose heads tails (1), loose tails heads (2).
    meets = lambda tails, heads: F.explode(F.when(F.col("in_head"), F.array(F.lit(0), F.lit(heads))).otherwise(F.array(F.lit(tails)))).alias("meets")
    loose = placed.where("loose").select("token", meets(2, 1), *[F.col(c).alias(f"{c}0") for c in ("id", "root", "size", "place")])
    every = placed.select("token", meets(1, 2), "id", "root", "size", "place", "loose")
    need = up((F.col("size") + F.col("size0")) * (threshold / (1 + threshold)))
    fits = F.least(F.col("size") - F.col("place"), F.col("size0") - F.col("place0")) >= need
    once = ~F.col("loose") | (F.col("id") < F.col("id0"))
    # Both sides are stored, so that Spark can split large partitions of either.
    pairs = stored(every, "prefixes").join(stored(loose, "loose-prefixes"), ["token", "meets"]).where((F.col("root") != F.col("root0")) & once & fits)
    return pairs.select(F.least("id", "id0").alias("a"), F.greatest("id", "id0").alias("b")).distinct()


def similar_links(
    base: DataFrame, nodes: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, words: int = WORDS,
) -> DataFrame:
    """``a, b, similarity``: verified links from ``nodes`` (``id, bands, size, sketch``) and ``base`` (``id, text``).

    First the members of a bucket are compared with its leader. Then, where the others of a bucket are in
    several classes, those outside the largest class are compared with all members of other
    classes. So the result has every link that joins classes but not every pair inside one.
    """
    spark, registers, matches = base.sparkSession, bands * rows, least_matches(threshold, bands * rows)
    dropped: list[str] = []

    def kept(rows_: DataFrame, name: str) -> DataFrame:
        path = shared_path(spark, name)
        dropped.append(path)
        return stored(rows_, name, path)

    each = nodes.select(F.explode("bands").alias("bucket"), "id")
    sizes = kept(each.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > 1), "bucket-sizes")
    shared = kept(each.join(sizes, "bucket"), "shared-buckets")
    if shared.isEmpty():
        return spark.createDataFrame([], LINKS)
    # Who shares buckets with most others leads: the text that many copies were made from is like them all,
    # while two copies may be less like each other.
    company = shared.groupBy("id").agg(F.sum(F.col("n") - 1).alias("company"))
    order = -F.col("company") * 1_048_576 + F.pmod(F.xxhash64("bucket", "id"), F.lit(1_048_576))
    buckets = kept(shared.join(company, "id").select("bucket", "id", order.alias("order")), "bucket-members")
    wanted = base.join(buckets.select("id").distinct(), "id", "left_semi").select("id", "text")
    texts = kept(wanted.mapInArrow(_shingled(words), "id long, size long, shingles binary"), "candidate-shingles")

    # A table of its own, so that Spark can split the partition of a very large bucket.
    leaders = buckets.groupBy("bucket").agg(F.min(F.struct("order", "id"))["id"].alias("id0"))
    leaders = kept(leaders, "bucket-leaders")
    others = kept(buckets.join(leaders, "bucket").where("id <> id0").select("bucket", "id", "id0"), "bucket-others")
    pairs = others.select(F.least("id", "id0").alias("a"), F.greatest("id", "id0").alias("b")).distinct()
    # Sets whose sizes differ by more cannot be similar: the smaller would have to hold `threshold` of the larger.
    near = (F.col("size_a") >= threshold * F.col("size_b")) & (F.col("size_b") >= threshold * F.col("size_a"))
    near = near & (sketch_matches(F.col("sketch_a"), F.col("sketch_b"), registers) >= matches)
    for side in "ab":
        pairs = pairs.join(nodes.select(F.col("id").alias(side), F.col("size").alias(f"size_{side}"), F.col("sketch").alias(f"sketch_{side}")), side)
    pairs = kept(pairs.where(near).select("a", "b"), "compared-with-leaders")
    led = shared_path(spark, "links")
    alike = stored(verified_pairs(pairs, texts).where(F.col("similarity") >= threshold), "links", led)

    # The leader has been held against all; the rest of a bucket is settled if it is one class.
    roots = kept(components(alike), "roots-of-leaders")
    rest = kept(others.select("bucket", "id").join(roots, "id", "left").select("bucket", "id", F.coalesce("root", "id").alias("root")), "members-with-roots")
    classes = rest.groupBy("bucket", "root").agg(F.count("*").alias("n")).groupBy("bucket")
    classes = classes.agg(F.max(F.struct("n", "root"))["root"].alias("main"), F.sum("n").alias("members"), F.max("n").alias("most")).where("most < members")
    open_ = rest.join(kept(classes.select("bucket", "main"), "open-buckets"), "bucket")
    members = kept(open_.groupBy("id", "root").agg(F.max(F.col("root") != F.col("main")).alias("loose")), "open-members")
    rest_path = shared_path(spark, "links")
    found = verified_pairs(stored(overlapping_prefixes(members, texts, threshold), "compared-with-all"), texts)
    stored(found.where(F.col("similarity") >= threshold), "links", rest_path)
    for path in dropped:
        delete_path(spark, path)
    return spark.read.schema(LINKS).parquet(led, rest_path).dropDuplicates(["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """``id, root``: the smallest id of each vertex' connected component, for all vertices of ``edges`` (``a, b``).

    Large-star links the larger neighbours of a vertex to the smallest, small-star the smaller
    ones; a few rounds leave stars. A vertex with very many neighbours only takes part in
    grouped minima and joins.
    """
    spark = edges.sparkSession

    def kept(rows: DataFrame) -> tuple[DataFrame, str]:
        path = shared_path(spark, "component-edges")
        return stored(rows.distinct(), "component-edges", path), path

    def mark(rows: DataFrame) -> tuple:
        return tuple(rows.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now, path = kept(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    seen = mark(now)
    while True:
        both = now.union(now.select("v", "u"))
        lowest = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "component-lowest")
        large = both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, "component-large")
        low = stored(large.groupBy("u").agg(F.min("v").alias("m")), "component-low")
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low)
        then, new_path = kept(small)
        is_now = mark(then)
        delete_path(spark, path)
        now, path = then, new_path
        if is_now == seen:
            return now.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("root"))
        seen = is_now


def near_duplicates(
    docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, words: int = WORDS,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``id, h1, h2, class_id``: one row per document; its id (see ``with_ids``), text hashes and class."""
    base = with_ids(docs, id_col, text_col)
    keyed = base.select("id", "h1", "h2", "text").mapInArrow(_signed(bands, rows, words), "id long, h1 long, h2 long, bands array<long>, size long, sketch array<long>")
    keyed = stored(keyed, "bands")
    copies = stored(keyed.groupBy("h1", "h2").agg(F.min("id").alias("rep")), "copies")
    members = keyed.join(copies, ["h1", "h2"])
    nodes = members.where(F.col("id") == F.col("rep")).select("id", "bands", "size", "sketch").dropDuplicates(["id", "bands"])
    links = similar_links(base, nodes, threshold, bands, rows, words)
    # One id may stand for several texts, so the copies are links as well; a text is linked to its representative only.
    own = members.where(F.col("id") != F.col("rep")).select(F.col("id").alias("a"), F.col("rep").alias("b")).distinct()
    roots = components(links.select("a", "b").union(own))
    out = keyed.select("id", "h1", "h2").join(roots, "id", "left")
    return out.select("id", "h1", "h2", F.coalesce("root", "id").alias("class_id"))


def stage(docs: DataFrame) -> DataFrame:
    """The document with the smallest id of each class; all columns as they came. Of repeated rows one stays."""
    kept = near_duplicates(docs).where(F.col("id") == F.col("class_id")).groupBy("id").agg(F.min(F.struct("h1", "h2")).alias("text_hash"))
    rows = with_ids(docs).join(kept, "id").where(F.struct("h1", "h2") == F.col("text_hash")).select("id", "doc")
    return rows.dropDuplicates(["id"]).select("doc.*")
