"""Line deduplication against levelled sorted runs of line hashes.

The state is a small log-structured store. Every batch of documents is reduced to one
row per line key (two hashes, the number of documents holding it, the largest document
id), merge-joined with the runs that earlier batches left, and written as a new sorted
run of level 0. When a level holds ``fan_in`` runs they are merged into one run of the
next level, so a table of b batches keeps O(log b) runs. A run row holds running totals,
hence merging runs is a maximum per key and never adds anything twice.

Only hashes and ids move between machines while the runs are built; the texts are
shuffled once, at the end, to meet the list of keys each document loses. Native
expressions only.

Defined results: a null or empty text is one empty line; every row is a document of its
own when documents are counted, also when an id repeats; rows that share the largest id
all keep the line; a null id is smaller than any other. Extra columns are untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill.llm.common import delete_path, hash_pair, shared_path, stored

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "h1 long, h2 long, n long, last_id long"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else.

    The built-in ``lower`` gives the same unless the text has another capital or title-case letter.
    """
    other = text.rlike(r"[\p{javaUpperCase}\p{javaTitleCase}&&[^A-Z]]")
    return F.when(other, F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def keys_of(text: Column) -> Column:
    """The key of each line, in order: blanks stripped, A-Z lower-cased."""
    return F.transform(lines_of(ascii_lower(text)), lambda line: F.btrim(line, F.lit(BLANKS)))


def key_rows(docs: DataFrame, doc_id: Column, text: Column, min_chars: int) -> DataFrame:
    """``h1, h2, id, text_hash``: one row per document and distinct key of at least ``min_chars`` code points."""
    keys = F.array_distinct(F.filter(keys_of(text), lambda key: F.length(key) >= min_chars))
    rows = docs.select(doc_id.cast("long").alias("id"), F.xxhash64(text).alias("text_hash"), F.explode(keys).alias("key"))
    h1, h2 = hash_pair(F.col("key"))
    return rows.select(h1.alias("h1"), h2.alias("h2"), "id", "text_hash")


class LineRuns:
    """Runs of line keys in levels: ``levels[i]`` lists the paths of the sorted runs of level i."""

    def __init__(self, spark: SparkSession, fan_in: int = 2, levels: list[list[str]] | None = None) -> None:
        self.spark, self.fan_in = spark, fan_in
        self.levels: list[list[str]] = levels or []

    def read(self) -> DataFrame:
        """``h1, h2, n, last_id``: one row per key with its totals so far."""
        return _totals(self._rows([path for level in self.levels for path in level]))

    def unseen(self, keys: DataFrame) -> DataFrame:
        """The rows of ``keys`` (``h1, h2, ...``) whose key no run holds: a merge anti-join."""
        return keys.join(self.read().hint("merge"), ["h1", "h2"], "left_anti")

    def add(self, keys: DataFrame) -> None:
        """Add the ``h1, h2, id`` rows of a new batch as a run of level 0, then compact full levels.

        The batch is merge-joined with the runs; a key without a partner is one that the anti-join
        keeps and enters with the batch's own totals, any other enters with its new running totals.
        """
        own = keys.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("id").alias("last_id"))
        if self.levels:
            before = self.read().select("h1", "h2", F.col("n").alias("n0"), F.col("last_id").alias("id0"))
            both = own.join(before.hint("merge"), ["h1", "h2"], "left")
            own = both.select(
                "h1", "h2", (F.col("n") + F.coalesce("n0", F.lit(0))).alias("n"), F.greatest("last_id", "id0").alias("last_id")
            )
        self._write(own, 0)
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fan_in:
            old = self.levels[level]
            self._write(_totals(self._rows(old)), level + 1)
            self.levels[level] = []
            for path in old:
                delete_path(self.spark, path)
            level += 1

    def _rows(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(RUN).parquet(*paths) if paths else self.spark.createDataFrame([], RUN)

    def _write(self, rows: DataFrame, level: int) -> None:
        path = shared_path(self.spark, f"line-run-{level}")
        rows.sortWithinPartitions("h1", "h2").write.parquet(path)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)


def _totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy("h1", "h2").agg(F.max("n").alias("n"), F.max("last_id").alias("last_id"))


def build_runs(docs: DataFrame, batches: int, min_chars: int, fan_in: int = 2, id_col: str = "doc_id", text_col: str = "text") -> LineRuns:
    """Runs over all rows of ``docs``, taken in ``batches`` batches by a hash of the id."""
    runs = LineRuns(docs.sparkSession, fan_in)
    for batch in range(batches):
        part = docs.where(F.pmod(F.xxhash64(id_col), F.lit(batches)) == batch) if batches > 1 else docs
        runs.add(key_rows(part, F.col(id_col), F.col(text_col), min_chars))
    return runs


def dedup_lines(
    docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 3, fan_in: int = 2,
    id_col: str = "doc_id", text_col: str = "text", runs: LineRuns | None = None,
) -> DataFrame:
    """``doc`` (the whole input row as a struct), ``n_lines``, ``n_dropped``, ``kept_text``.

    Keys of at least ``min_chars`` code points in at least ``min_docs`` documents lose all
    their lines except those of the largest id. Pass ``runs`` to hold the documents against
    a store that already covers them.
    """
    runs = runs or build_runs(docs, batches, min_chars, fan_in, id_col, text_col)
    # A table of its own, so that Spark can split the partition of a line that very many documents share.
    common = stored(runs.read().where(F.col("n") >= min_docs), "common-lines")
    held = key_rows(docs, F.col(id_col), F.col(text_col), min_chars)
    lost = held.join(common, ["h1", "h2"]).where(~F.col("id").eqNullSafe(F.col("last_id")))
    # By id and text, so that a list is of one text's lines, however many rows share an id or have none.
    lost = lost.groupBy("id", "text_hash").agg(F.collect_set(F.struct("h1", "h2")).alias("lost"))
    lost = lost.select(F.col("id").alias("lost_id"), F.col("text_hash").alias("lost_hash"), "lost")
    rows = docs.select(F.struct("*").alias("doc"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    rows = rows.join(lost, F.col("id").eqNullSafe(F.col("lost_id")) & (F.col("text_hash") == F.col("lost_hash")), "left")

    def stays(line: Column) -> Column:
        key = F.btrim(ascii_lower(line), F.lit(BLANKS))
        h1, h2 = hash_pair(key)
        return (F.length(key) < min_chars) | ~F.array_contains(F.col("lost"), F.struct(h1.alias("h1"), h2.alias("h2")))

    lines = lines_of(F.col("text"))
    kept = F.when(F.col("lost").isNotNull(), F.filter(lines, stays))
    rows = rows.select("doc", "text", F.size(lines).cast("long").alias("n_lines"), kept.alias("kept"))
    dropped = F.coalesce(F.col("n_lines") - F.size("kept"), F.lit(0)).cast("long")
    text = F.when(F.col("kept").isNotNull(), F.array_join("kept", "\n")).otherwise(F.coalesce("text", F.lit("")))
    return rows.select("doc", "n_lines", dropped.alias("n_dropped"), text.alias("kept_text"))


def stage(docs: DataFrame) -> DataFrame:
    """Documents with their kept lines only; all columns as they came."""
    out = dedup_lines(docs)
    changed = F.when(F.col("n_dropped") > 0, F.col("kept_text")).otherwise(F.col("doc.text"))
    return out.select(*[changed.alias(c) if c == "text" else F.col("doc")[c].alias(c) for c in docs.columns])
