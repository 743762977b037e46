"""From raw documents to packed training sequences: five stages, each over all rows that the one before kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next stage's ``docs``. All but
the last return the columns of ``docs``.

1. quality rules: documents that the rules reject go;
2. line dedup: lines common to three documents and more stay in one of them;
3. near dedup: one document of each group of near copies stays;
4. source mixing: documents repeat so that tokens by language meet the target weights; none is lost;
5. packing: all documents become sequences of at most 4096 tokens.

Defined results: empty tables pass through all stages; null texts fail the quality rules;
extra columns travel along until the packing, which returns its own columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from passagemill.llm import line_dedup, mixing, near_dedup, packing, quality, queries
from passagemill.llm.common import stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.stage(docs)


def line_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.stage(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.stage(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.stage(docs, queries.table(spark, sf_dir, "labels"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(docs, queries.tokenizer_path())
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_duplicates),
    ("near_dedup", near_duplicates),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: Near-duplicate classes and tokenizer ids are beyond SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
