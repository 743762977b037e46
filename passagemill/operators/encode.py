"""Batch scoring seams: vectors and pair scores come from models the caller supplies.

The built-in hashing encoder and coverage scorer are deterministic and need no
model files. They exercise the pipeline; they say nothing about retrieval quality.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagemill.functions.judging import label_score
from passagemill.functions.tokens import TOKEN, coverage, tokenize

Encoder = Callable[[list[str]], np.ndarray]
HELD_TEXTS = 384  # texts that a task holds as Python strings at a time


def hashing_encoder(dim: int = 64) -> Encoder:
    """Signed feature hashing of tokens by md5, scaled to unit length."""
    token = re.compile(TOKEN)

    @lru_cache(maxsize=20_000)  # the frequent words; a rare one costs a digest
    def slot(word: str) -> tuple[int, int]:
        digest = hashlib.md5(word.encode()).hexdigest()
        return int(digest[:8], 16) % dim, 1 - 2 * (int(digest[8:16], 16) % 2)

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for row, text in zip(out, texts):
            for word in token.findall((text or "").lower()):
                at, sign = slot(word)
                row[at] += sign
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms == 0, 1.0, norms)

    return encode


def encode(
    df: DataFrame,
    keys: list[str],
    text: str,
    encoder: Callable[[], Encoder] = hashing_encoder,
    batch_size: int = 12,
) -> DataFrame:
    """``keys, embedding``: every row's text through the encoder in batches, with no shuffle.

    ``encoder`` is called once per task and returns the function that maps a list of
    texts to a matrix, so a model is loaded where it runs.
    """
    schema = T.StructType([*[df.schema[k] for k in keys], T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder()
        held = batch_size * max(1, HELD_TEXTS // batch_size)
        for batch in batches:
            for at in range(0, batch.num_rows, held):
                # Only these texts are Python strings; the others of the batch stay in Arrow's form.
                part = batch.slice(at, held)
                texts = part.column(len(keys)).to_pylist()
                made = [np.asarray(model(texts[i : i + batch_size]), dtype="float32") for i in range(0, len(texts), batch_size)]
                ends = np.cumsum([0, *(len(v) for m in made for v in m)])
                vectors = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), np.concatenate([m.ravel() for m in made]))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], vectors], schema.names)

    return df.select(*keys, text).mapInArrow(run, schema)


def encode_distinct(df: DataFrame, text: str, encoder: Callable[[], Encoder] = hashing_encoder) -> DataFrame:
    """``text_key, embedding`` with every different text encoded once; ``text_key`` is its md5."""
    keyed = df.select(F.md5(F.encode(text, "UTF-8")).alias("text_key"), F.col(text).alias("_text"))
    # Any copy will do: equal keys are equal texts. Combines before the shuffle, so copies cost nothing.
    return encode(keyed.groupBy("text_key").agg(F.first("_text").alias("_text")), ["text_key"], "_text", encoder)


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 when either has no length."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / norms)


def coverage_scorer(query: Column, passage: Column) -> Column:
    """Built-in pair scorer: share of the query's tokens found in the passage."""
    return coverage(tokenize(query), tokenize(passage))


def entailment_summary(claims: DataFrame, keys: list[str], outputs: str) -> DataFrame:
    """Mean entailment and contradiction over the claims of an answer, and the consistency score."""
    scored = claims.select(
        *keys, label_score(F.col(outputs), "entail").alias("_e"), label_score(F.col(outputs), "contrad").alias("_c")
    )
    means = scored.groupBy(*keys).agg(F.avg("_e").alias("nli_entailment"), F.avg("_c").alias("nli_contradiction"))
    return means.withColumn("fact_consistency", F.col("nli_entailment") * (1 - F.col("nli_contradiction")))
