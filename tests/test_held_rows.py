"""How many rows a task holds as Python objects, and that nothing is lost between its batches."""

import io
import zipfile

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from passagemill.functions import rowwise
from passagemill.operators import chunkers, encode
from passagemill.registry import streams
from passagemill.sources import archives, files


def _packed(*texts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i, text in enumerate(texts):
            z.writestr(f"{i}.txt", text)
    return out.getvalue()


def test_members_share_batches():
    raws = [_packed(f"a{i}", f"b{i}") for i in range(300)] + [_packed("x" * archives.HELD, "y" * archives.HELD, "z")]
    batch = pa.RecordBatch.from_arrays([pa.array([f"{i}.zip" for i in range(len(raws))]), pa.array(raws)], ["path", "content"])
    made = list(archives._unzip(iter([batch])))
    assert [b.num_rows for b in made] == [601, 1, 1]
    assert [t[:2] for b in made for t in b.column(3).to_pylist()] == [f"{c}{i}"[:2] for i in range(300) for c in "ab"] + ["xx", "yy", "z"]
    assert [p for b in made for p in b.column(1).to_pylist()] == [0, 1] * 300 + [0, 1, 2]


class _Frame:
    """Hands back the function that a task would run."""

    def __init__(self, df):
        self.schema = df.schema

    def select(self, *_):
        return self

    def mapInArrow(self, run, schema):
        return run


def test_encoder_gets_some_texts_at_a_time(spark):
    run = encode.encode(_Frame(spark.createDataFrame([], "id long, text string")), ["id"], "text", batch_size=7)
    texts = [None if i % 11 == 0 else f"w{i} w{i % 3}" for i in range(1000)]
    made = list(run(iter([pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(texts)], ["id", "text"])])))
    assert max(b.num_rows for b in made) <= encode.HELD_TEXTS and len(made) == 3
    assert [i for b in made for i in b.column(0).to_pylist()] == list(range(1000))
    got = np.array([v for b in made for v in b.column(1).to_pylist()])
    assert np.array_equal(got, encode.hashing_encoder()(texts).astype("float32"))


def test_encoder_in_spark_keeps_keys_and_nulls(spark):
    rows = [(i, None if i % 5 == 0 else f"word{i}", [f"k{i}"]) for i in range(900)]
    out = encode.encode(spark.createDataFrame(rows, "id long, text string, more array<string>").coalesce(1), ["more", "id"], "text")
    want = encode.hashing_encoder()([r[1] for r in rows]).astype("float32")
    assert out.columns == ["more", "id", "embedding"] and out.count() == 900
    for r in out.collect():
        assert r["more"] == [f"k{r['id']}"] and np.array_equal(np.array(r["embedding"], "float32"), want[r["id"]])


def test_values_leave_as_they_are_made():
    raw = ["日记".encode("gbk"), None, b""] * 300
    made = list(files._decode_gbk.func(iter([pa.array(raw, pa.binary())])))
    assert max(map(len, made)) <= rowwise.ROWS and [t for m in made for t in m.to_pylist()] == ["日记", None, ""] * 300
    blocks = list(chunkers.layout_blocks.func(iter([pa.array(['[[{"type": "title", "content": {"level": 2, "x": "a"}}]]', "{", None] * 200)])))
    assert max(map(len, blocks)) <= rowwise.ROWS
    one = [{"page": 1, "kind": "title", "level": 2, "text": "2 a", "html": None}]
    assert [b for m in blocks for b in m.to_pylist()] == [one, [], []] * 200
    sections = list(chunkers.layout_sections.func(iter([pa.array([[{"page": 3, "kind": "text", "level": 0, "text": "b", "html": None}]] * 600, chunkers._LAYOUT_BLOCKS)])))
    assert max(map(len, sections)) <= rowwise.ROWS
    assert [s for m in sections for s in m.to_pylist()] == [[{"heading": "", "texts": ["b"], "pages": [3]}]] * 600


@pytest.mark.parametrize("n", [0, 1, 700])
def test_rows_stay_together_in_spark(spark, n):
    docs = spark.range(n).select("id", F.concat(F.lit("t"), "id").alias("text"), F.concat(F.lit("s"), "id").alias("source")).coalesce(1)
    made = docs.select(F.concat("id", F.lit(".zip")).alias("path"), streams._zipped("text", "source").alias("content"))
    got = {r["path"]: r["text"] for r in archives.archive_texts(archives.archive_members(made)).collect()}
    assert got == {f"{i}.zip": f"t{i}\n\ns{i}" for i in range(n)}
