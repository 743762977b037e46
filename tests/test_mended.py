"""Cases in which rows were once lost, merged or numbered twice."""

import io
import math
import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from passagemill.operators import catalogue, chat, index, stats
from passagemill.sources import archives, files
from passagemill.streaming import upkeep

T0 = datetime(2024, 1, 1)


def test_history_keeps_every_message_that_fits(spark):
    rows = [("c", i, T0 + timedelta(seconds=37 * i), "user", "x") for i in range(600)]
    messages = spark.createDataFrame(rows, "conversation_id string, id long, created_at timestamp, role string, content string")
    cost = chat.history_within(messages, spark.createDataFrame([("c", 10**6)], "conversation_id string, budget long")).agg(F.max("cost")).first()[0]
    for budget in (10_000, 300 * cost, cost - 1):
        kept = chat.history_within(messages, spark.createDataFrame([("c", budget)], "conversation_id string, budget long")).collect()
        fit = min(600, budget // cost)
        assert sorted(r["id"] for r in kept) == list(range(600 - fit, 600))


def test_two_streams_do_not_hide_each_other(spark, tmp_path):
    schema = "seq long, op string, source string, headings string, category string, version string, text string"
    held = upkeep.ChangingIndex(spark, str(tmp_path / "index"))
    for name in ("a", "b"):
        spark.createDataFrame([(1, "upsert", f"{name}.md", "h", "c", "v", f"text of {name}")], schema).write.parquet(str(tmp_path / name))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / name))
        upkeep.follow(stream, held, str(tmp_path / f"state-{name}")).awaitTermination()
    assert {r["source"] for r in held.read().collect()} == {"a.md", "b.md"}
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "a"))
    upkeep.follow(stream, held, str(tmp_path / "state-a")).awaitTermination()  # nothing new
    assert held.read().count() == 2


@pytest.mark.parametrize(
    "chunks, vectors",
    [([(1, "a"), (2, "b")], [(1, [1.0])]), ([(1, "a")], [(1, [1.0]), (2, [1.0])]), ([(1, "a"), (1, "b")], [(1, [1.0])]), ([(1, "a")], [(1, [1.0]), (1, [2.0])])],
)
def test_index_build_refuses_gaps_and_duplicates(spark, chunks, vectors):
    left = spark.createDataFrame(chunks, "vec_id long, content string")
    right = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="aligned|duplicate"):
        index.build_index(left, right).collect()


def test_refresh_never_gives_an_id_again(spark):
    now = F.lit(T0)
    chunks = "source string, title string, category string, vec_id long"
    old = catalogue.documents_of(spark.createDataFrame([("a.md", "A", "c", 0), ("b.md", "B", "c", 1)], chunks))
    empty = spark.createDataFrame([], old.schema)
    start = catalogue.upsert(_no_rows(spark, catalogue.upsert, empty, now), old, catalogue.FROM_INDEX, now)
    ids = {r["source"]: r["id"] for r in start.collect()}
    new = catalogue.documents_of(spark.createDataFrame([("c.md", "C", "c", 0)], chunks))
    after = {r["source"]: r["id"] for r in catalogue.refresh(start, new, now).collect()}
    assert set(after) == {"c.md"} and after["c.md"] > max(ids.values())


def _no_rows(spark, upsert, empty, now):
    kinds = {"id": "long", "created_at": "timestamp", "updated_at": "timestamp", "is_deleted": "boolean", "tags": "array<string>", "updated_by": "long"}
    return spark.createDataFrame([], ", ".join(f"{c} {kinds.get(c, 'string')}" for c in catalogue.COLUMNS))


def test_archives_of_one_name_stay_apart(spark):
    def packed(text):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("a.txt", text)
        return out.getvalue()

    made = spark.createDataFrame([("a/x.zip", packed("one")), ("b/x.zip", packed("two"))], "path string, content binary")
    rows = archives.archive_texts(archives.archive_members(made)).collect()
    assert {(r["path"], r["archive"], r["text"]) for r in rows} == {("a/x.zip", "x.zip", "one"), ("b/x.zip", "x.zip", "two")}


def test_relative_path_starts_after_the_first_root(spark):
    rows = spark.createDataFrame([("file:/data/x/data/y.md",), ("other/z.md",)], "path string")
    got = [r[0] for r in rows.select(files.relative_to(F.col("path"), "/data")).collect()]
    assert got == ["x/data/y.md", "other/z.md"]


def test_gbk_fallback(spark):
    rows = [(1, "日记 ok".encode()), (2, "日记 ok".encode("gbk")), (3, b""), (4, None)]
    out = files.decoded(spark.createDataFrame(rows, "id int, content binary"))
    assert {r["id"]: r["text"] for r in out.collect()} == {1: "日记 ok", 2: "日记 ok", 3: "", 4: None}


@pytest.mark.parametrize("diff, t, p", [(1.0, math.inf, 0.0), (-1.0, -math.inf, 0.0)])
def test_equal_differences_are_certain(spark, diff, t, p):
    row = stats.significance(spark.createDataFrame([("m", diff)] * 10, "metric string, diff double")).first()
    assert row["t"] == t and row["p_t"] == p
