"""Snapshots, index changes, files and archives."""

import os
import zipfile

import pytest
from pyspark.sql import functions as F

from passagemill.operators import catalogue, index
from passagemill.plans import corpus
from passagemill.sources import archives, files, records, snapshots
from passagemill.streaming import upkeep

CHUNK = "source string, headings string, category string, version string, chunk_id bigint, content string, vec_id bigint, embedding array<float>"


def documents(spark, rows):
    return spark.createDataFrame(rows, "source string, headings string, category string, version string, text string")


def test_append_then_delete_gives_the_old_index(spark):
    empty = spark.createDataFrame([], CHUNK)
    first = index.append_documents(empty, documents(spark, [("a", "", "c", "", "x" * 2500), ("b", "h", "c", "", "y")]))
    rows = first.collect()
    assert sorted(r.vec_id for r in rows) == [0, 1, 2, 3]
    assert {r.headings for r in rows} == {"a", "h"}
    base = spark.createDataFrame(rows, first.schema)
    second = index.append_documents(base, documents(spark, [(" n ", "", "", "v", "new text")]))
    assert {r.vec_id for r in second.where("source = 'n'").collect()} == {4}
    gone = spark.createDataFrame([("n ",)], "source string")
    assert sorted(map(str, index.delete_sources(second, gone).collect())) == sorted(map(str, rows))


def test_bad_ids_and_dimensions_fail(spark):
    chunks = spark.createDataFrame([("s", 0, "-1")], "source string, chunk_id long, given string")
    with pytest.raises(Exception, match="at least 0"):
        index.assign_ids(chunks, explicit="given").collect()
    vectors = spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], "vec_id long, embedding array<float>")
    ids = spark.createDataFrame([(0,), (1,)], "vec_id long")
    with pytest.raises(Exception, match="dimension"):
        index.build_index(ids, vectors).collect()
    with pytest.raises(ValueError):
        index.append_pieces(F.lit("x"), 10, 10)


def test_snapshots(spark, tmp_path):
    store = snapshots.SnapshotStore(spark, str(tmp_path / "store"))
    assert store.current() is None
    with pytest.raises(FileNotFoundError):
        store.read()
    assert store.commit(spark.range(3), key="one") == 1
    assert store.commit(spark.range(5), key="two") == 2
    assert store.commit(spark.range(9), key="two") == 2
    assert (store.read().count(), store.read(1).count()) == (5, 3)
    # A snapshot that was written but never committed is not seen.
    spark.range(7).write.parquet(f"{store.root}/version=3-lost")
    assert store.read().count() == 5


def change(spark, rows):
    return spark.createDataFrame(
        [(s, op, src, "", "", "", text) for s, op, src, text in rows],
        "seq long, op string, source string, headings string, category string, version string, text string",
    )


def test_changing_index(spark, tmp_path):
    held = upkeep.ChangingIndex(spark, str(tmp_path / "live"))
    assert held.read().count() == 0
    assert held.apply(change(spark, [(1, "upsert", "a", "one"), (2, "upsert", "b", "two"), (3, "upsert", "a", "newer one")]), "k1")
    assert not held.apply(change(spark, [(1, "upsert", "z", "again")]), "k1")
    assert held.apply(change(spark, [(4, "delete", " b ", None), (5, "upsert", "c", "three")]), "k2")
    state = {r.source: (r.content, r.vec_id) for r in held.read().collect()}
    assert {s: c for s, (c, _) in state.items()} == {"a": "newer one", "c": "three"}
    assert held.compact() == 3
    assert {r.source: (r.content, r.vec_id) for r in held.read().collect()} == state
    assert held.apply(change(spark, [(6, "upsert", "d", "four")]), "k3")
    ids = [r.vec_id for r in held.read().collect()]
    assert len(set(ids)) == len(ids) == 3 and max(ids) > max(i for _, i in state.values())


def test_files(spark, tmp_path):
    root = tmp_path / "in"
    (root / "Cat" / "doc").mkdir(parents=True)
    (root / "Cat" / "doc" / "full.md").write_text("# 标题\r\n\r\n正文", encoding="utf-8")
    (root / "Cat" / "old.txt").write_bytes("高血压患者".encode("gbk"))
    (root / "a.PDF").write_bytes(b"x")
    os.utime(root / "a.PDF", (2_000_000_000, 2_000_000_000))
    texts = {r.relative_path: r.text for r in files.read_texts(spark, str(root), "*.{md,txt}").collect()}
    assert texts == {"Cat/doc/full.md": "# 标题\n\n正文", "Cat/old.txt": "高血压患者"}
    found = files.inventory(spark, str(root)).collect()
    assert [(r.name, r.ext) for r in found] == [("a.PDF", "pdf"), ("old.txt", "txt")]
    assert files.inventory(spark, str(root), keyword="OLD").count() == 1
    chunks = corpus.chunk_files(spark, str(root)).collect()
    assert [(r.source, r.title, r.category, r.headings, r.content) for r in chunks if r.source.endswith("pdf")] == [
        ("Cat/doc.pdf", "doc", "Cat", "标题", "正文")
    ]
    done = files.scan_files(spark, str(root)).where("relative_path like '%full.md'").select("path", "modificationTime")
    assert files.unprocessed(files.scan_files(spark, str(root)), done).count() == 2


def test_inventory_never_reads_contents(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    plan = files.inventory(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "r.zip", "w") as z:
        z.writestr("b.md", " one ")
        z.writestr("x.png", b"no")
        z.writestr("a.TXT", "two")
        z.writestr("c.json", "{}")
    members = archives.read_archives(spark, str(tmp_path))
    assert {r.member for r in members.collect()} == {"b.md", "a.TXT", "c.json"}
    assert [tuple(r) for r in archives.archive_texts(members).select("archive", "text").collect()] == [("r.zip", "one\n\ntwo")]


def test_records(spark, tmp_path):
    lines = tmp_path / "k.jsonl"
    lines.write_text('{"id": 1, "A": "base"}\n\n// {"id": 2}\n{"id": 3}\n')
    strict = records.strict_records(spark.read.text(str(lines)), "id int")
    assert [r.id for r in strict.collect()] == [1, 3]
    assert [r.id for r in records.read_records(spark, str(lines), "id int").collect()] == [1, 3]
    with pytest.raises(Exception, match="bad JSON line"):
        records.strict_records(spark.createDataFrame([("{oops",)], "value string"), "id int").collect()
    whole = tmp_path / "k.json"
    whole.write_text('{"rows": [{"id": 5},\n {"id": 6}, 7]}')
    assert [r.id for r in records.read_records(spark, str(whole), "id int").collect()] == [5, 6]
    pool = tmp_path / "q.json"
    pool.write_text('["  a  b ", {"query": "c"}, {"prompt": "问题：d 检索资料：e"}, {"x": 1}]')
    assert [r.question for r in records.read_questions(spark, str(pool)).collect()] == ["a b", "c", "d"]


def test_csv_with_mark(spark, tmp_path):
    path = tmp_path / "q.csv"
    path.write_text('﻿question_id,content\n1,"a ""b""\nc"\n', encoding="utf-8")
    assert [tuple(r) for r in files.read_csv(spark, str(path)).collect()] == [("1", 'a "b"\nc')]


def test_chunk_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"chunk_id":0,"source":"s","category":"c","headings":"","content":"t"},{"chunk_id":1,"source":"s"}]')
    (tmp_path / "index.json").write_text('[{"chunk_id":0,"source":"i","category":"c","headings":"","content":"t"}]')
    (tmp_path / "b.json").write_text('{"other": 1}')
    rows, counts = records.read_chunk_files(spark, str(tmp_path))
    assert [r.source for r in rows.collect()] == ["s"]
    assert {r.file.rsplit("/", 1)[1]: (r.rows_read, r.rows_kept) for r in counts.collect()} == {"a.json": (2, 1), "b.json": (1, 0)}


def test_catalogue_upsert_revives_and_numbers(spark):
    day = F.lit("2024-01-01").cast("timestamp")
    old = spark.createDataFrame(
        [(3, "t", "c", "s", "v", ["x"], 1, "manual", "k1", True)],
        "id long, title string, category string, source string, version string, tags array<string>, updated_by long, ingest_source string, ingest_key string, is_deleted boolean",
    ).withColumns({"created_at": day, "updated_at": day})
    new = spark.createDataFrame([("k1", "T", None, "s", None, ["y"]), ("k2", "U", "c", "s2", None, [])], "ingest_key string, title string, category string, source string, version string, tags array<string>")
    rows = {r.ingest_key: r for r in catalogue.upsert(old, new, "text_upload", F.current_timestamp(), F.lit(9)).collect()}
    assert (rows["k1"].id, rows["k1"].title, rows["k1"].is_deleted, rows["k1"].updated_by) == (3, "T", False, 9)
    assert (rows["k2"].id, rows["k2"].is_deleted) == (4, False)
