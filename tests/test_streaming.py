"""Streams that stop and start again between batches."""

import datetime as dt

from pyspark.sql import functions as F

from passagemill.operators import catalogue
from passagemill.session import STATE_STORE
from passagemill.streaming import answers, status

EVENTS = "request long, seq long, type string, text string, answer string, completion_tokens long"
LOG = "user_id long, ts timestamp, seq long, status string, error string"


def run_batches(spark, folder, schema, batches, job, mode):
    """All rows written, and the stream of each batch after it ended."""
    feed, out, state = (str(folder / n) for n in ("feed", "out", "state"))
    changed = {"spark.sql.streaming.noDataMicroBatches.enabled": "false", "spark.sql.streaming.stateStore.providerClass": STATE_STORE}
    before = {k: spark.conf.get(k) for k in changed}
    ended = []
    try:
        for k, v in changed.items():
            spark.conf.set(k, v)
        for rows in batches:
            spark.createDataFrame(rows, schema).write.mode("append").parquet(feed)
            stream = job(spark.readStream.schema(schema).parquet(feed)).writeStream.outputMode(mode).option("checkpointLocation", state)
            query = stream.foreachBatch(lambda df, _: df.write.mode("append").parquet(out)).trigger(availableNow=True).start()
            query.awaitTermination()
            ended.append(query)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.parquet(out), ended


def test_answers_over_batches_equal_the_finished_log(spark, tmp_path):
    batches = [
        [(1, 1, "delta", "b", None, None), (1, 0, "delta", "a", None, None), (2, 0, "delta", "x", None, None), (3, 0, "delta", "gone", None, None)],
        [(1, 2, "delta", "c", None, None), (2, 1, "end", None, "final", 7), (3, 1, "error", None, None, None), (4, 0, "end", None, None, None)],
        [(1, 4, "end", None, "", 9), (1, 3, "delta", "d", None, None), (2, 2, "delta", "after the end", None, None)],
    ]
    got, _ = run_batches(spark, tmp_path, EVENTS, batches, answers.answer_stream, "append")
    whole = answers.assembled(spark.createDataFrame(sum(batches, []), EVENTS))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect()))
    assert (1, "done", "abcd", 9) in set(map(tuple, got.collect()))


def test_state_of_an_answer_grows_by_its_new_deltas_only(spark, tmp_path):
    batches = [[(1, 10 * b + i, "delta", "t", None, None) for i in range(10)] for b in range(3)]
    batches.append([(1, 99, "end", None, None, 30)])
    got, ended = run_batches(spark, tmp_path, EVENTS, batches, answers.answer_stream, "append")
    assert [tuple(r) for r in got.collect()] == [(1, "done", "t" * 30, 30)]
    puts = [q.lastProgress["stateOperators"][0]["customMetrics"].get("rocksdbPutCount", 0) for q in ended[:3]]
    assert puts[2] <= puts[1] + 2  # a rewrite of all deltas so far would add ten a batch


def test_an_answer_without_end_is_given_up(spark, tmp_path):
    batches = [[(1, 0, "delta", "half", None, None)], [(2, 0, "end", None, "whole", 1)]]
    got, _ = run_batches(spark, tmp_path, EVENTS, batches, lambda e: answers.answer_stream(e, give_up_ms=1), "append")
    assert set(map(tuple, got.collect())) == {(1, "open", "half", None), (2, "done", "whole", 1)}


def test_status_with_late_and_repeated_rows(spark, tmp_path):
    def at(hour, user, seq, state, error=None):
        return (user, dt.datetime(2024, 1, 1) + dt.timedelta(hours=hour), seq, state, error)

    first = [at(0, 1, 1, "running"), at(0, 1, 2, "synced"), at(0, 2, 3, "error", "e3"), at(0, 1, 1, "running")]
    second = [at(30, 1, 4, "dirty"), at(30, 1, 4, "dirty"), at(29.5, 2, 5, "synced")]
    third = [at(30.2, 2, 7, "running")]
    fourth = [at(1, 4, 6, "error", "too late"), at(60, 1, 8, "synced"), at(60, 3, 9, "dirty")]
    got, ended = run_batches(spark, tmp_path, LOG, [first, second, third, fourth], lambda log: status.status_stream(log, ["user_id"]), "update")
    taken = spark.createDataFrame(first + second + third + fourth[1:], LOG)
    current = catalogue.current_status(taken, ["user_id"])
    assert sorted(map(tuple, status.folded(got, ["user_id"]).collect())) == sorted(map(tuple, current.collect()))
    assert [status.late_rows(q) for q in ended] == [0, 0, 0, 1]
    kept = [q.lastProgress["stateOperators"][0]["numRowsTotal"] for q in ended]
    assert max(kept) <= 5 and got.where(F.col("user_id") == 3).count() == 1
