"""Answers assembled from the delta events of a generation."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from passagemill.operators.spread import block_of, ordered_concat


def assembled(events: DataFrame) -> DataFrame:
    """``request, status, answer, completion_tokens`` per finished or broken-off request.

    The final text of an end event replaces the deltas; without one the deltas are
    joined in order; an error leaves no answer. Only requests that need their deltas
    have them shuffled.
    """
    last = events.where(F.col("type").isin("end", "error"))
    outcome = last.groupBy("request").agg(
        F.max(F.col("type") == "error").alias("failed"),
        F.max_by(F.when(F.col("type") == "end", F.nullif("answer", F.lit(""))), "seq").alias("final"),
        F.max_by("completion_tokens", "seq").alias("completion_tokens"),
    )
    settled = outcome.where(F.col("failed") | F.col("final").isNotNull()).select("request")
    deltas = events.where((F.col("type") == "delta") & F.col("text").isNotNull()).join(settled, "request", "left_anti")
    joined = ordered_concat(deltas, ["request"], ["seq"], "text", "deltas", block_of(F.col("seq")))
    both = outcome.join(joined, "request", "full_outer")
    failed = F.coalesce("failed", F.lit(False))
    status = F.when(failed, "error").when(F.col("failed").isNull(), "open").otherwise("done")
    answer = F.when(~failed, F.coalesce("final", "deltas", F.lit("")))
    return both.select("request", status.alias("status"), answer.alias("answer"), F.when(~failed, F.col("completion_tokens")).alias("completion_tokens"))


ANSWER_SCHEMA = "request long, status string, answer string, completion_tokens long"


_one_row = Row("request", "status", "answer", "completion_tokens")


class _Assembly(StatefulProcessor):
    """State of a request: a list that only grows by the new deltas, and a mark once it has its row.

    The request's timer, which is stored with the state, ends the list; a time to live could end it
    first where the job stood still, and lose text. The mark has one, as losing it is harmless.
    """

    def __init__(self, give_up_ms: int) -> None:
        self.give_up_ms = give_up_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.deltas = handle.getListState("deltas", "seq long, text string")
        self.settled = handle.getValueState("settled", "done boolean", ttlDurationMs=self.give_up_ms)

    def _so_far(self) -> list[tuple[int, str]]:
        return [(row[0], row[1]) for row in self.deltas.get()]

    def _no_timer(self) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        fresh, last = [], None
        for row in rows:
            if row.type == "delta" and row.text is not None:
                fresh.append((row.seq, row.text))
            elif row.type in ("end", "error") and (last is None or row.seq > last.seq):
                last = row
        if self.settled.exists():
            return
        if last is None:
            if fresh:
                self.deltas.appendList(fresh)
            self._no_timer()
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.give_up_ms)
            return
        ok = last.type == "end"
        final = last.answer
        if ok and not final:
            final = "".join(text for _, text in sorted(self._so_far() + fresh))
        self.deltas.clear()
        self._no_timer()
        self.settled.update((True,))
        yield _one_row(key[0], "done" if ok else "error", final if ok else None, last.completion_tokens if ok else None)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        text = "".join(text for _, text in sorted(self._so_far()))
        self.deltas.clear()
        self.settled.update((True,))
        yield _one_row(key[0], "open", text, None)

    def close(self) -> None:
        pass


def answer_stream(events: DataFrame, give_up_ms: int = 600_000) -> DataFrame:
    """One row per request when its end or error arrives, or, after ``give_up_ms`` without an event, as it stands (``open``).

    A batch writes its own deltas and no earlier one. Events that come within ``give_up_ms`` after
    a request's row are ignored; later ones count as a new request. A session that
    ``build_session`` did not make needs the state store ``passagemill.session.STATE_STORE``.
    """
    return events.groupBy("request").transformWithState(_Assembly(give_up_ms), ANSWER_SCHEMA, "append", "ProcessingTime")
