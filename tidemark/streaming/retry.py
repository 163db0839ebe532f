"""Retry queue: failed calls wait in keyed state and are tried again at each beat, the oldest first, until they work or are given up."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.sources.shared import remove, shared_dir

MOST, PER_RUN, BEAT_MINUTES, DELAY = 5, 100, 10, "1 hour"
SETTLED = "queue string, item long, retry_count int, status string, settled_at timestamp"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Queue(StatefulProcessor):
    """State of one queue: its waiting items (when they came, how often they were tried, how many tries fail), the last beat and the timer, as one value.

    A beat tries the ``per_run`` oldest items that came before it. Beats lie on a grid of event time and run once the watermark has passed them,
    so the outcome does not hang on how the input is cut into batches, nor on restarts. The state is read and written once a call, and one timer
    stands for the first beat that has something to do.
    """

    def __init__(self, most: int, per_run: int, beat_ms: int):
        self.most, self.per_run, self.beat = most, per_run, beat_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("queue", "last long, timer long, item array<long>, at array<long>, tried array<int>, fails array<int>")

    def next_beat(self, at: int) -> int:
        return (at // self.beat + 1) * self.beat

    def load(self) -> tuple[int | None, int | None, dict[int, list[int]]]:
        """The last beat, the timer, and [at, tried, fails] of each waiting item."""
        row = self.state.get()
        return (row[0], row[1], {i: list(v) for i, *v in zip(*row[2:], strict=True)}) if row else (None, None, {})

    def keep(self, last: int | None, timer: int | None, items: dict[int, list[int]]) -> None:
        lists = zip(*((i, *v) for i, v in items.items()), strict=True) if items else ([], [], [], [])
        self.state.update((last, timer, *map(list, lists)))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last, timer, items = self.load()
        first = timer
        for row in rows:
            if row.item not in items:
                items[row.item] = [row.ms, 0, row.fails]
                beat = self.next_beat(row.ms)
                first = beat if first is None else min(first, beat)
        if first != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(first)
        self.keep(last, first, items)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        beat, until = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        last, _, items = self.load()
        beat = beat if last is None else max(beat, last + self.beat)
        out = []
        while items and beat <= until:
            due = sorted((v[0], item) for item, v in items.items() if v[0] < beat)[: self.per_run]
            for _, item in due:
                items[item][1] += 1
                _, tried, fails = items[item]
                if tried > fails or tried >= self.most:
                    out.append(Row(queue=key[0], item=item, retry_count=tried, status="replayed" if tried > fails else "replay_failed", ms=beat))
                    del items[item]
            last = beat
            # on to the beat after the first one that has something to do
            beat = max(beat + self.beat, self.next_beat(min((v[0] for v in items.values()), default=0)))
        if items:
            self.handle.registerTimer(beat)
        self.keep(last, beat if items else None, items)
        return iter(out)

    def close(self) -> None:
        pass


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """The state store that keyed state with timers needs, for queries that start meanwhile."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def settled(calls: DataFrame, path: str, state: str, most: int = MOST, per_run: int = PER_RUN, beat_minutes: int = BEAT_MINUTES, delay: str = DELAY) -> DataFrame:
    """Run the queue over a stream of failed calls (queue, item, at, fails: tries that fail) to the end of its input; SETTLED rows.

    ``path`` and ``state`` carry on between runs: what waits at the end of one is tried in the next. Rows older than the watermark are
    dropped, null keys and times are left out, null ``fails`` counts as 0, a repeated item is one. A queue's waiting items go through one task
    at a time, so a source that may hold a large share of them should be dealt to several queues, each with its share of ``per_run``.
    """
    spark = calls.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    ready = calls.filter("queue is not null and item is not null and at is not null").selectExpr("queue", "item", "at", "unix_millis(at) as ms", "coalesce(fails, 0) as fails")
    with rocks(spark):
        kept = ready.withWatermark("at", delay).groupBy("queue").transformWithState(Queue(most, per_run, beat_minutes * 60_000), "queue string, item long, retry_count int, status string, ms long", "Append", "EventTime")
        kept = kept.withColumn("settled_at", F.timestamp_millis("ms")).drop("ms")
        kept.writeStream.outputMode("append").option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(write).queryName(f"q{uuid.uuid4().hex}").start().awaitTermination()
    return spark.read.schema(SETTLED).parquet(f"{path}/*")


def settle_all(calls: DataFrame, **limits) -> DataFrame:
    """One run from the beginning, with state of its own that is removed afterwards."""
    spark = calls.sparkSession
    path, state = shared_dir(spark), shared_dir(spark)
    try:
        return settled(calls, path, state, **limits)
    finally:
        remove(spark, state)
