"""Admission of requests by key: a token bucket, so many streams at a time, and a bounded queue with a time limit.

A key's bucket holds ``rate`` tokens at most and gains ``rate`` a second; a request that finds less than one is refused.
One that finds a free stream holds it for its duration. Else it waits in line; it is refused if ``queue`` others wait,
and when it has waited ``patience`` microseconds. All numbers are whole (tokens in millionths, times in microseconds), so
the outcome does not depend on how the requests were cut into batches.

``decided`` folds a table; ``Admission`` is the same machine as the state of a stream, with timers: requests are held
until the watermark has passed them, so that they are taken in order of time, and what waits is decided by a timer.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

TOKEN = 1_000_000
#: Outcomes.
ADMITTED, RATE, FULL, LATE = "admitted", "rate limited", "queue full", "timed out"
NEVER = 1 << 62


class Limits(NamedTuple):
    rate: int = 2
    streams: int = 1
    queue: int = 2
    patience: int = 30_000_000


class Gate:
    """The sequential machine of one key. ``until`` and ``offer`` give decisions (id, outcome, waited)."""

    def __init__(self, limits: Limits, state: str | None = None):
        self.limits = limits
        self.tokens, self.last, self.busy, self.waiting = json.loads(state) if state else (limits.rate * TOKEN, None, [], [])

    def state(self) -> str:
        return json.dumps([self.tokens, self.last, self.busy, self.waiting])

    def next_at(self) -> int | None:
        """When something will be decided without any further request."""
        return min(self.busy[0], self.waiting[0][0] + self.limits.patience) if self.waiting else None

    def until(self, at: int) -> list[tuple[int, str, int]]:
        """All that time alone decides up to ``at``; a stream that falls free at the end of one's patience still counts."""
        out = []
        while self.waiting:
            came, who, needs = self.waiting[0]
            free, end = self.busy[0], came + self.limits.patience
            if min(free, end) > at:
                break
            self.waiting.pop(0)
            if free <= end:
                heapq.heapreplace(self.busy, free + needs)
                out.append((who, ADMITTED, free - came))
            else:
                out.append((who, LATE, self.limits.patience))
        while not self.waiting and self.busy and self.busy[0] <= at:
            heapq.heappop(self.busy)
        return out

    def offer(self, at: int, who: int, needs: int) -> list[tuple[int, str, int]]:
        out, full = self.until(at), self.limits.rate * TOKEN
        self.tokens = full if self.last is None else min(full, self.tokens + (at - self.last) * self.limits.rate)
        self.last = at
        if self.tokens < TOKEN:
            return [*out, (who, RATE, 0)]
        self.tokens -= TOKEN
        if len(self.busy) < self.limits.streams:
            heapq.heappush(self.busy, at + needs)
            return [*out, (who, ADMITTED, 0)]
        if len(self.waiting) >= self.limits.queue:
            return [*out, (who, FULL, 0)]
        self.waiting.append((at, who, needs))
        return out


DECISION = "key long, id long, outcome string, waited long"


def decided(requests: DataFrame, limits: Limits) -> DataFrame:
    """key, id, outcome, waited of a table (key, id, at, needs): keys are dealt, each is read in order of (at, id).

    A key is one sequence by its nature; the machine keeps only its bucket, its streams and its line, never the rows.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, gate = None, None
        for batch in batches:
            rows = []
            for key, who, at, needs in zip(*[batch.column(c).to_pylist() for c in ("key", "id", "at", "needs")], strict=True):
                if gate is None or key != now:
                    if gate:
                        rows += [(now, *x) for x in gate.until(NEVER)]
                    now, gate = key, Gate(limits)
                rows += [(key, *x) for x in gate.offer(at, who, needs)]
            yield _rows(rows)
        if gate:
            yield _rows([(now, *x) for x in gate.until(NEVER)])

    r = requests.select("key", "id", "at", "needs")
    return r.repartition("key").sortWithinPartitions("key", "at", "id").mapInArrow(task, DECISION)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[], [], [], []]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["key", "id", "outcome", "waited"])


class Admission(StatefulProcessor):
    """Keyed state: the gate, and the requests that the watermark has not passed yet."""

    def __init__(self, limits: Limits):
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.gate = handle.getValueState("gate", "state string")
        self.held = handle.getListState("held", "at long, id long, needs long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = [tuple(map(int, x)) for f in rows for x in zip(f["at"], f["id"], f["needs"], strict=True)]
        if new:
            self.held.appendList(new)
            self.handle.registerTimer(min(x[0] for x in new) // 1000 + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000  # later rows are not before this time
        gate = Gate(self.limits, self.gate.get()[0] if self.gate.exists() else None)
        held = sorted(tuple(x) for x in self.held.get())
        due, rest = [x for x in held if x[0] < passed], [x for x in held if x[0] >= passed]
        out = [d for at, who, needs in due for d in gate.offer(at, who, needs)] + gate.until(passed - 1)
        self.gate.update((gate.state(),))
        if rest:
            self.held.put(rest)
        else:
            self.held.clear()
        later = [x for x in (rest[0][0] if rest else None, gate.next_at()) if x is not None]
        if later:
            self.handle.registerTimer(max(min(later), passed) // 1000 + 1)
        yield pd.DataFrame([(key[0], *x) for x in out], columns=["key", "id", "outcome", "waited"])


def admitted(requests: DataFrame, limits: Limits, late: str = "10 minutes") -> DataFrame:
    """The decisions on a stream of requests (key, id, ts, needs in microseconds); those more than ``late`` behind are lost.

    Needs ``spark.sql.streaming.stateStore.providerClass`` of RocksDB.
    """
    r = requests.select("key", "id", "ts", F.unix_micros("ts").alias("at"), "needs").withWatermark("ts", late)
    return r.groupBy("key").transformWithStateInPandas(statefulProcessor=Admission(limits), outputStructType=DECISION, outputMode="Append", timeMode="EventTime")


def run(spark: SparkSession, source: str, work: str, limits: Limits, per_trigger: int = 1) -> DataFrame:
    """Decisions on all requests that lie in ``source`` now, a row (key, id, ts, needs) each, in batches of ``per_trigger`` files."""
    name, rocks = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name, None)
    spark.conf.set(name, rocks)
    try:
        stream = spark.readStream.schema("key long, id long, ts timestamp, needs long").option("maxFilesPerTrigger", per_trigger).parquet(source)
        q = admitted(stream, limits).writeStream.format("parquet").option("path", f"{work}/decided").option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
    return spark.read.schema(DECISION).parquet(f"{work}/decided")
