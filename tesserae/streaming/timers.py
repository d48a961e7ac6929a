"""Stateful streams with event-time timers: liveness of jobs and quotas of users.

Rows may come in any order within the watermark's delay. A row waits in the
state of its key until the watermark passes its time, and a timer then takes the
key's rows in order of time, so the result is that of the ordered batch form
over the rows whose time the watermark has reached. Rows that come after the
watermark has reached their time are dropped by Spark, which starts it at the epoch, so rows
from before 1970 are dropped too; rows without a time take no part. Both need the RocksDB state store (`timer_session`). State holds
undecided rows and one small value a job or user; a user without any is two numbers.
A call of the state from Python costs more than a row does, so quotas keep the
uses of a group of users together.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from heapq import merge
from itertools import islice
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..operators.stateful import Quota

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Groups that users are dealt to; a checkpoint is bound to their number.
GROUPS = 1 << 12
#: Uses that a task decides at a time, and those of a piece, which the state holds and gives as one value.
AT_ONCE, PIECE = 1 << 14, 1 << 10
#: Frames of spark.sql.execution.arrow.maxRecordsPerBatch uses that make a run at most.
FRAMES = 16
CHANGES = "job long, at long, alive boolean"
#: A waiting use, in the order in which uses are decided; in a second, those without an id come first.
USE = ["at", "known", "use_id", "sized", "size", "someone", "user_id"]
#: What tells whether another column has a value.
FLAGS = {"known": "use_id", "sized": "size", "someone": "user_id"}
DECIDED = ", ".join(f"{c} long" for c in USE) + ", allowed boolean, used long"


def timer_session(spark: SparkSession) -> SparkSession:
    """A session of the same application whose streams can have timers; the given session's settings stay as they are."""
    session = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        value = spark.conf.get(name, None)
        if value:
            session.conf.set(name, value)
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return session


class Liveness(StatefulProcessor):
    """A job is alive from a beat on until `limit` seconds after it; changes come at whole seconds."""

    def __init__(self, limit: int) -> None:
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long", "found boolean")
        self.last = handle.getValueState("last", "at long, alive boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        seconds = {row["at"] for row in rows}
        for at in seconds:
            self.waiting.updateValue((at,), (True,))
        self.handle.registerTimer(min(seconds) * 1000)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        """Take all seconds that the watermark has passed, a number each, then wait for the next one or for the deadline."""
        passed, held = timerValues.getCurrentWatermarkInMs() // 1000, self.last.get()
        last, alive = held if held else (None, False)
        if last is not None:
            self.handle.deleteTimer((last + self.limit + 1) * 1000)
        seconds, changes = sorted(k[0] for k in self.waiting.keys()), []
        due = bisect_right(seconds, passed)
        for now in seconds[:due]:
            if alive and now > last + self.limit + 1:
                changes.append(Row(job=key[0], at=last + self.limit + 1, alive=False))
                alive = False
            if not alive:
                changes.append(Row(job=key[0], at=now, alive=True))
            last, alive = now, True
            self.waiting.removeKey((now,))
        if alive and last + self.limit + 1 <= passed:
            changes.append(Row(job=key[0], at=last + self.limit + 1, alive=False))
            alive = False
        self.last.update((last, alive))
        for at in seconds[due : due + 1] + ([last + self.limit + 1] if alive else []):
            self.handle.registerTimer(at * 1000)
        return iter(changes)


class Run(NamedTuple):
    """Sorted uses of a group: the pieces from `piece` to before `pieces` wait, with so many uses, the first at `at`."""

    run: int
    piece: int
    pieces: int
    uses: int
    at: int


class Quotas(StatefulProcessor):
    """Uses of a group of users wait in runs of pieces, each run sorted; what the watermark has passed of the runs is merged and decided.

    So the state is called a few times for all uses of a group that come or fall
    due together, and twice for each user of them, but not for each use. A task
    holds one piece of each run of a group.
    """

    def __init__(self, most: int, period: int) -> None:
        self.most, self.period = most, period

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "run long, piece long", "uses binary")
        self.quotas = handle.getMapState("quotas", "someone long, user_id long", "used long, start long")
        self.runs = handle.getValueState("runs", "made long, timer long, runs array<struct<run long, piece long, pieces long, uses long, at long>>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        made, timer, runs = self._held()
        while frames := list(islice(rows, FRAMES)):
            uses = np.concatenate([f[USE].to_numpy(np.int64) for f in frames])
            if runs and runs[-1].pieces - runs[-1].piece == 1 and runs[-1].uses + len(uses) <= PIECE:
                last = runs.pop()
                run, piece, uses = last.run, last.piece, np.concatenate([self._uses(last.run, last.piece), uses])
            else:
                run, piece, made = made, 0, made + 1
            uses = uses[np.lexsort(uses.T[::-1])]
            pieces = -(-len(uses) // PIECE)
            for i in range(pieces):
                self._wait(run, piece + i, uses[i * PIECE : (i + 1) * PIECE])
            runs.append(Run(run, piece, piece + pieces, len(uses), int(uses[0, 0])))
        self._hold(made, timer, runs)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() // 1000
        made, _, runs = self._held()
        left, quotas = [r for r in runs if r.at > passed], {}
        due = merge(*(self._due(r, passed, left) for r in runs if r.at <= passed))
        while some := list(islice(due, AT_ONCE)):
            allowed, used = [], []
            for at, _, _, sized, size, *user in some:
                who = tuple(user)
                if who not in quotas:
                    quotas[who] = Quota(self.most, self.period, *(self.quotas.getValue(who) or ()))
                allowed.append(quotas[who].take(at, size if sized else None))
                used.append(quotas[who].used)
            yield pd.DataFrame(np.array(some), columns=USE).assign(allowed=allowed, used=used)
        for who, quota in quotas.items():
            self.quotas.updateValue(who, (quota.used, quota.start))
        self._hold(made, None, sorted(left))

    def _held(self) -> tuple[int, int | None, list[Run]]:
        made, timer, runs = self.runs.get() or (0, None, [])
        return made, timer, [Run(*r) for r in runs]

    def _hold(self, made: int, timer: int | None, runs: list[Run]) -> None:
        """Keep the list of runs, with one timer, for the first second that waits."""
        first = min((r.at for r in runs), default=None)
        if first != timer:
            if timer is not None:
                self.handle.deleteTimer(timer * 1000)
            if first is not None:
                self.handle.registerTimer(first * 1000)
        self.runs.update((made, first, [tuple(r) for r in runs]))

    def _uses(self, run: int, piece: int) -> np.ndarray:
        return np.frombuffer(self.waiting.getValue((run, piece))[0], np.int64).reshape(-1, len(USE))

    def _wait(self, run: int, piece: int, uses: np.ndarray) -> None:
        self.waiting.updateValue((run, piece), (uses.tobytes(),))

    def _due(self, run: Run, passed: int, left: list[Run]) -> Iterator[list[int]]:
        """A run's uses up to a second, which leave the state; what stays of the run is added to `left`."""
        waiting = run.uses
        for piece in range(run.piece, run.pieces):
            uses = self._uses(run.run, piece)
            due = int(np.searchsorted(uses[:, 0], passed, "right"))
            yield from uses[:due].tolist()
            waiting -= due
            if due < len(uses):
                if due:
                    self._wait(run.run, piece, uses[due:])
                left.append(Run(run.run, piece, run.pieces, waiting, int(uses[due, 0])))
                return
            self.waiting.removeKey((run.run, piece))


def liveness_stream(beats: DataFrame, interval: int, grace: int = 10, delay: str = "1 minute") -> DataFrame:
    """A stream of beats(job, at seconds) as changes (job, at, alive): one to dead comes without any further beat of its job, once other jobs' beats move the watermark."""
    timed = beats.where("at is not null").select(F.col("job").cast("long").alias("job"), F.col("at").cast("long").alias("at"), F.timestamp_seconds("at").alias("time"))
    return timed.withWatermark("time", delay).groupBy("job").transformWithState(Liveness(interval + grace), CHANGES, "append", "EventTime")


def quota_stream(uses: DataFrame, most: int, period: int, delay: str = "1 minute") -> DataFrame:
    """A stream of uses(user_id, at seconds, use_id, size) with `allowed` and `used`, as `quota_fold` gives them, in whatever order they come."""
    number = {c: F.col(c).cast("long") for c in ("at", "use_id", "size", "user_id")}
    # Longs with nulls would reach pandas as doubles, so columns beside them tell what there is.
    found = {flag: number[c].isNotNull().cast("long") for flag, c in FLAGS.items()}
    use = ((found[c] if c in FLAGS else F.coalesce(number[c], F.lit(0))).alias(c) for c in USE)
    group = F.pmod(F.xxhash64(number["user_id"]), F.lit(GROUPS)).alias("users")
    timed = uses.where("at is not null").select(group, *use, F.timestamp_seconds("at").alias("time"))
    decided = timed.withWatermark("time", delay).groupBy("users").transformWithStateInPandas(Quotas(most, period), DECIDED, "append", "EventTime")
    given = {c: F.when(F.col(flag) == 1, F.col(c)).alias(c) for flag, c in FLAGS.items()}
    return decided.select(given["user_id"], "at", given["use_id"], given["size"], "allowed", "used")


def run_available(stream: DataFrame, path: str) -> DataFrame:
    """What a stream gives for all input that is there, written below path and read again. A run that was cut off goes on where it was."""
    sink = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoint")
    sink.trigger(availableNow=True).start(f"{path}/rows").awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")
