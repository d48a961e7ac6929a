"""Streams with event-time timers against their batch forms, with input out of order over several batches."""

from __future__ import annotations

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from tesserae.operators.stateful import Quota, quota_fold
from tesserae.operators.stats import liveness_changes
from tesserae.streaming import timers
from tesserae.streaming.timers import liveness_stream, quota_stream, run_available, timer_session

FAR = 10_000_000
USES = "user_id long, at long, use_id long, size long"
BEATS = "job long, at long"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def in_batches(spark, stream_of, batches, schema, path):
    """The stream's rows after each batch of input; the checkpoint is kept, so each run goes on from the state of the one before."""
    session, seen = timer_session(spark), []
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
        seen.append(rows(run_available(stream_of(session.readStream.schema(schema).parquet(f"{path}/in")), f"{path}/out")))
    return seen


def test_quota_takes_late_uses_in_order(spark, tmp_path):
    rng = random.Random(5)
    uses = [(rng.randrange(4) or None, 1000 + rng.randrange(300), i, rng.choice([0, 10, 40, 90])) for i in range(240)] + [(1, 1007, 500, 40), (1, 1007, 501, 40), (2, None, 502, 5)]
    rng.shuffle(uses)
    batches = [uses[:80], uses[80:160], uses[160:], [(9, FAR, 999, 1)]]
    seen = in_batches(spark, lambda s: quota_stream(s, 100, 50, "10 minutes"), batches, USES, tmp_path)
    assert seen[:3] == [[], [], []]
    assert seen[3] == rows(quota_fold(spark.createDataFrame([u for u in uses if u[1] is not None], USES), 100, 50))


def test_quota_state_lives_on_between_batches(spark, tmp_path):
    batches = [[(1, 5000, 1, 60), (1, 5020, 3, 60), (1, 5010, 2, 60)], [(1, 6000, 4, 60), (1, 5040, 5, 5)], [(9, FAR, 6, 1)]]
    seen = in_batches(spark, lambda s: quota_stream(s, 100, 50, "15 seconds"), batches, USES, tmp_path)
    assert seen[0] == [(1, 5000, 1, 60, True, 60)]
    assert seen[2] == [(1, 5000, 1, 60, True, 60), (1, 5010, 2, 60, True, 120), (1, 5020, 3, 60, False, 120), (1, 5040, 5, 5, False, 120), (1, 6000, 4, 60, True, 60)]


def test_quota_of_users_and_uses_without_an_id(spark, tmp_path):
    """Ids past 2^53 stay whole beside nulls, a use without an id comes first in its second, and one that is refused needs no size."""
    big = (1 << 53) + 1
    uses = [(big, 1000, big, 60), (big, 1000, None, 50), (big + 1, 1000, big + 1, 90), (None, 1000, 0, 100), (None, 1001, 1, 1), (None, 1001, 2, None), (0, 1001, 2, 1)]
    seen = in_batches(spark, lambda s: quota_stream(s, 100, 50, "1 second"), [uses, [(9, FAR, 999, 1)]], USES, tmp_path)
    assert seen[1] == rows(quota_fold(spark.createDataFrame(uses, USES), 100, 50)) and (big, 1000, None, 50, True, 50) in seen[1]


class States(dict):
    """A key's map or value state in memory."""

    def __init__(self, held):
        self.held = held

    def getValue(self, key):
        self.held.calls += 1
        return dict.get(self, key)

    def updateValue(self, key, value):
        self.held.calls += 1
        self[key] = value

    def removeKey(self, key):
        self.held.calls += 1
        del self[key]


class Value(States):
    def get(self):
        return self.getValue(())

    def update(self, value):
        self.updateValue((), value)


class Held:
    """A handle with the states and timers of one key, and the number of calls of any."""

    def __init__(self):
        self.calls, self.timers = 0, set()

    def getMapState(self, *_):
        return States(self)

    def getValueState(self, *_):
        return Value(self)

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)


def run_quotas(batches, most, period):
    """Decided uses of a group after batches of (uses, watermark in seconds), its handle and processor."""
    held, quotas, decided = Held(), timers.Quotas(most, period), []
    quotas.init(held)
    for uses, passed in batches:
        if uses:
            frames = (pd.DataFrame([(at, 1, i, 1, size, 1, user) for user, at, i, size in uses[k : k + 50]], columns=timers.USE) for k in range(0, len(uses), 50))
            assert not list(quotas.handleInputRows((0,), frames, TimerValues(0, passed * 1000)))
        for timer in sorted(t for t in held.timers if t <= passed * 1000):
            held.calls += 1
            for frame in quotas.handleExpiredTimer((0,), TimerValues(0, passed * 1000), ExpiredTimerInfo(timer)):
                decided += frame[["user_id", "at", "use_id", "size", "allowed", "used"]].itertuples(index=False, name=None)
            held.timers.remove(timer)
    return decided, held, quotas


def in_order(uses, most, period):
    users = {user: Quota(most, period) for user, *_ in uses}
    return [(user, at, i, size, users[user].take(at, size), users[user].used) for user, at, i, size in sorted(uses, key=lambda u: (u[1], u[2]))]


@pytest.mark.parametrize("piece, at_once, frames", [(1, 1, 1), (7, 3, 2), (64, 16, 3), (1 << 10, 1 << 14, 16)])
def test_quota_runs_and_pieces(monkeypatch, piece, at_once, frames):
    """Runs that the watermark has passed in part, several runs at once, and runs that grow, with pieces of any length."""
    for name, value in (("PIECE", piece), ("AT_ONCE", at_once), ("FRAMES", frames)):
        monkeypatch.setattr(timers, name, value)
    rng = random.Random(piece)
    uses = [(rng.randrange(5), 1000 + rng.randrange(500), i, rng.choice([0, 10, 40, 90])) for i in range(900)]
    uses.sort(key=lambda u: u[1] + rng.randrange(150))
    batches, passed = [], 0
    while uses:
        some, uses = uses[: (n := rng.choice([1, 20, 200]))], uses[n:]
        passed = max(passed, min((u[1] for u in uses), default=FAR) - rng.randrange(1, 60))
        batches.append((some, passed))
    decided, held, quotas = run_quotas(batches, 100, 50)
    assert sorted(decided) == sorted(in_order([u for some, _ in batches for u in some], 100, 50))
    assert [u[1] for u in decided] == sorted(u[1] for u in decided)
    assert not quotas.waiting and not held.timers and len(quotas.quotas) == 5


def test_quota_state_is_not_called_for_each_use():
    """The calls go through a socket, so one for each use is most of a stream's time."""
    uses = [(i % 10, 1000 + i * 7 % 10_007, i, 10) for i in range(10_000)]
    decided, held, _ = run_quotas([(uses, 0), ([], FAR)], 100, 50)
    assert sorted(decided) == sorted(in_order(uses, 100, 50)) and held.calls < 100


def test_dead_without_a_further_event(spark, tmp_path):
    """Job 1 is reported dead by its timer while only job 2 goes on."""
    batches = [[(1, 100), (2, 100)], [(2, 109)], [(2, 118), (2, 127)], [(2, 1000)]]
    seen = in_batches(spark, lambda s: liveness_stream(s, 8, 2, "1 second"), batches, BEATS, tmp_path)
    assert seen[0] == []
    assert seen[1] == [(1, 100, True), (2, 100, True)]
    assert seen[2] == [(1, 100, True), (1, 111, False), (2, 100, True)]
    assert seen[3] == [(1, 100, True), (1, 111, False), (2, 100, True), (2, 138, False)]


@pytest.mark.parametrize("limit", [0, 30])
def test_liveness_equals_batch(spark, tmp_path, limit):
    rng = random.Random(limit)
    beats = [(rng.choice([None, 1, 2, 3]), 1 + rng.randrange(400)) for _ in range(60)] + [(1, 50), (1, 50), (4, 10), (4, 10 + limit + 1), (5, 10), (5, 10 + limit + 2), (5, None)]
    rng.shuffle(beats)
    seen = in_batches(spark, lambda s: liveness_stream(s, limit, 0, "20 minutes"), [beats[:30], beats[30:], [(9, FAR)]], BEATS, tmp_path)
    whole = spark.createDataFrame(beats, BEATS)
    assert seen[2] == rows(liveness_changes(whole, F.lit(FAR), limit, 0))
    told = rows(whole.where("at is not null"))
    state = {job: {at for j, at in told if j == job} for job in {j for j, _ in told}}
    expected = []
    for job, ats in state.items():
        alive = False
        for second in range(500):
            now = any(second - limit <= a <= second for a in ats)
            if now != alive:
                expected.append((job, second, now))
            alive = now
    assert seen[2] == sorted(expected, key=repr)


def test_no_beats_no_changes(spark):
    assert liveness_changes(spark.createDataFrame([], BEATS), F.lit(5), 3).count() == 0
