from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tesserae.operators import freshness as Q
from tesserae.operators.freshness import StaleQueue
from tesserae.sources.storage import new_path

START = dt.datetime(2024, 1, 1)


def at(minutes):
    return F.lit(str(START + dt.timedelta(minutes=minutes))).cast("timestamp_ntz")


@pytest.fixture
def model(spark, monkeypatch):
    """A queue over small pages, and the times that a plain model has."""
    monkeypatch.setattr(Q, "PAGE_ROWS", 20)
    rng = random.Random(6)
    times = {k: rng.choice([None, rng.randrange(50), 7]) for k in range(130)}
    stats = [(k, None if t is None else START + dt.timedelta(minutes=m)) for k, t in times.items() if k % 9 for m in ([t] if t is None else [t, t - 1])]
    times = {k: t if k % 9 else None for k, t in times.items()}
    entities = spark.createDataFrame([(k, "x") for k in times], "torrent_id long, at string")
    return StaleQueue.build(entities, spark.createDataFrame(stats, "torrent_id long, updated_at timestamp_ntz"), new_path(spark, "queue")), times


def plain(times, before, limit):
    return [k for _, k in sorted((-1 if t is None else t, k) for k, t in times.items() if t is None or t < before)[:limit]]


def test_ticks_give_what_a_sort_gives(spark, model, monkeypatch):
    queue, times = model
    monkeypatch.setattr(Q, "MOST_SMALL", 3)
    for tick, (before, now) in enumerate(((60, 61), (40, 30), (62, 90), (1, 91), (100, 101))):  # the second is older than what is there: pages overlap
        batch = queue.oldest(at(before), 33)
        keys = [r.key for r in batch.collect()]
        assert keys == plain(times, before, 33), tick
        queue.refreshed(batch, at(now))
        times |= dict.fromkeys(keys, now)
        assert sum(p[3] for p in queue.pages()) == len(times)
    queue.tidy()
    assert [r.key for r in queue.oldest(at(1000), 200).collect()] == plain(times, 1000, 200)
    assert len(queue._lists()) == 1


def test_a_tick_reads_the_first_pages_only(spark, model):
    queue, times = model
    never = sum(t is None for t in times.values())
    assert never > 40
    files = queue.oldest(at(60), 10).inputFiles()
    assert len(queue.pages()) >= 6 and {f.rsplit("/", 2)[1] for f in files} == {"page=0"}
    before = {p[0] for p in queue.pages()}
    queue.refreshed(queue.oldest(at(60), 10), at(61))
    assert len(before - {p[0] for p in queue.pages()}) == 1  # one page was written again


def test_nothing_stale_and_no_entities(spark, model):
    queue, _ = model
    pages = queue.pages()
    queue.refreshed(queue.oldest(at(60), 0), at(61))
    assert queue.pages() == pages
    empty = spark.createDataFrame([], "torrent_id long, updated_at timestamp_ntz")
    assert StaleQueue.build(empty, empty, new_path(spark, "queue")).oldest(at(60)).count() == 0
