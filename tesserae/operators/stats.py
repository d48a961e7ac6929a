"""Statistics: the stale ones, their refresh, and upserts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import service_stats

BATCH = 50
STALE_SECONDS = 3600


def stale(entities: DataFrame, stats: DataFrame, before: Column, key: str = "torrent_id", limit: int = BATCH) -> DataFrame:
    """The entities whose statistics are oldest, those without any first; ties go by key."""
    both = entities.join(stats.select(key, "updated_at"), key, "left").where((F.col("updated_at") < before) | F.col("updated_at").isNull())
    return both.orderBy(F.col("updated_at").asc_nulls_first(), key).limit(limit)


def upsert(state: DataFrame, changes: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """state with the changed keys' rows replaced; of several changes to a key the last by `order` counts."""
    if order:
        best = F.max_by(F.struct(*changes.columns), F.col(order))
        changes = changes.groupBy(key).agg(best.alias("best")).select("best.*")
    return state.join(changes.select(key), key, "left_anti").unionByName(changes.select(state.columns))


def refreshed(entities: DataFrame, fetched: DataFrame, tracker_url: str, now: Column) -> DataFrame:
    """tracker_stats rows for these entities (torrent_id, info_hash); what the service left out counts 0."""
    both = entities.select("torrent_id", "info_hash").join(fetched.select("info_hash", "seeders", "leechers"), "info_hash", "left")
    zero = F.lit(0).cast("long")
    return both.select("torrent_id", F.lit(tracker_url).alias("tracker_url"), F.coalesce("seeders", zero).alias("seeders"), F.coalesce("leechers", zero).alias("leechers"), now.cast("timestamp_ntz").alias("updated_at"))


def refresh(stats: DataFrame, entities: DataFrame, fetched: DataFrame | None, tracker_url: str, now: Column, zero_on_failure: bool = False) -> DataFrame:
    """stats after a refresh of these entities.

    fetched None: the service failed. Then a batch leaves stats as they are; a
    single refresh (zero_on_failure) writes 0.
    """
    if fetched is None:
        if not zero_on_failure:
            return stats
        fetched = entities.select("info_hash", F.lit(0).alias("seeders"), F.lit(0).alias("leechers")).limit(0)
    return upsert(stats, refreshed(entities, fetched, tracker_url, now), "torrent_id")


def refresh_each(stats: DataFrame, entities: DataFrame, fetch: Callable[[list[str]], list[dict]], tracker_url: str, now: Column) -> DataFrame:
    """stats after a refresh of all these entities with one request each, on the executors; what the service doesn't know counts 0."""
    return refresh(stats, entities, service_stats(entities, fetch, batch=1), tracker_url, now)


def is_alive(last_seen: Column, now: Column, interval: int, grace: int = 10) -> Column:
    """Whether a periodic task was seen within its interval and the grace seconds."""
    return F.unix_timestamp(now) - F.unix_timestamp(last_seen) <= interval + grace


def liveness_changes(beats: DataFrame, until: Column, interval: int, grace: int = 10) -> DataFrame:
    """Changes (job, at, alive) up to `until` (seconds) from beats(job, at seconds); the batch form of `liveness_stream`.

    A job is alive from a beat on, and dead from the first second that is over
    interval and grace later, unless it beats by then. Repeated beats count
    once; those without a time don't.
    """
    limit = interval + grace
    w = Window.partitionBy("job").orderBy("at")
    held = beats.where(F.col("at").isNotNull() & (F.col("at") <= until)).select(F.col("job").cast("long").alias("job"), F.col("at").cast("long").alias("at")).distinct()
    near = held.select("job", "at", F.lag("at").over(w).alias("before"), F.lead("at").over(w).alias("after"))
    start = F.when(F.col("before").isNull() | (F.col("at") > F.col("before") + limit + 1), F.struct("at", F.lit(True).alias("alive")))
    end = F.when((F.coalesce("after", until + 1) > F.col("at") + limit + 1), F.struct((F.col("at") + limit + 1).alias("at"), F.lit(False).alias("alive")))
    return near.select("job", F.explode(F.array_compact(F.array(start, end))).alias("c")).select("job", "c.at", "c.alive")
