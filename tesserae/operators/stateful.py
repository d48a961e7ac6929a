"""Ordered folds: per-user quotas and a first-in first-out byte cache.

Rows of a key are streamed in order through one task with a small state, never
gathered, so memory is bounded however many rows a key has.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST = (1 << 63) - 1
#: The types of images that may be cached.
IMAGE_TYPES = ("image/jpeg", "image/png")


@dataclass
class Quota:
    """Bytes a user may take in a period that starts with the first use after the last one ended."""

    most: int
    period: int
    used: int = 0
    start: int | None = None

    def take(self, now: int, size: int) -> bool:
        """Whether the use is allowed; it counts if so. It is refused only once the quota is used up already."""
        if self.start is None or now - self.start > self.period:
            self.used, self.start = 0, now
        if self.used >= self.most:
            return False
        self.used = min(MOST, self.used + size)
        return True


@dataclass
class ByteCache:
    """Entries in order of arrival, dropped oldest first when a new one needs room. A hit changes no order."""

    capacity: int
    entry_limit: int
    entries: OrderedDict[str, int] = field(default_factory=OrderedDict)
    held: int = 0

    def put(self, key: str, size: int) -> bool:
        """Store an entry; one that is too large is refused, and its older version stays only if it is over the limit."""
        if size > self.entry_limit:
            return False
        self.held -= self.entries.pop(key, 0)
        if size > self.capacity:
            return False
        while self.capacity - self.held < size:
            self.held -= self.entries.popitem(last=False)[1]
        self.entries[key] = size
        self.held += size
        return True


@dataclass
class CachedReads:
    """Reads through a cache: a hit costs nothing and changes no order; a miss is fetched if the user's quota is not used up.

    A quota's period is looked at only when a fetched entry is added to it.
    """

    capacity: int
    entry_limit: int
    most: int
    period: int
    cache: ByteCache = field(init=False)
    quotas: dict[int, Quota] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.cache = ByteCache(self.capacity, self.entry_limit)

    def read(self, now: int, user: int, key: str, size: int, type_ok: bool) -> str:
        if key in self.cache.entries:
            return "hit"
        quota = self.quotas.get(user)
        if quota and quota.used >= quota.most:
            return "quota met"
        if not type_ok:
            return "no image"
        if not self.cache.put(key, size):
            return "too big"
        quota = self.quotas.setdefault(user, Quota(self.most, self.period, 0, now))
        quota.take(now, size)
        return "fetched"


def quota_fold(uses: DataFrame, most: int, period: int) -> DataFrame:
    """uses(user_id, at seconds, use_id, size) with `allowed` and the user's `used` bytes after it. Uses without a user share one quota."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user, quota = None, Quota(most, period)
        for batch in batches:
            allowed, used = [], []
            for who, at, size in zip(*(batch.column(c).to_pylist() for c in ("user_id", "at", "size"))):
                if who != user:
                    user, quota = who, Quota(most, period)
                allowed.append(quota.take(at, size))
                used.append(quota.used)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(allowed, pa.bool_()), pa.array(used, pa.int64())], [*batch.schema.names, "allowed", "used"])

    rows = uses.select("user_id", "at", "use_id", "size").repartition("user_id").sortWithinPartitions("user_id", "at", "use_id")
    return rows.mapInArrow(run, "user_id long, at long, use_id long, size long, allowed boolean, used long")


def cache_fold(puts: DataFrame, capacity: int, entry_limit: int) -> DataFrame:
    """puts(cache, at, key, size), with `stored`: whether each was taken in. Keys may come again."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, cache = None, ByteCache(capacity, entry_limit)
        for frame in frames:
            stored = []
            for which, key, size in zip(frame["cache"], frame["key"], frame["size"]):
                if which != name:
                    name, cache = which, ByteCache(capacity, entry_limit)
                stored.append(cache.put(key, size))
            yield frame.assign(stored=stored)

    rows = puts.select("cache", "at", "key", "size").repartition("cache").sortWithinPartitions("cache", "at", "key")
    return rows.mapInPandas(run, "cache long, at long, key string, size long, stored boolean")


def read_fold(reads: DataFrame, capacity: int, entry_limit: int, most: int, period: int) -> DataFrame:
    """reads(cache, at, user_id, key, size, content_type) with their `outcome`: hit, quota met, no image, too big or fetched."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, state = None, CachedReads(capacity, entry_limit, most, period)
        for frame in frames:
            outcome = []
            for which, at, user, key, size, able in zip(*(frame[c] for c in ("cache", "at", "user_id", "key", "size", "able"))):
                if which != name:
                    name, state = which, CachedReads(capacity, entry_limit, most, period)
                outcome.append(state.read(at, user, key, size, able))
            yield frame.drop(columns="able").assign(outcome=outcome)

    able = F.coalesce(F.col("content_type").isin(*IMAGE_TYPES), F.lit(False)).alias("able")
    rows = reads.select("cache", "at", "user_id", "key", "size", able).repartition("cache").sortWithinPartitions("cache", "at", "user_id", "key")
    return rows.mapInPandas(run, "cache long, at long, user_id long, key string, size long, outcome string")


def cache_content(puts: DataFrame, capacity: int, entry_limit: int, cache: str = "cache", at: str = "at") -> DataFrame:
    """What each cache holds after these puts of distinct keys: the longest run of last ones that fits.

    An entry that fits the cache alone always gets in, and drops only older
    ones, so the sizes from an entry to the end tell whether it is still there.
    """
    w = Window.partitionBy(cache).orderBy(F.col(at).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    able = puts.where(F.col("size") <= min(capacity, entry_limit))
    return able.withColumn("_run", F.sum("size").over(w)).where(F.col("_run") <= capacity).drop("_run")


def accepted_types(df: DataFrame, column: str = "content_type") -> DataFrame:
    """Rows of the image types that may be cached."""
    return df.where(F.col(column).isin(*IMAGE_TYPES))
