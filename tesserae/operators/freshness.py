"""Entities in the order of their last refresh, in pages, so that the oldest are found without reading the rest.

Pages follow each other by time of refresh, then key; entities never refreshed come
first. A list of pages has each one's first and last row and its number of rows. A
tick reads the pages that the oldest rows are in, mostly one; when these rows have
been refreshed, those pages are written again without them, and the rows go to a
page of their own at the end. The new list is written last and names every page by
its path, so a crash leaves the list before, or the one after. Small pages are put
together once there are many, so the list stays short.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import delete_path, names_in
from .stats import BATCH

PAGE_ROWS = 100_000
#: Pages of under half of PAGE_ROWS that are left as they are.
MOST_SMALL = 64
NEVER = -(1 << 62)
PAGES = "path string, first_at long, first_key long, last_at long, last_key long, n long"


def _micros(c: Column) -> Column:
    """Microseconds since 1970, NEVER for null: what pages are ordered by."""
    return F.coalesce(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c.cast("timestamp_ntz")), F.lit(NEVER))


class StaleQueue:
    """A folder of pages of (key, at). key is a long, unique."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    @classmethod
    def build(cls, entities: DataFrame, stats: DataFrame, path: str, key: str = "torrent_id") -> StaleQueue:
        """Pages of all entities; the last updated_at of an entity's statistics counts."""
        queue = cls(entities.sparkSession, path)
        last = stats.groupBy(key).agg(F.max("updated_at").alias("updated_at"))
        queue._commit(queue._written(entities.select(key).join(last, key, "left").select(F.col(key).cast("long").alias("key"), _micros(F.col("updated_at")).alias("at"))))
        return queue

    def _lists(self) -> list[int]:
        return sorted(int(n) for n in names_in(self.spark, f"{self.path}/lists") if "_SUCCESS" in names_in(self.spark, f"{self.path}/lists/{n}"))

    def pages(self) -> list[tuple]:
        """The present list, in order of the pages' first rows: path, first row, last row, number of rows. A row for each PAGE_ROWS entities."""
        rows = self.spark.read.schema(PAGES).parquet(f"{self.path}/lists/{self._lists()[-1]}").collect()
        return sorted(((r.path, (r.first_at, r.first_key), (r.last_at, r.last_key), r.n) for r in rows), key=lambda p: p[1:])

    def _written(self, rows: DataFrame) -> list[tuple]:
        """Write rows as pages, and give their part of the list."""
        parts = max(1, -(-rows.count() // PAGE_ROWS))
        name = f"pages/{uuid.uuid4().hex}"
        ordered = rows.repartitionByRange(parts, "at", "key").sortWithinPartitions("at", "key").withColumn("page", F.spark_partition_id())
        ordered.write.partitionBy("page").parquet(f"{self.path}/{name}")
        back = self.spark.read.schema("key long, at long, page int").parquet(f"{self.path}/{name}")
        row = F.struct("at", "key")
        found = back.groupBy("page").agg(F.min(row).alias("a"), F.max(row).alias("b"), F.count("*").alias("n")).collect()
        return [(f"{name}/page={r.page}", tuple(r.a), tuple(r.b), r.n) for r in found]

    def _commit(self, pages: list[tuple]) -> None:
        number = max((int(n) for n in names_in(self.spark, f"{self.path}/lists")), default=-1) + 1
        rows = [(p, *a, *b, n) for p, a, b, n in pages]
        self.spark.createDataFrame(rows, PAGES).coalesce(1).write.parquet(f"{self.path}/lists/{number}")

    def _read(self, pages: list[tuple]) -> DataFrame:
        return self.spark.read.schema("key long, at long").parquet(*(f"{self.path}/{p[0]}" for p in pages)) if pages else self.spark.createDataFrame([], "key long, at long")

    def _oldest_pages(self, limit: int) -> list[tuple]:
        """Pages that the oldest `limit` rows must be in: enough of the first, and any that begins before those end."""
        pages, held, last = self.pages(), 0, None
        for i, (_, a, b, n) in enumerate(pages):
            if held >= limit and (last is None or a > last):
                return pages[:i]
            held, last = held + n, b if last is None else max(last, b)
        return pages

    def oldest(self, before: Column, limit: int = BATCH) -> DataFrame:
        """key and at of the entities refreshed longest ago, or never, and not since `before`; ties go by key."""
        rows = self._read(self._oldest_pages(limit)).where(F.col("at") < _micros(before))
        return rows.orderBy("at", "key").limit(limit)

    def refreshed(self, batch: DataFrame, now: Column) -> None:
        """Note that these entities, as oldest() gave them (key, at), were refreshed now. Only pages that they are in are written again."""
        rows = sorted((r.at, r.key) for r in batch.select("key", "at").collect())  # a batch
        if not rows:
            return
        pages = self.pages()
        touched = [p for p in pages if any(p[1] <= r <= p[2] for r in rows)]
        rest = [p for p in pages if p not in touched]
        keys = [k for _, k in rows]
        small = [p for p in rest if 2 * p[3] < PAGE_ROWS]
        if len(small) > MOST_SMALL:
            rest, touched = [p for p in rest if p not in small], touched + small
        held = self._read(touched)
        moved = held.where(F.col("key").isin(keys)).withColumn("at", _micros(now))
        kept = held.where(~F.col("key").isin(keys))
        self._commit(rest + self._written(kept) + self._written(moved))

    def tidy(self) -> None:
        """Delete pages and lists that the present list doesn't name: what earlier readers may still read goes."""
        present = {p[0] for p in self.pages()}
        for number in self._lists()[:-1]:
            delete_path(self.spark, f"{self.path}/lists/{number}")
        for folder in names_in(self.spark, f"{self.path}/pages"):
            for name in names_in(self.spark, f"{self.path}/pages/{folder}"):
                if name.startswith("page=") and f"pages/{folder}/{name}" not in present:
                    delete_path(self.spark, f"{self.path}/pages/{folder}/{name}")
