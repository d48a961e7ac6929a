"""Statistics sums that are kept, not counted again: signed changes, added up.

A change to statistics is a set of signed rows: an inserted row counts with plus,
a deleted one with minus, a replaced one with both. Their sums by entity are one
more part of the kept table; what an entity has is the sum of its parts. fold()
adds all parts up into one, laid out by entity, which readers then join without
any aggregation. A hot entity's rows are added up before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import Segments

KEPT = "entity_id long, seeders long, leechers long, n long"


def applied(stats: DataFrame, key: list[str], upserts: DataFrame | None = None, deletes: DataFrame | None = None) -> DataFrame:
    """stats after the changes: rows of upserts replace those with their key or are new, rows with a key of deletes go. An upserted key isn't deleted."""
    out = stats
    if deletes is not None:
        out = out.join(deletes.select(*key), key, "left_anti")
    if upserts is not None:
        out = out.join(upserts.select(*key), key, "left_anti").unionByName(upserts.select(*stats.columns))
    return out


def signed(stats: DataFrame, key: list[str], upserts: DataFrame | None = None, deletes: DataFrame | None = None) -> DataFrame:
    """entity_id, seeders, leechers and n, by which the changes to these stats change the sums and the number of rows.

    key identifies a row of stats and is unique among upserts. Only rows of stats
    with a changed key are looked at.
    """
    parts = []
    gone = [x.select(*key) for x in (upserts, deletes) if x is not None]
    if gone:
        keys = gone[0].unionByName(gone[1]) if len(gone) > 1 else gone[0]
        parts.append((stats.join(keys.distinct(), key, "left_semi"), -1))
    if upserts is not None:
        parts.append((upserts, 1))
    rows = [df.select("entity_id", *((F.coalesce(F.col(c).cast("long"), F.lit(0)) * sign).alias(c) for c in ("seeders", "leechers")), F.lit(sign).cast("long").alias("n")) for df, sign in parts]
    if not rows:
        return stats.select("entity_id", *(F.lit(0).cast("long").alias(c) for c in ("seeders", "leechers", "n"))).limit(0)
    return _added(rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1]))


def _added(rows: DataFrame) -> DataFrame:
    return rows.groupBy("entity_id").agg(*(F.sum(c).alias(c) for c in ("seeders", "leechers", "n")))


class KeptSums:
    """Sums of statistics by entity, in a folder of their own."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.parts = Segments(spark, path)

    def add(self, changes: DataFrame, whole: bool = False) -> None:
        """Add signed changes (entity_id, seeders, leechers, n), as signed() gives them: for a new table, those of all its rows."""
        number = self.parts.next("sums")
        changes.repartitionByRange("entity_id").sortWithinPartitions("entity_id").write.parquet(self.parts.at("sums", number))
        self.parts.commit(number, changes.schema, whole)

    def current(self) -> DataFrame:
        """entity_id, seeders and leechers of every entity that has statistics rows."""
        rows = self.parts.read("sums", KEPT).drop("_segment")
        if len(self.parts.numbers()) > 1:
            rows = _added(rows)
        return rows.where("n > 0").drop("n")

    def fold(self) -> None:
        """One part of all, without entities that have no rows left."""
        old = self.parts.numbers()
        self.add(_added(self.parts.read("sums", KEPT).drop("_segment")).where("n > 0"), whole=True)
        self.parts.forget(old, "sums")
