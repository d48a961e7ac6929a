"""A page deep in an order, without sorting what is ahead of it.

A range histogram finds the page: boundaries from a bounded sample cut the rows,
in order of key and id, into buckets; their counts, added up, say which buckets
hold the page; those are cut again, until few enough rows are left to sort. A
pass is a filter, which reaches the scan, and a count: nothing is shuffled but
counts, no task holds a bucket, and the number of passes follows the logarithm of
the table, not the offset. Boundaries only steer the search: counts are exact, so
the page is. A key that very many rows share is cut by id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that are sorted at last; buckets of a pass; sampled rows that its boundaries are taken from, about.
SORT_ROWS, BUCKETS, SAMPLED = 10_000, 64, 4096
_STEPS = 1 << 30


def ordering(key: str, descending: bool) -> list[Column]:
    """By the key, nulls as the least, then by entity_id."""
    return [F.col(key).desc_nulls_last() if descending else F.col(key).asc_nulls_first(), F.col("entity_id").asc()]


class _Boundary:
    """A row that cuts the order, as literals."""

    def __init__(self, rows: DataFrame, key: str | None, entity_id: str) -> None:
        kinds = dict(rows.dtypes)
        self.text = (key, entity_id)
        self.key = None if key is None else F.lit(key).cast(kinds["key"])
        self.id = F.lit(entity_id).cast(kinds["entity_id"])

    def reached(self, descending: bool) -> Column:
        """Whether a row is this one or comes after it."""
        key, later = F.col("key"), F.col("entity_id") >= self.id
        if self.key is None:
            return key.isNull() & later if descending else key.isNotNull() | later
        after = key < self.key if descending else key > self.key
        out = F.coalesce(after | ((key == self.key) & later), F.lit(False))
        return out | key.isNull() if descending else out


def _between(low: _Boundary | None, high: _Boundary | None, descending: bool) -> Column:
    """Rows from `low` on that don't reach `high`, with plain bounds of the key for the scan."""
    out = F.lit(True)
    end = high if descending else low
    nulls_too = end is None or end.key is None  # nulls are the least
    for cut, at_least in ((low, not descending), (high, descending)):
        if cut and cut.key is not None and not (nulls_too and not at_least):
            out = out & (F.col("key") >= cut.key if at_least else F.col("key") <= cut.key)
    if low:
        out = out & low.reached(descending)
    return out & ~high.reached(descending) if high else out


def _boundaries(rows: DataFrame, count: int, descending: bool, turn: int) -> list[_Boundary]:
    """Rows that cut these into about equal parts, in order and each once."""
    share = min(_STEPS, SAMPLED * _STEPS // max(1, count))
    sampled = rows.where(F.pmod(F.xxhash64("entity_id", F.lit(turn)), F.lit(_STEPS)) < share).limit(4 * SAMPLED)
    found = sampled.orderBy(*ordering("key", descending)).select(F.col("key").cast("string"), F.col("entity_id").cast("string")).collect()
    picked = dict.fromkeys(tuple(found[len(found) * i // BUCKETS]) for i in range(1, BUCKETS) if found)
    return [_Boundary(rows, *p) for p in picked]


def seek(rows: DataFrame, key: str, descending: bool, offset: int, size: int) -> DataFrame:
    """key and entity_id of rows offset to offset + size of the order, in order. rows should be cheap to read several times."""
    everything = kept = rows.select(F.col(key).alias("key"), "entity_id")
    count, turn, low, high = kept.count(), 0, None, None
    while count > SORT_ROWS and offset < count and size:
        cuts = _boundaries(kept, count, descending, turn)
        turn += 1
        place = reduce(lambda a, c: a + c.reached(descending).cast("int"), cuts, F.lit(0))
        counts = dict(map(tuple, kept.groupBy(place.alias("bucket")).count().collect()))  # a row a bucket
        first, ahead = 0, 0
        while offset >= ahead + counts.get(first, 0):
            ahead, first = ahead + counts.get(first, 0), first + 1
        last, inside = first, counts.get(first, 0)
        while offset + size > ahead + inside and last < len(cuts):
            last += 1
            inside += counts.get(last, 0)
        if inside == count:  # one row, many times over
            break
        low, high = cuts[first - 1] if first else low, cuts[last] if last < len(cuts) else high
        kept = everything.where(_between(low, high, descending))
        offset, count = offset - ahead, inside
    return kept.orderBy(*ordering("key", descending)).offset(offset).limit(size)
