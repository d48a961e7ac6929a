from __future__ import annotations

import datetime as dt
import io
import math
import random
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from tesserae.plans import listing as L
from tesserae.plans import seek as S
from tesserae.plans.listing import Catalogue, ListingRequest, Sorting, listing, specify
from tesserae.sources.storage import stored


def rows(kind, n=1500, seed=1):
    rng = random.Random(seed)
    make = {
        "long": lambda: rng.choice([7, 7, 7, rng.randrange(-50, 50), None, None]),
        "double": lambda: rng.choice([rng.gauss(0, 1e9), 0.1, -0.0, 0.0, math.nan, math.inf, -math.inf, None]),
        "string": lambda: rng.choice(["", "a", "Ab", "漢字", "é", "z" * rng.randrange(9), None]),
        "timestamp_ntz": lambda: rng.choice([dt.datetime(2024, 3, 31, 2, 30) + dt.timedelta(microseconds=rng.randrange(10**13)), dt.datetime(2024, 10, 27, 2, 30), None]),
    }[kind]
    return [(i, make()) for i in range(n)]


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(S, "SORT_ROWS", 40)
    monkeypatch.setattr(S, "BUCKETS", 8)
    monkeypatch.setattr(S, "SAMPLED", 32)


@pytest.mark.parametrize("kind", ["long", "double", "string", "timestamp_ntz"])
@pytest.mark.parametrize("descending", [False, True])
def test_pages_are_those_of_the_whole_order(spark, small, kind, descending):
    df = stored(spark.createDataFrame(rows(kind), f"entity_id long, k {kind}").repartition(3), "rows")
    whole = [r[0] for r in df.orderBy(*S.ordering("k", descending)).select("entity_id").collect()]
    for offset, size in ((110, 10), (777, 30), (1350, 10), (1495, 30), (9999, 5)):
        got = S.seek(df, "k", descending, offset, size)
        assert got.columns == ["key", "entity_id"]
        assert [r.entity_id for r in got.collect()] == whole[offset : offset + size], (offset, size)


def test_repeated_and_no_rows(spark, small):
    df = spark.createDataFrame([(1, 5)] * 300 + [(2, 6)], "entity_id long, k long")
    assert [tuple(r) for r in S.seek(df, "k", False, 298, 9).collect()] == [(5, 1), (5, 1), (6, 2)]
    assert S.seek(df.limit(0), "k", False, 0, 9).count() == 0


def test_filters_reach_the_scan_and_few_rows_are_sorted(spark, small):
    df = stored(spark.range(5000).select(F.col("id").alias("entity_id"), (F.col("id") * 7 % 5000).alias("k")), "rows")
    found = S.seek(df, "k", True, 3000, 10)
    assert [r.key for r in found.collect()] == list(range(1999, 1989, -1))
    out = io.StringIO()
    with redirect_stdout(out):
        found.explain("formatted")
    assert "LessThanOrEqual(k" in out.getvalue() and "GreaterThanOrEqual(k" in out.getvalue()


@pytest.mark.parametrize("fan_out", [False, True])
def test_deep_pages_of_the_listing(spark, small, monkeypatch, fan_out):
    rng = random.Random(3)
    entities = spark.createDataFrame([(i, rng.choice("abcd") * rng.randrange(1, 4), "u", "c", rng.randrange(20), dt.datetime(2024, 1, 1 + i % 9)) for i in range(300)], "entity_id long, title string, uploader string, category string, size long, uploaded timestamp_ntz")
    stats = spark.createDataFrame([(i, rng.randrange(5), rng.randrange(5)) for i in range(0, 300, 2) for _ in range(i % 3)], "entity_id long, seeders long, leechers long")
    tags = spark.createDataFrame([(i, t) for i in range(0, 300) for t in "xy"[: i % 3]], "entity_id long, tag string")
    names = spark.createDataFrame([("x",), ("y",), ("c",)], "name string")
    held = Catalogue(entities, stats, tags, names, names)
    for sort in (Sorting.SEEDERS_DESC, Sorting.NAME_ASC, Sorting.UPLOADED_DESC):
        spec = specify(ListingRequest(sort=sort, tags="x,y", page=13))
        monkeypatch.setattr(L, "SEEK_FROM", 10**9)
        want = listing(held, spec, fan_out).collect()
        monkeypatch.setattr(L, "SEEK_FROM", 100)
        assert listing(held, spec, fan_out).collect() == want and len(want) == 10
