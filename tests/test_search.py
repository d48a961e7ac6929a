from __future__ import annotations

import io
import random
import re
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from tesserae.functions.scalar import like_pattern
from tesserae.plans import search
from tesserae.plans.listing import Catalogue, ListingRequest, listing, specify
from tesserae.plans.search import TitleIndex, grams, wanted_grams
from tesserae.sources.storage import new_path

SCHEMA = "entity_id long, title string, size long, _segment int"
SEARCHES = ("ABC", "a_cA", "ab%cab", "ΟΔΟΣ", "100%", "x\\y", "%", "nothing of it", "İst", "straße")


def titles(n=400, seed=4):
    rng = random.Random(seed)
    fixed = ["ΟΔΟΣ", "ΟΔΟΣΑ", "Οδός", "100% abc", "x\\y", "İstanbul", "STRASSE straße", "日本語の本", None, "", "ab", "a' OR 1=1 --", "abc" * 3000]
    return [(i, t, i, 0) for i, t in enumerate(fixed + ["".join(rng.choices("abcABC ", k=rng.randrange(0, 12))) for _ in range(n)])]


def plain(df, text):
    return sorted(r.entity_id for r in df.where(F.col("title").ilike(like_pattern(text))).collect())


def ids(df):
    return sorted(r.entity_id for r in df.collect())


@pytest.fixture(scope="module", autouse=True)
def few_folders():
    patch = pytest.MonkeyPatch()
    patch.setattr(search, "GRAM_FOLDERS", 3)
    patch.setattr(search, "ENTITY_FOLDERS", 3)
    yield
    patch.undo()


@pytest.fixture(scope="module")
def entities(spark):
    return spark.createDataFrame(titles(), "entity_id long, title string, size long, extra int")


@pytest.mark.parametrize("few", [100_000, -1])
def test_index_finds_what_a_scan_finds(spark, entities, monkeypatch, few):
    monkeypatch.setattr(search, "FEW", few)
    index = TitleIndex.build(entities, new_path(spark, "titles"))
    for text in SEARCHES[:: 1 if few > 0 else 4]:
        assert ids(index.matching(text)) == plain(entities, text), text
    assert index.matching("abc").columns == entities.columns


def test_refresh_and_compaction(spark, entities):
    index = TitleIndex.build(entities, new_path(spark, "titles"))
    changed = spark.createDataFrame([(0, "abc now", 1, 1), (3, None, 1, 1), (20, "zzz yyy", 1, 1), (9000, "brand new abc", 1, 1)], entities.schema)
    gone = spark.createDataFrame([(1,), (1,), (7,), (30,), (12345,)], "entity_id long")
    index.refresh(changed, gone)
    index.refresh(changed.limit(0))
    index.refresh(changed.where("entity_id = 20").withColumn("title", F.lit("abc again")))
    want = entities.where(~F.col("entity_id").isin(0, 3, 20, 1, 7, 30)).unionByName(changed.withColumn("title", F.when(F.col("entity_id") == 20, "abc again").otherwise(F.col("title"))))
    for step in range(2):
        assert ids(index.entities()) == ids(want)
        for text in ("abc", "zzz", "again"):
            assert ids(index.matching(text)) == plain(want, text), (step, text)
        index.compact()
    assert len(index.parts.numbers()) == 1
    index.refresh(changed.limit(0), spark.createDataFrame([(9000,)], "entity_id long"))
    assert ids(index.matching("brand")) == []


def test_a_segment_without_commit_does_not_count(spark, entities, monkeypatch):
    index = TitleIndex.build(entities, new_path(spark, "titles"))
    before = ids(index.matching("abc"))
    monkeypatch.setattr(search, "grams", lambda c: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        index.refresh(spark.createDataFrame([(0, "abc now", 1, 1)], entities.schema))
    monkeypatch.undo()
    assert ids(index.matching("abc")) == before and index.parts.numbers() == [0]
    index.refresh(spark.createDataFrame([(0, "abc now", 1, 1)], entities.schema))
    assert ids(index.matching("abc")) == sorted({0, *before})
    with pytest.raises(ValueError):
        TitleIndex.build(entities, index.path)


def test_empty_index(spark, entities):
    index = TitleIndex.build(entities.limit(0), new_path(spark, "titles"))
    assert ids(index.matching("abc")) == [] and ids(index.matching("a")) == []


def test_search_reads_only_its_postings_and_the_folders_of_its_candidates(spark, entities):
    index = TitleIndex.build(entities, new_path(spark, "titles"))
    out = io.StringIO()
    with redirect_stdout(out):
        index.matching("日本語").explain("formatted")
    plan = out.getvalue()
    assert len(re.findall(r"PartitionFilters: \[[^\n]*_folder#\d+ (?:IN|=)", plan)) == 2  # postings and entities
    assert "In(gram" in plan or "EqualTo(gram" in plan


def test_grams(spark):
    got = {r[0]: r[1] for r in spark.createDataFrame([("abcabc",), ("ab",), ("",), (None,), ("日本語x",)], "t string").select("t", grams(F.col("t"))).collect()}
    assert got == {"abcabc": ["abc", "bca", "cab"], "ab": None, "": None, None: None, "日本語x": ["日本語", "本語x"]}
    assert wanted_grams(spark, "Ab_ABCD%x\\yz") == ["\\yz", "abc", "bcd", "x\\y"]


def test_listing_through_an_index(spark, entities):
    stats = spark.createDataFrame([(0, 5, 1), (3, 2, 1)], "entity_id long, seeders long, leechers long")
    tags = spark.createDataFrame([(3, "x")], "entity_id long, tag string")
    names = spark.createDataFrame([("x",)], "name string")
    base = entities.select("entity_id", "title", F.lit("u").alias("uploader"), F.lit("c").alias("category"), "size", F.lit("2024-01-01").cast("timestamp_ntz").alias("uploaded"))
    both = [Catalogue(base, stats, tags, names, names, i) for i in (None, TitleIndex.build(base, new_path(spark, "titles")))]
    for request in (ListingRequest(search="abc", page_size=30), ListingRequest(search="100%", tags="x"), ListingRequest(page=1)):
        a, b = (listing(c, specify(request)).collect() for c in both)
        assert a == b and a
