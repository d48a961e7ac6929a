from __future__ import annotations

import datetime as dt

import pytest

from tesserae.plans.listing import Catalogue, ListingRequest, Sorting, items, listing, specify, total

DAY = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def catalogue(spark):
    entities = spark.createDataFrame(
        [(1, "Alpha 100%", "ann", "movies", 10, DAY), (2, "beta_one", "bob", None, 10, DAY), (3, "Beta two", "ann", "music", 30, DAY + dt.timedelta(1)), (4, "it's", "cyd", "music", 5, DAY)],
        "entity_id long, title string, uploader string, category string, size long, uploaded timestamp_ntz",
    )
    stats = spark.createDataFrame([(1, 5, 1), (1, 2, 1), (3, 9, 0)], "entity_id long, seeders long, leechers long")
    tags = spark.createDataFrame([(1, "x"), (1, "y"), (3, "x")], "entity_id long, tag string")
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "name string")
    return Catalogue(entities, stats, tags, names("movies", "music", "o'brien"), names("x", "y", "z"))


def ids(df):
    return [r.entity_id for r in df.collect()]


def page(catalogue, fan_out=False, **kw):
    return listing(catalogue, specify(ListingRequest(**kw)), fan_out)


def test_default_sort_is_newest_first_with_id_tie_break(catalogue):
    assert ids(page(catalogue)) == [3, 1, 2, 4]


@pytest.mark.parametrize("sort,expected", [
    (Sorting.SIZE_ASC, [4, 1, 2, 3]), (Sorting.SIZE_DESC, [3, 1, 2, 4]), (Sorting.SEEDERS_DESC, [3, 1, 2, 4]), (Sorting.SEEDERS_ASC, [2, 4, 1, 3]),
    (Sorting.LEECHERS_DESC, [1, 2, 3, 4]), (Sorting.NAME_ASC, [1, 3, 2, 4]), (Sorting.NAME_DESC, [4, 2, 3, 1]), (Sorting.UPLOADED_ASC, [1, 2, 4, 3]),
])
def test_sorts(catalogue, sort, expected):
    assert ids(page(catalogue, sort=sort)) == expected


def test_stats_are_summed_and_zero_where_missing(catalogue):
    got = {r.entity_id: (r.seeders, r.leechers) for r in page(catalogue).collect()}
    assert got == {1: (7, 2), 2: (0, 0), 3: (9, 0), 4: (0, 0)}


def test_search_ignores_case_and_keeps_wildcards(catalogue):
    assert ids(page(catalogue, search="BETA")) == [3, 2]
    assert ids(page(catalogue, search="a_o")) == [2]
    assert ids(page(catalogue, search="100\\")) == []
    assert ids(page(catalogue, search="")) == [3, 1, 2, 4]


def test_filters_mean_any_and_unknown_names_are_dropped(catalogue):
    assert ids(page(catalogue, categories="movies, music")) == [3, 1, 4]
    assert ids(page(catalogue, categories="o'brien")) == []
    assert ids(page(catalogue, categories="nope")) == [3, 1, 2, 4]
    assert ids(page(catalogue, tags="x,y,nope")) == [3, 1]


def test_fan_out_multiplies_stats(catalogue):
    got = {r.entity_id: r.seeders for r in page(catalogue, True, tags="x,y").collect()}
    assert got == {1: 14, 3: 9}


def test_pages_and_total(catalogue):
    assert ids(page(catalogue, page=1, page_size=3)) == [4]
    assert ids(page(catalogue, page_size=0)) == []
    assert total(catalogue, specify(ListingRequest(page_size=0))).first().total == 4


def test_request_defaults_and_bounds():
    spec = specify(ListingRequest(page=2, page_size=100))
    assert (spec.page_size, spec.offset, spec.sort) == (30, 60, Sorting.UPLOADED_DESC)
    assert specify(ListingRequest()).page_size == 10
    assert items(" ") == () and items("a, ,b") == ("a", "", "b")
    with pytest.raises(ValueError):
        specify(ListingRequest(page=-1))
