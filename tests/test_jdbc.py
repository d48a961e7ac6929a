from __future__ import annotations

import io
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from tesserae.sources import jdbc as J
from tesserae.sources.tables import connect

URL = "jdbc:derby:memory:catalogue;create=true"
DRIVER = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


@pytest.fixture(scope="module")
def rows(spark):
    """Keys that crowd at one end, one that many rows have, rows without a key."""
    crowd = [(i, f"t{i}", i % 7) for i in range(300)] + [(10**12 + i, "far", 1) for i in range(5)] + [(77, "hot", 2)] * 200 + [(None, "none", 3)] * 9 + [(-5, "low", 4)]
    spark.createDataFrame(crowd, "ID long, TITLE string, KIND int").coalesce(1).write.jdbc(URL, "CROWD", properties=DRIVER)
    spark.createDataFrame([], "ID long, TITLE string, KIND int").write.jdbc(URL, "NOTHING", properties=DRIVER)
    return crowd


def explained(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def same(df, rows):
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, rows))


def test_tables_are_read_by_several_tasks_of_like_size(spark, rows):
    df = J.partitioned(spark, URL, "CROWD", "ID", 6, **DRIVER)
    same(df, rows)
    sizes = [r[0] for r in df.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert 4 <= df.rdd.getNumPartitions() <= 12 and max(sizes) <= 210  # the hot key's rows can't be parted
    cut = J.ranges(spark, URL, "CROWD", "ID", 6, **DRIVER)
    assert cut == sorted(cut) and all(a[1] < b[0] for a, b in zip(cut, cut[1:]))
    same(J.partitioned(spark, URL, "NOTHING", "ID", **DRIVER), [])


def test_filters_and_aggregates_are_pushed(spark, rows):
    df = J.partitioned(spark, URL, "CROWD", "ID", 6, **DRIVER).where("kind = 4")
    assert "EqualTo(KIND,4)" in explained(df).replace("kind", "KIND")
    same(df, [r for r in rows if r[2] == 4])
    table = J.jdbc_table(spark, URL, "APP.CROWD", **DRIVER)
    counted = table.groupBy("KIND").agg(F.count("*").alias("n"))
    plan = explained(counted)
    assert "PushedAggregates: [COUNT(*)]" in plan and "PushedGroupByExpressions" in plan
    assert {r.KIND: r.n for r in counted.collect()} == {k: sum(r[2] == k for r in rows) for k in range(7)}
    found = table.where("id = 77 and kind = 2").select("title")
    assert "PushedFilters: [ID IS NOT NULL" in explained(found) or "ID = 77" in explained(found)
    assert found.count() == 201 - (77 % 7 != 2)


def test_top_rows_are_picked_by_the_database(spark, rows):
    df = J.top(spark, URL, "CROWD", "ID", 3, descending=False, **DRIVER)
    assert [r[0] for r in df.collect()] == [-5, 0, 1]
    assert "FETCH FIRST 3 ROWS ONLY" in explained(df)


def test_names_are_checked(spark):
    with pytest.raises(ValueError):
        J.jdbc_table(spark, URL, "CROWD; DROP TABLE CROWD", **DRIVER)
    with pytest.raises(ValueError):
        J.top(spark, URL, "CROWD", "ID) --", 3, **DRIVER)


def test_connect_reads_databases_by_url(spark, rows):
    assert connect(spark, URL)("CROWD").count() == len(rows)
