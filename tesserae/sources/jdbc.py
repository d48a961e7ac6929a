"""Tables of a database, read by several tasks, with filters, counts and top rows left to the database.

Reads go through a catalog of the database, so Spark pushes filters, columns and
aggregates down (and limits, where Spark's dialect has them). A table is cut at
ranges of a numeric key. Ranges of equal width would give one task most rows where
keys crowd, so the database counts the keys of many bins, one grouped query, and
bins are put together to ranges of about equal counts; a bin with too many rows is
counted again in finer ones. No more than a few thousand counts reach the driver.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARTS, BINS = 8, 256
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def _options(url: str, options: dict[str, str]) -> dict[str, str]:
    return {"url": url} | options


def catalog(spark: SparkSession, url: str, **options: str) -> str:
    """Name of a session catalog of the database, with pushing down turned on."""
    name = f"db_{hashlib.sha1(repr((url, sorted(options.items()))).encode()).hexdigest()[:12]}"
    key = f"spark.sql.catalog.{name}"
    if not spark.conf.get(key, None):
        pushed = {f"pushDown{what}": "true" for what in ("Predicate", "Aggregate", "Limit", "Offset", "TableSample")}
        for option, value in (_options(url, options) | pushed).items():
            spark.conf.set(f"{key}.{option}", value)
        spark.conf.set(key, "org.apache.spark.sql.execution.datasources.v2.jdbc.JDBCTableCatalog")
    return name


def _checked(*names: str) -> tuple[str, ...]:
    for name in names:
        if not all(_NAME.fullmatch(part) for part in name.split(".")):
            raise ValueError(f"{name!r} is no name of a table or column")
    return names


def jdbc_table(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table (schema.name) by one task: for lookups, counts and pages, which the database answers."""
    _checked(table)
    return spark.read.table(f"{catalog(spark, url, **options)}.{table}")


def _query(spark: SparkSession, url: str, sql: str, options: dict[str, str]) -> DataFrame:
    return spark.read.format("jdbc").options(**_options(url, options)).option("query", sql).load()


def top(spark: SparkSession, url: str, table: str, order: str, k: int, descending: bool = False, **options: str) -> DataFrame:
    """The first k rows by a column, picked by the database: only they are sent. Spark keeps their order."""
    _checked(table, order)
    first = f"FETCH FIRST {int(k)} ROWS ONLY" if url.startswith(("jdbc:derby", "jdbc:oracle", "jdbc:db2")) else f"LIMIT {int(k)}"
    rows = _query(spark, url, f"SELECT * FROM {table} ORDER BY {order} {'DESC' if descending else 'ASC'} {first}", options)
    return rows.orderBy(F.desc(order) if descending else F.asc(order))


def _counts(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, options: dict[str, str]) -> list[tuple[int, int, int]]:
    """(first key, last key, rows) of the bins that low..high falls into and that have rows, in order."""
    width = -(-(high - low + 1) // BINS)
    sql = f"SELECT bin, COUNT(*) AS n FROM (SELECT ({key} - ({low})) / {width} AS bin FROM {table} WHERE {key} >= {low} AND {key} <= {high}) AS b GROUP BY bin"
    found = sorted((int(r[0]), int(r[1])) for r in _query(spark, url, sql, options).collect())  # at most BINS rows
    return [(low + b * width, min(high, low + (b + 1) * width - 1), n) for b, n in found]


def ranges(spark: SparkSession, url: str, table: str, key: str, parts: int, **options: str) -> list[tuple[int, int]]:
    """Up to about twice `parts` ranges of an integer key that hold all its values, each about as many rows as the others where keys allow it."""
    _checked(table, key)
    low, high, total = _query(spark, url, f"SELECT MIN({key}) AS lo, MAX({key}) AS hi, COUNT({key}) AS n FROM {table}", options).first()
    if not total:
        return []
    share, todo, bins = -(-int(total) // parts), [(int(low), int(high))], []
    while todo:
        for first, last, n in _counts(spark, url, table, key, *todo.pop(), options):
            if n > share and last > first:
                todo.append((first, last))  # at most `parts` bins have more than a share
            else:
                bins.append((first, last, n))
    out: list[tuple[int, int]] = []
    held = 0
    for first, last, n in sorted(bins):
        if out and held + n <= share:
            out[-1], held = (out[-1][0], last), held + n
        else:
            out.append((first, last))
            held = n
    return out


def partitioned(spark: SparkSession, url: str, table: str, key: str, parts: int = PARTS, **options: str) -> DataFrame:
    """A whole table by several tasks, one a range of the key; rows without a key go with the first. Filters reach the database."""
    cut = ranges(spark, url, table, key, parts, **options)
    if not cut:
        return spark.read.format("jdbc").options(**_options(url, options)).option("dbtable", table).load()
    where = [f"({key} >= {low} AND {key} <= {high})" for low, high in cut]
    where[0] = f"({where[0]} OR {key} IS NULL)"
    return spark.read.jdbc(url, table, predicates=where, properties=options)
