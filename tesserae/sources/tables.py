"""Readers: Parquet and JDBC tables, metainfo files, and an external statistics service."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from .. import schemas
from ..functions.metainfo import decode_metainfo, encode, encode_metainfo, synthetic


class NotFound(LookupError):
    """A point lookup without a row."""


def connect(spark: SparkSession, url: str) -> Callable[[str], DataFrame]:
    """A reader of tables by name: jdbc:… URLs through JDBC, anything else a folder of Parquet tables.

    A table that a Parquet folder doesn't have yet is empty, with its schema.
    """
    if url.startswith("jdbc:"):
        return lambda name: spark.read.format("jdbc").option("url", url).option("dbtable", name).load()

    def read(name: str) -> DataFrame:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{url}/{name}.parquet")
        there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
        return spark.read.parquet(f"{url}/{name}.parquet") if there or name not in schemas.TABLES else schemas.empty(spark, name)

    return read


def backup(tables: dict[str, DataFrame], url: str) -> None:
    """Copy tables into a folder that connect() reads; it must not have them yet."""
    for name, df in tables.items():
        df.write.parquet(f"{url}/{name}.parquet")


def restore(spark: SparkSession, url: str) -> dict[str, DataFrame]:
    """All tables of a folder, those it doesn't have being empty."""
    read = connect(spark, url)
    return {name: read(name) for name in schemas.TABLES}


def one(df: DataFrame, what: str) -> dict:
    """The row of a point lookup, for the edge of an application."""
    rows = df.limit(1).collect()
    if not rows:
        raise NotFound(what)
    return rows[0].asDict(recursive=True)


def metainfo_files(spark: SparkSession, path: str) -> DataFrame:
    """path, error, info_hash, original_info_hash, torrent of each file; bad files have an error and no document."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", decode_metainfo("content").alias("d")).select("path", "d.*")


def metainfo_responses(torrents: DataFrame, hash_header: str = "x-info-hash") -> DataFrame:
    """filename, headers and content of the files of torrents(info_hash, torrent): what a download answers."""
    name = F.concat("torrent.info.name", F.lit(".torrent"))
    headers = F.create_map(F.lit("content-type"), F.lit("application/x-bittorrent"), F.lit("content-disposition"), F.concat(F.lit("attachment; filename="), name), F.lit(hash_header), F.col("info_hash"))
    return torrents.select("info_hash", name.alias("filename"), headers.alias("headers"), encode_metainfo("torrent").alias("content"))


STATS_SCHEMA = "info_hash string, seeders long, completed long, leechers long"


def service_stats(hashes: DataFrame, fetch: Callable[[list[str]], list[dict]], batch: int = 50) -> DataFrame:
    """Statistics of each info_hash from a service: one call of `fetch` for each batch, on the executors.

    fetch gets hashes and returns rows of STATS_SCHEMA; hashes it leaves out have no row.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["info_hash", "seeders", "completed", "leechers"]
        for frame in frames:
            for i in range(0, len(frame), batch):
                yield pd.DataFrame(fetch(frame["info_hash"].iloc[i : i + batch].tolist()), columns=names)

    return hashes.select("info_hash").mapInPandas(run, STATS_SCHEMA)


def parse_stats(df: DataFrame, column: str) -> DataFrame:
    """Rows of STATS_SCHEMA from a JSON array of statistics; bad JSON gives none."""
    parsed = F.from_json(F.col(column), f"array<struct<{', '.join(x.replace(' ', ':', 1) for x in STATS_SCHEMA.replace('long', 'bigint').split(', '))}>>")
    return df.select(F.inline(parsed))


@F.arrow_udf(BinaryType())
def synthetic_document(uuid: pa.Array) -> pa.Array:
    """The bytes of a small one-file document for each UUID."""
    return pa.array([encode(synthetic(u)) for u in uuid.to_pylist()], pa.binary())


def synthetic_uploads(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """uuid, title, content of n random-looking uploads, the same for a seed: what a test catalogue is filled with."""
    h = F.md5(F.concat_ws("|", F.lit(seed), "id").cast("binary"))
    uuid = F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5").alias("uuid")
    rows = spark.range(n).select(uuid)
    return rows.select("uuid", F.concat(F.lit("title-"), "uuid").alias("title"), synthetic_document("uuid").alias("content"))


def seed_catalogue(spark: SparkSession, n: int, upload: Callable[[DataFrame], None], seconds: float = 0, seed: int = 0) -> None:
    """Hand n synthetic uploads to `upload`, one at a time with a pause between two; all at once where there is none."""
    if not seconds:
        upload(synthetic_uploads(spark, n, seed))
        return
    for i in range(n):
        if i:
            time.sleep(seconds)
        upload(synthetic_uploads(spark, n, seed).offset(i).limit(1))
