"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import json
import re
import shutil
import tempfile
import uuid
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; in local mode without it, one of our own that goes when Python ends."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not hasattr(context, "_tesserae_tables"):
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = Path(tempfile.mkdtemp(prefix="tesserae-tables-"))
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context._tesserae_tables = folder.as_uri()
    return context._tesserae_tables


def new_path(spark: SparkSession, name: str) -> str:
    """A path that nothing uses yet."""
    return f"{shared_folder(spark)}/catalogue/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a written table: read again, not computed again, and there after executors are lost."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a table, from whatever file system it is on."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds; none where there is no such folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in files.listStatus(at)) if files.exists(at) else []


class Segments:
    """Committed parts of a folder's tables: a part counts once its commit is written, last, so a crash leaves none half there."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def numbers(self) -> list[int]:
        """Committed parts, oldest first. After one that holds the whole only that and later ones count."""
        names = [n.split("=")[1].split("-") for n in names_in(self.spark, f"{self.path}/commits")]
        whole = max((int(n) for n, kind in names if kind == "whole"), default=0)
        return sorted(int(n) for n, _ in names if int(n) >= whole)

    def next(self, table: str) -> int:
        """A number that no part of the table has, committed or not."""
        return max((int(n.split("=")[1]) for n in names_in(self.spark, f"{self.path}/{table}")), default=-1) + 1

    def at(self, table: str, number: int) -> str:
        return f"{self.path}/{table}/segment={number}"

    def commit(self, number: int, schema: StructType, whole: bool) -> None:
        self.spark.range(1).select(F.lit(schema.json()).alias("schema")).write.parquet(f"{self.path}/commits/segment={number}-{'whole' if whole else 'part'}")

    def schema(self) -> StructType:
        """The columns that the parts were committed with."""
        return StructType.fromJson(json.loads(self.spark.read.schema("schema string").parquet(f"{self.path}/commits").first()[0]))

    def read(self, table: str, schema: str | StructType) -> DataFrame:
        """A table's committed parts, each with its number as _segment."""
        parts = [self.spark.read.schema(schema).parquet(self.at(table, n)).withColumn("_segment", F.lit(n)) for n in self.numbers()]
        return reduce(DataFrame.unionByName, parts)

    def forget(self, numbers: list[int], *tables: str) -> None:
        """Delete parts that a later whole one has replaced: their commits first."""
        for n in numbers:
            for name in (f"commits/segment={n}-part", f"commits/segment={n}-whole", *(f"{t}/segment={n}" for t in tables)):
                delete_path(self.spark, f"{self.path}/{name}")
