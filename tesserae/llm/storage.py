"""Written tables in the shared folder, for cutting lineage."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows that a Python worker gets at once while a table is written: whole texts are long.
BATCH_ROWS = 1024
_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; in local mode without it (tests), one of our own, gone when Python ends."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    kept = getattr(spark.sparkContext, "_tesserae_shared", None)
    if kept is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = Path(tempfile.mkdtemp(prefix="tesserae-"))
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        kept = folder.as_uri()
        spark.sparkContext._tesserae_shared = kept
    return kept


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and return the table as read back.

    The table outlives lost executors, and what is computed from it is not
    computed again from the inputs. It has as many files as df has partitions,
    which Spark sizes by bytes when it splits files and joins small shuffle
    partitions. drop_tables() deletes it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tesserae/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    rows = spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, str(min(int(rows), BATCH_ROWS)))
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(ARROW_ROWS, rows)
    return spark.read.schema(df.schema).parquet(path)


def written() -> list[str]:
    """Paths of the tables written so far and not dropped."""
    return list(_WRITTEN)


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    """Delete written tables that nothing will read again, from whatever file system they are on."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(hadoop).delete(path, True)
        if name in _WRITTEN:
            _WRITTEN.remove(name)
