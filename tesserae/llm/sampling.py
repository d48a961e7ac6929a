"""Folds and bounded samples of labelled rows, the same on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_STEPS = 1 << 30
#: Bytes of a text that a model is fitted on: longer ones give pieces from all over them. Whole texts are scored.
MOST_BYTES = 1 << 16
PIECES = 16
#: Bytes of texts that a sample has about, over all labels.
SAMPLE_BYTES = 1 << 27
#: Labels that a sample has at most: the ones with most rows.
MOST_LABELS = 512


def row_id() -> Column:
    """doc_id as a long; rows without one, or with one that is no number, have -1."""
    return F.coalesce(F.col("doc_id").try_cast("long"), F.lit(-1).cast("long")).alias("doc_id")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; a null id counts as -1."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("-1")).cast("binary")), F.lit(folds))


def excerpt(text: Column) -> Column:
    """A text to fit on: the whole one up to MOST_BYTES bytes, else PIECES pieces of it at even distances, its beginning and end among them."""
    size = MOST_BYTES // (4 * PIECES) - 1  # code points, of four bytes at most, and a space
    step = (F.char_length(text) - size) / (PIECES - 1)
    pieces = F.transform(F.sequence(F.lit(0), F.lit(PIECES - 1)), lambda k: F.substring(text, (k * step).cast("int") + 1, F.lit(size)))
    return F.when(F.octet_length(text) > MOST_BYTES, F.concat_ws(" ", pieces)).otherwise(text)


def bounded(df: DataFrame, label: str, columns: list[str], per_label: int, text: str | None = None) -> DataFrame:
    """About per_label distinct rows of each label, and never over twice as many in all as that allows.

    Rows are taken by a hash of `columns` against each label's share, so no label
    meets in one task; rows alike in them count as one, however many there are.
    The texts of column `text` are about SAMPLE_BYTES in all at most: a share
    falls where the label's texts are long. The shares are a table of at most
    MOST_LABELS rows.
    """
    key = F.xxhash64(*columns, F.lit("sample"))
    size = F.octet_length(text) if text else F.lit(0)
    counts = df.groupBy(label).agg(F.count("*").alias("n"), F.approx_count_distinct(key, 0.02).alias("kinds"), F.avg(size).alias("size")).orderBy(F.desc("n"), label).limit(MOST_LABELS).collect()
    most = SAMPLE_BYTES / max(1, len(counts))
    shares = {r[0]: min(_STEPS, int(min(per_label, most / max(1.0, r["size"] or 0)) * _STEPS) // max(1, r["kinds"])) for r in counts}
    spark = df.sparkSession
    named = df.schema[label].dataType
    held = F.broadcast(spark.createDataFrame(list(shares.items()), StructType().add("_of", named).add("_share", "long")))
    taken = df.join(held, df[label] == held["_of"]).where(F.pmod(key, F.lit(_STEPS)) < F.col("_share"))
    return taken.select(*(df[c] for c in df.columns)).dropDuplicates([label, *columns]).limit(2 * per_label * max(1, len(shares)))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, training: Column, per_label: int) -> tuple[DataFrame, dict[int, int]]:
    """text and label (0 or 1) of about per_label labelled rows each, one a doc_id, in a fixed order; and how many rows have each label.

    Labels other than 0 and 1 are no labels. A doc_id that has several takes
    the greatest, and of several texts the least; of long texts it has an excerpt.
    """
    known = labels.where(training & F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("label"))
    counts = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    picked = bounded(known, "label", ["doc_id"], per_label).groupBy("doc_id").agg(F.max("label").alias("label"))  # at most 4 * per_label rows
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = texts.join(F.broadcast(picked), "doc_id").select("doc_id", "label", excerpt(F.col("text")).alias("text")).groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
    return found.orderBy("doc_id").select("text", "label"), counts
