"""Corpus pipeline: from documents to packed sequences.

Language identification drops texts without a language, exact dedup keeps one
row of equal texts, the n-gram Jaccard join keeps the smallest doc_id of each
group of near copies, benchmark decontamination drops documents that hold a
window of a test item, and best-fit packing fills sequences with the rest.
Each stage is written as Parquet before the next reads it: a stage drops the
tables that the one before it wrote on the way.

doc_id may be null or come more than once. The stages tell rows apart by a key
of their own, so what happens to one row never depends on others with its
doc_id. Of equal texts the longest stays, then the smallest doc_id; a null one
counts as -1. Of rows alike in that, as repeated rows are, any single one stays.
A null text has no language; null lang is no label; other columns, whatever
their names, are carried. An empty table leaves each stage empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.decontaminate import decontaminate
from tesserae.llm.exact_dedup import exact_dedup
from tesserae.llm.jaccard import jaccard_components
from tesserae.llm.langid import language_of
from tesserae.llm.packing import best_fit_packing
from tesserae.llm.queries import table, tokenizer_file
from tesserae.llm.sampling import row_id
from tesserae.llm.storage import drop_tables, write_table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a key of each row, written, so that every later read finds the same keys; and the key's name, which docs doesn't have."""
    key = "_row_key"
    while key.lower() in {c.lower() for c in docs.columns}:
        key += "_"
    return write_table(docs.withColumn(key, F.monotonically_increasing_id()), "keyed"), key


def _by_key(keyed: DataFrame, key: str) -> DataFrame:
    """The texts under their rows' keys, for operators that tell documents apart by doc_id."""
    return keyed.select(F.col(key).alias("doc_id"), "text")


def _one_each(keyed: DataFrame, key: str, groups: DataFrame, *first: Column) -> DataFrame:
    """One row of each group of keys (doc_id, grp): the least by `first`, then by doc_id."""
    rank = keyed.select(F.col(key).alias("key"), F.struct(*first, row_id(), F.col(key).alias("key")).alias("rank"))
    kept = groups.join(rank, groups["doc_id"] == rank["key"]).groupBy("grp").agg(F.min("rank").alias("rank")).select(F.col("rank.key").alias(key))
    return keyed.join(kept, key, "left_semi").select(*(c for c in keyed.columns if c != key))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; without any lang to learn from, those with letters."""
    if docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).limit(1).count() == 0:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return docs.where(language_of(docs, F.lit(True))["lang_pred"] != "und")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of equal texts."""
    keyed, key = _keyed(docs)
    groups = exact_dedup(_by_key(keyed, key)).select("doc_id", F.col("keep_id").alias("grp"))
    return _one_each(keyed, key, groups, (-F.char_length(F.coalesce("text", F.lit("")))).alias("n"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near copies."""
    keyed, key = _keyed(docs)
    return _one_each(keyed, key, jaccard_components(_by_key(keyed, key)).select("doc_id", F.col("component_id").alias("grp")))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a test item."""
    keyed, key = _keyed(docs)
    hits = decontaminate(_by_key(keyed, key), table(spark, sf_dir, "benchmark")).where("contaminated").select(F.col("doc_id").alias(key))
    return keyed.join(hits, key, "left_anti").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents placed in sequences."""
    return best_fit_packing(docs, tokenizer_file())


#: Tables that the last stage but the final one wrote for itself, of the run that goes on.
_OWN: set[str] = set()


def _stage(function: Stage, first: bool = False, last: bool = False) -> Stage:
    """The stage; it first drops what the stage before it wrote for itself, whose result stands as docs by now.

    A first stage follows no other, and drops nothing. A last stage's result is
    the caller's, who may read it at any time: its tables stay until drop_tables().
    """

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if not first:
            drop_tables(spark, [path for path in written() if path in _OWN])
        _OWN.clear()
        before = set(written())
        try:
            return function(spark, docs, sf_dir)
        finally:
            if not last:
                _OWN.update(path for path in written() if path not in before)

    return run_stage


STAGES: list[tuple[str, Stage]] = [
    ("language_id", _stage(language, first=True)),
    ("exact_dedup", _stage(exact)),
    ("jaccard_dedup", _stage(near)),
    ("decontamination", _stage(benchmark)),
    ("packing", _stage(packing, last=True)),
]

#: Language identification and packing have no SQL form; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
