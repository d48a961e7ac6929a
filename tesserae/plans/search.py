"""Substring search over titles by an inverted index of trigrams.

The index is a set of tables in one folder, written in segments. A segment has
postings (a trigram of a lower-cased title, and an entity that has it), the number
of entities of each trigram, and the entities' rows. Postings lie in folders by a
hash of the trigram and are sorted by trigram, so a search reads the folders and
row groups of its own trigrams only; entities lie in folders by a hash of their
id, so only those that candidates are in are read.

A search is cut at its wildcards into literal runs. A title that matches has all
trigrams of all runs: those with the fewest entities give the candidates, and a
candidate's present row is held against the whole pattern. So postings may be out
of date, and a refresh only adds a segment with the changed rows: what a changed or
deleted entity had before is found, and then dropped by its present row. compact()
writes all segments as one. A segment counts once its commit is written, last, so
a crash leaves none half there.

Without a run of three characters no trigram can help, and all present rows are
held against the pattern. A common trigram's postings are many, but spread over
tasks by id; nothing of them reaches the driver but counts.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import like_pattern
from ..sources.storage import Segments

GRAM = 3
POSTINGS = "gram string, entity_id long, _folder int"
GRAM_FOLDERS, ENTITY_FOLDERS = 64, 64
#: Trigrams that candidates are found by, the rarest of the search; the whole pattern is checked in any case.
MOST_GRAMS = 4
#: With fewer candidates than this, the folders that they are in are found first.
FEW = 100_000


def _folder(c: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(n)).cast("int")


def grams(text: Column) -> Column:
    """Distinct runs of three characters of a text."""
    places = F.sequence(F.lit(1), F.length(text) - (GRAM - 1))
    return F.when(F.length(text) >= GRAM, F.array_distinct(F.transform(places, lambda i: F.substr(text, i, F.lit(GRAM)))))


def wanted_grams(spark: SparkSession, search: str) -> list[str]:
    """Trigrams that every match has: of each run of the pattern between wildcards, lower-cased as the comparison does it."""
    runs = F.split(F.lower(F.lit(like_pattern(search))), "[%_]")
    each = spark.range(1).select(F.explode(runs).alias("run")).select(F.explode(grams(F.replace(F.col("run"), F.lit("\\\\"), F.lit("\\")))).alias("gram"))
    return sorted({r[0] for r in each.collect()})  # no more than the search has characters


class TitleIndex:
    """Entities (entity_id, title and any other columns) that can be searched by title.

    Entities without a title are kept, and no search finds them. entity_id, a
    long, must be unique among the given rows, and not null. Changed rows have the
    columns that the index was built with.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.parts = spark, path, Segments(spark, path)

    @classmethod
    def build(cls, entities: DataFrame, path: str) -> TitleIndex:
        """A new index of these entities."""
        index = cls(entities.sparkSession, path)
        if index.parts.numbers():
            raise ValueError(f"{path} has an index already")
        index._add(entities.withColumn("_deleted", F.lit(False)))
        return index

    def _add(self, rows: DataFrame, whole: bool = False) -> None:
        """Write the segment of these rows, and commit it."""
        number = self.parts.next("entities")
        held, postings, counts = (self.parts.at(t, number) for t in ("entities", "postings", "counts"))
        rows = rows.withColumn("_folder", _folder(F.col("entity_id"), ENTITY_FOLDERS))
        rows.repartitionByRange("_folder", "entity_id").sortWithinPartitions("_folder", "entity_id").write.partitionBy("_folder").parquet(held)
        back = self.spark.read.schema(rows.schema).parquet(held)
        pairs = back.where(~F.col("_deleted")).select(F.explode(grams(F.lower("title"))).alias("gram"), "entity_id").withColumn("_folder", _folder(F.col("gram"), GRAM_FOLDERS))
        order = ["_folder", "gram", "entity_id"]
        pairs.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("_folder").parquet(postings)
        posted = self.spark.read.schema(POSTINGS).parquet(postings)
        posted.groupBy("gram").agg(F.count("*").alias("n")).repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(counts)
        self.parts.commit(number, rows.schema, whole)

    def _rows(self) -> DataFrame:
        """Rows of all segments, replaced and deleted ones too."""
        return self.parts.read("entities", self.parts.schema())

    def refresh(self, changed: DataFrame, deleted: DataFrame | None = None) -> None:
        """Add or replace the changed entities, and take out those of `deleted` (entity_id)."""
        rows = changed.withColumn("_deleted", F.lit(False))
        if deleted is not None:
            rows = rows.unionByName(deleted.select("entity_id").distinct().join(changed.select("entity_id"), "entity_id", "left_anti").withColumn("_deleted", F.lit(True)), allowMissingColumns=True)
        self._add(rows)

    def compact(self) -> None:
        """All present rows as one segment; what came before it is deleted."""
        old = self.parts.numbers()
        self._add(self.entities().withColumn("_deleted", F.lit(False)), whole=True)
        self.parts.forget(old, "entities", "postings", "counts")

    def _present(self, rows: DataFrame) -> DataFrame:
        """The latest row of each entity, without deleted ones."""
        names = [c for c in rows.columns if c not in ("_folder", "_segment")]
        if len(self.parts.numbers()) > 1:
            rows = rows.groupBy("entity_id").agg(F.max_by(F.struct(*names), F.col("_segment")).alias("row")).select("row.*")
        return rows.where(~F.col("_deleted")).select(*(c for c in names if c != "_deleted"))

    def entities(self) -> DataFrame:
        """All present rows."""
        return self._present(self._rows())

    def rarest(self, wanted: Iterable[str]) -> list[tuple[str, int]]:
        """Trigrams to look candidates up by, and how many entities each has at most, rarest first."""
        wanted = list(wanted)
        counts = self.parts.read("counts", "gram string, n long").where(F.col("gram").isin(wanted)).groupBy("gram").agg(F.sum("n"))
        found = dict(map(tuple, counts.collect()))  # a row for each of the search's trigrams
        return sorted(((g, found.get(g, 0)) for g in wanted), key=lambda x: (x[1], x[0]))[:MOST_GRAMS]

    def candidates(self, chosen: list[str]) -> DataFrame:
        """entity_id of entities that have, or had, all of these trigrams."""
        folders = sorted({r[0] for r in self.spark.createDataFrame([(g,) for g in chosen], "gram string").select(_folder(F.col("gram"), GRAM_FOLDERS)).collect()})
        hit = self.parts.read("postings", POSTINGS).where(F.col("_folder").isin(folders) & F.col("gram").isin(chosen))
        mark = F.lit(0)
        for i, g in enumerate(chosen):
            mark = F.when(F.col("gram") == g, 1 << i).otherwise(mark)
        return hit.groupBy("entity_id").agg(F.bit_or(mark).alias("has")).where(F.col("has") == (1 << len(chosen)) - 1).select("entity_id")

    def matching(self, search: str) -> DataFrame:
        """Present entities whose title has the searched text; % and _ in it are wildcards, letters match in either case."""
        rows = self._rows()
        wanted = wanted_grams(self.spark, search)
        if wanted:
            chosen = self.rarest(wanted)
            found = self.candidates([g for g, _ in chosen])
            if chosen[0][1] <= FEW:
                folders = found.select(_folder(F.col("entity_id"), ENTITY_FOLDERS).alias("f")).distinct()
                rows = rows.where(F.col("_folder").isin([r[0] for r in folders.collect()]))  # at most ENTITY_FOLDERS numbers
                found = F.broadcast(found)  # at most FEW ids
            rows = rows.join(found, "entity_id", "left_semi")
        return self._present(rows).where(F.col("title").ilike(like_pattern(search)))
