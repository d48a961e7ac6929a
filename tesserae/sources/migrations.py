"""Schema steps that a folder of tables has been through, and those it still needs.

A step is a name and, for each table that it makes or changes, a query over the
tables as the steps before left them. The ledger has an entry a step: its place,
its name, a checksum of its queries and where the tables that it wrote are. A step
writes its tables beside the old ones and its entry last, so a crash leaves either
the state before or the one after; what a broken run left is deleted when the step
runs again. Nothing is run where the ledger and the steps disagree: a step that was
changed, left out, renamed or put in between is refused, since no later step can be
trusted to fit then.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from .storage import delete_path, names_in

ENTRY = "number int, name string, checksum string, tables string, at timestamp"
Reader = Callable[[str], DataFrame]


class LedgerError(RuntimeError):
    """The ledger and the steps disagree."""


@dataclass(frozen=True)
class Step:
    """A name and the queries of the tables that the step makes; {table} in a query is that table as it was before. None: the table goes."""

    name: str
    queries: dict[str, str | None]

    def checksum(self) -> str:
        """Of the queries, apart from white space around their words."""
        return hashlib.sha256(json.dumps([(t, q and " ".join(q.split())) for t, q in sorted(self.queries.items())]).encode()).hexdigest()


class Ledger:
    """The steps of the tables in a folder."""

    def __init__(self, spark: SparkSession, url: str) -> None:
        self.spark, self.url = spark, url.rstrip("/")

    def entries(self) -> list[dict]:
        """Entries of the steps done, in order: a row a step."""
        done = [n for n in names_in(self.spark, f"{self.url}/_ledger") if "_SUCCESS" in names_in(self.spark, f"{self.url}/_ledger/{n}")]
        found = [self.spark.read.schema(ENTRY).parquet(f"{self.url}/_ledger/{n}").first().asDict() for n in done]
        return sorted(found, key=lambda e: e["number"])

    def pending(self, steps: Sequence[Step]) -> list[Step]:
        """Steps that are still to be done. Refuses steps that the ledger contradicts."""
        names = [s.name for s in steps]
        if len(set(names)) < len(names):
            raise LedgerError("two steps have one name")
        entries = self.entries()
        for i, e in enumerate(entries):
            if e["number"] != i:
                raise LedgerError(f"the ledger has no entry {i}")
            if i >= len(steps) or steps[i].name != e["name"]:
                raise LedgerError(f"step {i} was {e['name']!r}, and now is {names[i] if i < len(steps) else 'missing'!r}")
            if steps[i].checksum() != e["checksum"]:
                raise LedgerError(f"step {e['name']!r} has changed since it was done")
        return list(steps[len(entries) :])

    def paths(self) -> dict[str, str | None]:
        """Where the latest version of each table that a step made is; None for one that is gone."""
        out: dict[str, str | None] = {}
        for e in self.entries():
            out |= json.loads(e["tables"])
        return out

    def reader(self) -> Reader:
        """Tables by name, as the steps so far left them: else the folder's own, else an empty one of the known schema."""
        paths = self.paths()

        def read(name: str) -> DataFrame:
            if name in paths:
                if paths[name] is None:
                    raise LookupError(f"table {name} is gone")
                return self.spark.read.parquet(f"{self.url}/{paths[name]}")
            if names_in(self.spark, f"{self.url}/{name}.parquet") or name not in schemas.TABLES:
                return self.spark.read.parquet(f"{self.url}/{name}.parquet")
            return schemas.empty(self.spark, name)

        return read

    def migrate(self, steps: Sequence[Step]) -> list[str]:
        """Do the pending steps in order, and return their names."""
        todo = self.pending(steps)
        for number, step in enumerate(steps[len(steps) - len(todo) :], len(steps) - len(todo)):
            self._run(number, step)
        return [s.name for s in todo]

    def _run(self, number: int, step: Step) -> None:
        for left in (f"_versions/{number:04}", f"_ledger/{number:04}"):
            delete_path(self.spark, f"{self.url}/{left}")
        read, made = self.reader(), {}
        for table, text in step.queries.items():
            made[table] = None if text is None else f"_versions/{number:04}/{table}"
            if text is not None:
                used = {name: read(name) for name in _named(text)}
                self.spark.sql(text, **used).write.parquet(f"{self.url}/{made[table]}")
        entry = self.spark.range(1).select(
            F.lit(number).alias("number"), F.lit(step.name).alias("name"), F.lit(step.checksum()).alias("checksum"), F.lit(json.dumps(made)).alias("tables"), F.current_timestamp().alias("at"),
        )
        entry.write.parquet(f"{self.url}/_ledger/{number:04}")


def _named(text: str) -> set[str]:
    """Tables that a query names in braces."""
    from string import Formatter

    return {name for _, name, _, _ in Formatter().parse(text) if name}


def connect_migrated(spark: SparkSession, url: str, steps: Sequence[Step]) -> Reader:
    """A reader of the folder's tables, once all steps are done."""
    ledger = Ledger(spark, url)
    ledger.migrate(steps)
    return ledger.reader()
