"""A statistics service as a Spark data source, batch and stream.

spark.read.format("catalogue_stats").option("url", …).load() has a row of
STATS_SCHEMA for each hash that the filter on info_hash names, with = or IN. The
filter is pushed into the source: it plans one partition for each `batch` hashes,
and a partition is one request with the hashes as repeated parameters. Hashes that
the service leaves out have no row. Only what is asked for is requested, so a read
without such a filter is refused. Spark needs
spark.sql.python.filterPushdown.enabled for it; register() sets that.

A request that fails for the moment (no answer, 429 or 5xx) is tried again up to
`attempts` times, longer apart each time; then its task fails, and Spark runs that
one partition again, not the others. Any other answer than a JSON array is an
error, never an empty result.

As a stream the source asks for the hashes of its option `hashes` again at every
trigger; each poll is an offset. What a service said earlier can't be asked for
again, so a micro-batch that is repeated after a failure has the present answers.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from .tables import STATS_SCHEMA

FORMAT = "catalogue_stats"
BATCH, ATTEMPTS, TIMEOUT = 50, 3, 5.0
_ARROW = pa.schema([(name, pa.string() if kind == "string" else pa.int64()) for name, kind in (c.split() for c in STATS_SCHEMA.split(", "))])


class _Hashes(InputPartition):
    """The hashes of one request."""

    def __init__(self, hashes: tuple[str, ...], poll: int = 0) -> None:
        super().__init__(hashes)
        self.poll = poll


class _Client:
    """Requests as the options say."""

    def __init__(self, options: dict[str, str]) -> None:
        if not options.get("url"):
            raise ValueError(f"{FORMAT} needs the option url")
        self.url, self.token = options["url"], options.get("token")
        self.batch, self.attempts, self.timeout = int(options.get("batch", BATCH)), int(options.get("attempts", ATTEMPTS)), float(options.get("timeout", TIMEOUT))
        if self.batch < 1 or self.attempts < 1:
            raise ValueError("batch and attempts must be at least 1")

    def partitions(self, hashes: Iterable[str], poll: int = 0) -> list[_Hashes]:
        each = sorted(set(hashes))
        return [_Hashes(tuple(each[i : i + self.batch]), poll) for i in range(0, len(each), self.batch)]

    def fetch(self, hashes: Sequence[str]) -> pa.RecordBatch:
        query = [("info_hash", h) for h in hashes] + ([("token", self.token)] if self.token else [])
        for attempt in range(self.attempts):
            try:
                with urllib.request.urlopen(f"{self.url}?{urllib.parse.urlencode(query)}", timeout=self.timeout) as answer:
                    rows = json.load(answer)
                break
            except urllib.error.HTTPError as e:
                if attempt + 1 == self.attempts or not (e.code == 429 or e.code >= 500):
                    raise
            except (urllib.error.URLError, TimeoutError, ConnectionError):
                if attempt + 1 == self.attempts:
                    raise
            time.sleep(0.1 * 2**attempt)
        if not isinstance(rows, list):
            raise ValueError("the service's answer is no JSON array")
        asked = set(hashes)
        return pa.RecordBatch.from_pylist([{n: r.get(n) for n in _ARROW.names} for r in rows if r.get("info_hash") in asked], _ARROW)


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.client, self.hashes = _Client(options), None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Takes = and IN on info_hash; several of them mean what they have in common. All else is left to Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("info_hash",):
                named = {v for v in (f.value if isinstance(f, In) else [f.value]) if v is not None}
                self.hashes = named if self.hashes is None else self.hashes & named
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        if self.hashes is None:
            raise ValueError(f"{FORMAT} needs a filter on info_hash, by = or IN")
        return self.client.partitions(self.hashes) or [_Hashes(())]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value:
            yield self.client.fetch(partition.value)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.client, self.polls = _Client(options), 0
        self.hashes = [h for h in options.get("hashes", "").split(",") if h]

    def initialOffset(self) -> dict:  # noqa: N802
        return {"poll": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        self.polls += 1
        return {"poll": self.polls}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        self.polls = max(self.polls, end["poll"])  # polls go on where a restarted stream's checkpoint ends
        return self.client.partitions(self.hashes, end["poll"]) or [_Hashes((), end["poll"])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value:
            yield self.client.fetch(partition.value)


class StatsService(DataSource):
    """Options: url, token, batch, attempts, timeout in seconds; hashes, with commas, for streams."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return STATS_SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return _StreamReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(StatsService)
