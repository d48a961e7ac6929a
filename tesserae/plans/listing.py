"""The catalogue listing: request, specification, and the plans for its page and its total."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import like_pattern
from ..sources.storage import stored
from .search import TitleIndex
from .seek import ordering, seek

DEFAULT_PAGE_SIZE, MAX_PAGE_SIZE = 10, 30
#: Pages from this row on are sought by a range histogram; a sort of the rows ahead is cheaper before.
SEEK_FROM = 10_000


class Sorting(Enum):
    """Sort keys of the listing: column and whether it descends."""

    UPLOADED_ASC = ("uploaded", False)
    UPLOADED_DESC = ("uploaded", True)
    SEEDERS_ASC = ("seeders", False)
    SEEDERS_DESC = ("seeders", True)
    LEECHERS_ASC = ("leechers", False)
    LEECHERS_DESC = ("leechers", True)
    NAME_ASC = ("title", False)
    NAME_DESC = ("title", True)
    SIZE_ASC = ("size", False)
    SIZE_DESC = ("size", True)


@dataclass(frozen=True)
class ListingRequest:
    """What a caller asks for; anything may be left out."""

    search: str | None = None
    categories: str | None = None
    tags: str | None = None
    sort: Sorting | None = None
    page: int | None = None
    page_size: int | None = None


@dataclass(frozen=True)
class ListingSpec:
    """A request with defaults filled in, page_size within bounds and lists split."""

    search: str | None
    categories: tuple[str, ...]
    tags: tuple[str, ...]
    sort: Sorting
    offset: int
    page_size: int


@dataclass(frozen=True)
class Catalogue:
    """Frames the listing reads.

    entities: entity_id, title, uploader, category (null: none), size, uploaded.
    stats: entity_id, seeders, leechers, in any number of rows. tags: entity_id,
    tag, each pair once. known_categories(name), known_tags(name). index: where
    given, an index of the same entities, which searches read instead. summed:
    stats has at most one row an entity, as kept sums do, and isn't added up.
    """

    entities: DataFrame
    stats: DataFrame
    tags: DataFrame
    known_categories: DataFrame
    known_tags: DataFrame
    index: TitleIndex | None = None
    summed: bool = False


def items(value: str | None) -> tuple[str, ...]:
    """Items of a comma-separated parameter, trimmed; none for a blank one."""
    return tuple(x.strip() for x in value.split(",")) if value and value.strip() else ()


def specify(request: ListingRequest, default_size: int = DEFAULT_PAGE_SIZE, max_size: int = MAX_PAGE_SIZE) -> ListingSpec:
    page, size = request.page or 0, default_size if request.page_size is None else request.page_size
    if page < 0 or size < 0:
        raise ValueError("page and page_size can't be negative")
    size = min(size, max_size)
    return ListingSpec(request.search or None, items(request.categories), items(request.tags), request.sort or Sorting.UPLOADED_DESC, page * size, size)


def known(names: tuple[str, ...], table: DataFrame) -> list[str]:
    """Those of the names that the table has. At most as many rows as the request has names reach the driver."""
    if not names:
        return []
    return sorted(r[0] for r in table.where(F.col("name").isin(list(names))).select("name").distinct().collect())


def matching(catalogue: Catalogue, spec: ListingSpec, fan_out: bool = False) -> DataFrame:
    """Entities that pass the search and the filters, each once.

    Several categories or tags mean any of them. Names nobody knows are dropped;
    if none is left, there is no filter. fan_out: once for each matching tag, as
    an inner join with the links gives, instead.
    """
    out = catalogue.entities
    pattern = like_pattern(spec.search)
    if pattern and catalogue.index:
        out = catalogue.index.matching(spec.search)
    elif pattern:
        out = out.where(F.col("title").ilike(pattern))
    categories, tags = known(spec.categories, catalogue.known_categories), known(spec.tags, catalogue.known_tags)
    if categories:
        out = out.where(F.col("category").isin(categories))
    if tags:
        links = catalogue.tags.where(F.col("tag").isin(tags)).select("entity_id")
        out = out.join(links, "entity_id", "inner" if fan_out else "left_semi")
    return out


def total(catalogue: Catalogue, spec: ListingSpec) -> DataFrame:
    """The number of hits as one row, `total`. Statistics can't change it, so they aren't read."""
    return matching(catalogue, spec).agg(F.count("*").alias("total"))


def _with_stats(entities: DataFrame, stats: DataFrame, summed: bool, times: Column | None = None) -> DataFrame:
    """Entities with their summed statistics, 0 where there are none. Sums come before the join, so it adds no rows."""
    sums = stats.select("entity_id", "seeders", "leechers") if summed else stats.groupBy("entity_id").agg(F.sum("seeders").alias("seeders"), F.sum("leechers").alias("leechers"))
    out = entities.join(sums, "entity_id", "left")
    for name in ("seeders", "leechers"):
        value = F.coalesce(name, F.lit(0))
        out = out.withColumn(name, (value if times is None else value * times).cast("long"))
    return out if times is None else out.drop("matches")


def listing(catalogue: Catalogue, spec: ListingSpec, fan_out: bool = False) -> DataFrame:
    """The page of hits, in order; ties go by entity_id.

    A sort by an entity's own columns takes the page's rows first, and only they
    are joined with statistics: at most page_size ids are broadcast to that scan.
    Of a deep page the ids come first: keys and ids of all hits are written once,
    and the page is sought in them.
    """
    column, descending = spec.sort.value
    order = ordering(column, descending)
    hits = matching(catalogue, spec, fan_out)
    if fan_out:
        hits = hits.groupBy(hits.columns).agg(F.count("*").alias("matches"))
    times = F.col("matches") if fan_out else None
    by_stats = column in ("seeders", "leechers")
    if spec.offset >= SEEK_FROM:
        keys = _with_stats(hits, catalogue.stats, catalogue.summed, times) if by_stats else hits
        found = seek(stored(keys.select(column, "entity_id"), "keys"), column, descending, spec.offset, spec.page_size)
        page = hits.join(F.broadcast(found.select("entity_id")), "entity_id", "left_semi")  # at most page_size rows
    elif by_stats:
        return _with_stats(hits, catalogue.stats, catalogue.summed, times).orderBy(order).offset(spec.offset).limit(spec.page_size)
    else:
        page = hits.orderBy(order).offset(spec.offset).limit(spec.page_size)
    stats = catalogue.stats.join(F.broadcast(page.select("entity_id")), "entity_id", "left_semi")  # at most page_size rows
    return _with_stats(page, stats, catalogue.summed, times).orderBy(order)
