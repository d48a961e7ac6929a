"""Point lookups, counts and the assembly of details."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import path_parts


def by_key(df: DataFrame, column: str, value: object) -> DataFrame:
    """Rows with that key; the filter reaches the scan."""
    return df.where(F.col(column) == F.lit(value))


def by_keys(df: DataFrame, **values: object) -> DataFrame:
    for column, value in values.items():
        df = by_key(df, column, value)
    return df


def by_info_hash(torrents: DataFrame, info_hash: str) -> DataFrame:
    return by_key(torrents, "info_hash", info_hash.lower())


def blank_nulls(df: DataFrame, *columns: str) -> DataFrame:
    """Null texts as empty ones."""
    return df.withColumns({c: F.coalesce(c, F.lit("")) for c in columns})


def latest_valid_key(keys: DataFrame, now: int, margin: int = 3600) -> DataFrame:
    """Each user's key that lasts longest, among those valid for `margin` seconds more; ties go to the larger id."""
    able = keys.where(F.col("date_expiry") > now + margin)
    best = F.max_by(F.struct(*able.columns), F.struct("date_expiry", "tracker_key_id"))
    return able.groupBy("user_id").agg(best.alias("best")).select("best.*")


def latest(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key. A partial maximum, so a hot key is reduced before the shuffle."""
    best = F.max_by(F.struct(*df.columns), F.struct(*order))
    return df.groupBy(key).agg(best.alias("best")).select("best.*")


def category_counts(categories: DataFrame, entities: DataFrame, key: str, name: str) -> DataFrame:
    """Each category with its number of entities, 0 included."""
    counts = entities.groupBy(key).agg(F.count("*").alias("n"))
    return categories.join(counts, key, "left").select(F.col(name).alias("name"), F.coalesce("n", F.lit(0)).alias("num_entities"))


def tags_of(entities: DataFrame, links: DataFrame, tags: DataFrame) -> DataFrame:
    """entity_id and each of its tags, through the links."""
    return entities.select("entity_id").join(links, "entity_id").join(tags, "tag_id").select("entity_id", "tag_id", "name")


def canonical(hashes: DataFrame, groups: DataFrame) -> DataFrame:
    """Each info_hash with its canonical one: itself where the group table has no row for it."""
    known = groups.select(F.col("info_hash"), "canonical_info_hash")
    return hashes.join(known, "info_hash", "left").withColumn("canonical_info_hash", F.coalesce("canonical_info_hash", "info_hash"))


def children(df: DataFrame, parent: str, value: Column, order: str, name: str) -> DataFrame:
    """One row a parent with its children's values in an array, in order."""
    pairs = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v"))))
    return df.groupBy(parent).agg(F.transform(pairs, lambda p: p["v"]).alias(name))


def announce_tiers(urls: DataFrame) -> DataFrame:
    """Each torrent's announce URLs, every one as a tier of its own."""
    return children(urls, "torrent_id", F.array("tracker_url"), "announce_url_id", "announce_list")


def http_seeds(seeds: DataFrame) -> DataFrame:
    """Each torrent's HTTP seeds."""
    return children(seeds, "torrent_id", F.col("seed_url"), "http_seed_id", "http_seeds")


def dht_nodes(nodes: DataFrame) -> DataFrame:
    """Each torrent's nodes as ip and port."""
    return children(nodes, "torrent_id", F.struct(F.col("node_ip").alias("ip"), F.col("node_port").alias("port")), "node_id", "nodes")


def details(torrents: DataFrame, info: DataFrame, files: DataFrame, urls: DataFrame, seeds: DataFrame, nodes: DataFrame, links: DataFrame, tags: DataFrame) -> DataFrame:
    """Torrents with title, description, files, trackers, http_seeds, nodes and tags as arrays; arrays of absent children are empty.

    Children are grouped before they are joined, so no join multiplies rows. A
    lone file of a torrent shows the torrent's name as its path.
    """
    parts = [
        children(files, "torrent_id", F.struct(path_parts(F.col("path")).alias("path"), "length", "md5sum"), "file_id", "files"),
        children(urls, "torrent_id", F.col("tracker_url"), "announce_url_id", "trackers"),
        http_seeds(seeds),
        dht_nodes(nodes),
        children(links.join(tags, "tag_id"), "torrent_id", F.col("name"), "tag_id", "tags"),
    ]
    out = torrents.join(info, "torrent_id")
    for part in parts:
        name = part.columns[1]
        out = out.join(part, "torrent_id", "left").withColumn(name, F.coalesce(name, F.expr("array()").cast(part.schema[name].dataType)))
    named = F.transform("files", lambda f: f.withField("path", F.array("name")))
    return out.withColumn("files", F.when(F.size("files") == 1, named).otherwise(F.col("files")))


def with_stats(details: DataFrame, stats: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """details with seeders and leechers: live ones (torrent_id, seeders, leechers) where given, else the stored sums, else 0."""
    zero = F.lit(0).cast("long")
    out = details.join(stats.groupBy("torrent_id").agg(F.sum("seeders").alias("_s"), F.sum("leechers").alias("_l")), "torrent_id", "left")
    now = [F.coalesce("_s", zero), F.coalesce("_l", zero)]
    if live is not None:
        out = out.join(live.select("torrent_id", F.col("seeders").alias("_ls"), F.col("leechers").alias("_ll")), "torrent_id", "left")
        now = [F.coalesce("_ls", now[0]), F.coalesce("_ll", now[1])]
    return out.withColumns({"seeders": now[0], "leechers": now[1]}).drop("_s", "_l", "_ls", "_ll")


def in_group(groups: DataFrame, canonical_hash: str | Column, info_hash: str | Column) -> DataFrame:
    """One row, `member`: whether info_hash belongs to a canonical hash's group. Hashes are texts or columns of one value."""
    wanted = {"canonical_info_hash": canonical_hash, "info_hash": info_hash}
    mine = [F.col(c) == F.lower(F.lit(h) if isinstance(h, str) else h) for c, h in wanted.items()]
    return groups.agg(F.coalesce(F.max(mine[0] & mine[1]), F.lit(False)).alias("member"))


def hydrate(torrents: DataFrame, files: DataFrame) -> DataFrame:
    """torrent_id and the info struct as it was published: one file or many by `multi_file`, which keeps the layout of a list of one."""
    listed = children(files, "torrent_id", F.struct(path_parts(F.col("path")).alias("path"), "length", "md5sum"), "file_id", "files")
    both = torrents.join(listed, "torrent_id", "left")
    lone = F.element_at("files", 1)
    single = ~F.col("multi_file")
    path = F.when(lone["path"][0] == "", F.lit(None)).otherwise(lone["path"])
    info = F.struct(
        F.col("name"), F.unhex("pieces").alias("pieces"), F.col("piece_length"), F.when(single, lone["md5sum"]).alias("md5sum"), F.when(single, lone["length"]).alias("length"),
        F.when(~single, F.col("files")).alias("files"), F.col("private"), F.when(single, path).alias("path"), F.col("root_hash"), F.col("source"),
    )
    return both.select("torrent_id", info.alias("info"))


def rank_within(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """Rows with their rank among the rows of a key."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
