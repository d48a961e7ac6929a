"""Set-based migrations and the move from the first catalogue's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metainfo import flat_trackers
from ..functions.scalar import epoch_text
from .mutations import child_id


def rename_duplicates(df: DataFrame, key: str, name: str) -> DataFrame:
    """Names that more than one row has get `_` and the row's key appended.

    Names are counted before the join: partial counts reduce a hot name on the
    map side, and only names that repeat are joined.
    """
    twice = df.groupBy(name).count().where("count > 1").select(F.col(name).alias("_twice"))
    both = df.join(twice, F.col(name) == F.col("_twice"), "left")
    return both.withColumn(name, F.when(F.col("_twice").isNull(), F.col(name)).otherwise(F.concat_ws("_", name, F.col(key).cast("string")))).drop("_twice")


def hash_groups(torrents: DataFrame) -> DataFrame:
    """Rows of the group table for torrents(info_hash, original): unknown originals, equal ones, and two rows where they differ.

    One scan: each torrent brings an array of its rows.
    """

    def row(info_hash: str, known: bool) -> Column:
        return F.struct(F.col(info_hash).alias("info_hash"), F.col("canonical").alias("canonical_info_hash"), F.lit(known).alias("original_is_known"))

    rows = (
        F.when(F.col("original").isNull(), F.array(row("canonical", False)))
        .when(F.col("original") == F.col("canonical"), F.array(row("canonical", True)))
        .otherwise(F.array(row("canonical", True), row("original", True)))
    )
    return torrents.select(F.col("info_hash").alias("canonical"), "original").select(F.inline(rows))


def split_by_flag(df: DataFrame, value: str, flag: str, when_set: str, otherwise: str) -> DataFrame:
    """A column split in two by a flag; each row has one of them."""
    is_set = F.col(flag) == 1
    return df.withColumns({when_set: F.when(is_set, F.col(value)), otherwise: F.when(~is_set, F.col(value))})


def lower_hashes(df: DataFrame, column: str = "info_hash") -> DataFrame:
    return df.withColumn(column, F.lower(column))


def attach_dimension(facts: DataFrame, dimension: DataFrame, name: str, key: str) -> DataFrame:
    """facts with the key of each name; raises if a name has none."""
    lost = facts.join(dimension.select(name), name, "left_anti").select(name).limit(1).collect()
    if lost:
        raise LookupError(f"no {key} for {name} {lost[0][0]!r}")
    return facts.join(dimension.select(name, key), name)


def upgrade_users(old: DataFrame, now: Column) -> dict[str, DataFrame]:
    """users, user_authentication and user_profiles of the first catalogue's users."""
    none, when = F.lit(None).cast("string"), now.cast("timestamp_ntz")
    return {
        "users": old.select("user_id", F.lit(None).cast("timestamp_ntz").alias("date_registered"), F.col("administrator").cast("boolean").alias("administrator"), when.alias("date_imported")),
        "user_authentication": old.select("user_id", F.col("password").alias("password_hash")),
        "user_profiles": old.select("user_id", "username", "email", F.col("email_verified").cast("boolean").alias("email_verified"), none.alias("bio"), none.alias("avatar")),
    }


def upgrade_keys(old: DataFrame) -> DataFrame:
    return old.select(F.col("key_id").alias("tracker_key_id"), "user_id", F.col("key").alias("tracker_key"), F.col("valid_until").alias("date_expiry"))


def upgrade_torrents(old: DataFrame, users: DataFrame, documents: DataFrame) -> dict[str, DataFrame]:
    """torrents, torrent_info, torrent_files and announce_urls of the first catalogue's torrents.

    documents: torrent_id and the decoded document of each; raises if one has
    none. The uploader's name must be among users(username, user_id). Child ids
    number a torrent's children from its id times 2**20.
    """
    bare = old.join(documents, "torrent_id", "left_anti").select("torrent_id").limit(1).collect()
    if bare:
        raise LookupError(f"no document for torrent {bare[0][0]}")
    rows = attach_dimension(old.withColumnRenamed("uploader", "username"), users, "username", "user_id").join(documents, "torrent_id")
    info = F.col("torrent.info")
    files = F.coalesce(info["files"], F.array(F.struct(F.coalesce(info["path"], F.array(F.lit(""))).alias("path"), info["length"].alias("length"), info["md5sum"].alias("md5sum"))))
    child = child_id(F.col("torrent_id"), F.col("pos"))
    none = F.lit(None).cast("string")
    return {
        "torrents": rows.select(
            "torrent_id", F.col("user_id").alias("uploader_id"), "category_id", F.lower("info_hash").alias("info_hash"), F.col("file_size").alias("size"), info["name"].alias("name"),
            F.hex(info["pieces"]).alias("pieces"), none.alias("root_hash"), info["piece_length"].alias("piece_length"), F.coalesce(info["private"], F.lit(0)).cast("short").alias("private"),
            F.lit(0).alias("is_bep_30"), F.to_timestamp_ntz(epoch_text(F.col("upload_date"))).alias("date_uploaded"), info["source"].alias("source"), F.col("torrent.comment").alias("comment"),
            F.col("torrent.creation_date").alias("creation_date"), F.col("torrent.created_by").alias("created_by"), F.col("torrent.encoding").alias("encoding"), info["files"].isNotNull().alias("multi_file"),
        ),
        "torrent_info": rows.select("torrent_id", "title", "description"),
        "torrent_files": rows.select("torrent_id", F.posexplode(files).alias("pos", "f")).select(child.alias("file_id"), "torrent_id", "f.md5sum", "f.length", F.array_join("f.path", "/").alias("path")),
        "announce_urls": rows.select("torrent_id", F.posexplode(flat_trackers(F.col("torrent"))).alias("pos", "tracker_url")).where("tracker_url is not null").select(child.alias("announce_url_id"), "torrent_id", "tracker_url"),
    }


def upgrade_categories(old: DataFrame, current: DataFrame) -> DataFrame:
    """The first catalogue's categories under their own ids; raises if one's name has another id in the current table."""
    both = old.select("category_id", "name").join(current.select(F.col("category_id").alias("_id"), "name"), "name")
    wrong = both.where("category_id <> _id").limit(1).collect()
    if wrong:
        raise ValueError(f"category {wrong[0]['name']!r} would change its id")
    return old.select("category_id", "name")


def upgrade(old: dict[str, DataFrame], documents: DataFrame, now: Column, current: DataFrame | None = None) -> dict[str, DataFrame]:
    """All tables of a new catalogue from the first one's: categories, users, tracker_keys, torrents; nothing of the new one stays.

    current: the new catalogue's categories, whose names must have the same ids.
    """
    users = upgrade_users(old["users"], now)
    names = old["users"].select("username", "user_id")
    return {
        "categories": upgrade_categories(old["categories"], old["categories"].limit(0) if current is None else current), **users, "tracker_keys": upgrade_keys(old["tracker_keys"]),
        **upgrade_torrents(old["torrents"], names, documents),
    }
