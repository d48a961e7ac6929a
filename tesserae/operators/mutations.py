"""Mutations as functions from tables and changes to new tables.

Tables are immutable Parquet here: a caller writes what comes out as a new
version and then swaps. Uniqueness and references, which no file enforces, are
checked by joins, and a refused change raises before anything is written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import blank_to_null
from ..schemas import CHILDREN, PRIMARY_KEYS
from ..sources.tables import NotFound

Tables = dict[str, DataFrame]
#: Rows that one task ranks when ids are given, on average.
GROUP_ROWS = 250_000
#: Children that a parent may have for their ids, and the bits of a child's place in them.
CHILD_BITS = 20
#: When bans end, and their reason.
BAN_UNTIL, BAN_REASON = "9999-01-01 00:00:00", "no reason"


class Duplicate(ValueError):
    """A unique column would hold a value twice; its name is the message."""


def check_unique(table: DataFrame, new: DataFrame, *columns: str) -> None:
    """Raise Duplicate for the first column of which new repeats a value, its own or the table's; nulls don't count."""
    for c in columns:
        values = new.where(F.col(c).isNotNull()).select(c)
        twice = values.groupBy(c).count().where("count > 1").select(c)
        if values.join(table.select(c), c, "left_semi").unionByName(twice).limit(1).count():
            raise Duplicate(c)


def numbered(new: DataFrame, table: DataFrame, key: str, *order: str) -> DataFrame:
    """new with ids after the table's largest.

    Ranks are global, in two levels: counts of hash groups, then ranks within
    them, so no task ranks all rows; the number of groups follows from the rows.
    """
    top = table.agg(F.coalesce(F.max(key), F.lit(0)).alias("top"))
    groups = max(64, new.count() // GROUP_ROWS)
    salted = new.withColumn("_group", F.pmod(F.xxhash64(*order), F.lit(groups)))
    sizes = salted.groupBy("_group").count()
    before = sizes.select("_group", (F.sum("count").over(Window.orderBy("_group")) - F.col("count")).alias("_before"))  # a row a group
    rank = F.row_number().over(Window.partitionBy("_group").orderBy(*order))
    out = salted.withColumn("_rank", rank).join(F.broadcast(before), "_group").crossJoin(F.broadcast(top))  # one row
    return out.withColumn(key, F.col("top") + F.col("_before") + F.col("_rank")).drop("_group", "_before", "_rank", "top")


def child_id(parent: Column, place: Column) -> Column:
    """An id from a parent's and a child's place (from 0) among its own; a query fails where they don't fit."""
    fits = (place < 1 << CHILD_BITS) & (parent < 1 << (63 - CHILD_BITS))
    return F.when(fits, F.shiftleft(parent.cast("long"), CHILD_BITS) + place).otherwise(F.raise_error(F.lit("too many children for their ids")).cast("long"))


def insert(table: DataFrame, new: DataFrame, key: str, unique: tuple[str, ...], *order: str) -> DataFrame:
    """table with new rows under new ids."""
    check_unique(table, new, *unique)
    return table.unionByName(numbered(new, table, key, *order).select(table.columns))


def insert_users(tables: Tables, new: DataFrame, now: Column) -> Tables:
    """users, user_authentication and user_profiles with new(username, email, password_hash). A blank e-mail is none; the first user ever is administrator."""
    new = new.withColumn("email", blank_to_null(F.col("email")))
    check_unique(tables["user_profiles"], new, "username", "email")
    rows = numbered(new, tables["users"], "user_id", "username")
    none = F.lit(None).cast("string")
    user = rows.select("user_id", now.cast("timestamp_ntz").alias("date_registered"), (F.col("user_id") == 1).alias("administrator"), F.lit(None).cast("timestamp_ntz").alias("date_imported"))
    profile = rows.select("user_id", "username", "email", F.lit(False).alias("email_verified"), none.alias("bio"), none.alias("avatar"))
    return tables | {
        "users": tables["users"].unionByName(user),
        "user_authentication": tables["user_authentication"].unionByName(rows.select("user_id", "password_hash")),
        "user_profiles": tables["user_profiles"].unionByName(profile),
    }


def ban_users(bans: DataFrame, users: DataFrame) -> DataFrame:
    """bans with one more for each of users(user_id), that never ends."""
    new = users.select("user_id", F.lit(BAN_REASON).alias("reason"), F.lit(BAN_UNTIL).cast("timestamp_ntz").alias("date_expiry"))
    return insert(bans, new, "ban_id", (), "user_id")


def add_tracker_keys(keys: DataFrame, new: DataFrame) -> DataFrame:
    """keys with new(user_id, tracker_key, date_expiry)."""
    return insert(keys, new, "tracker_key_id", (), "user_id", "tracker_key")


def add_to_groups(groups: DataFrame, new: DataFrame) -> DataFrame:
    """groups with new(info_hash, canonical_info_hash), whose originals are known; an info_hash is in one group."""
    check_unique(groups, new, "info_hash")
    return groups.unionByName(new.select("info_hash", "canonical_info_hash", F.lit(True).alias("original_is_known")))


def update(table: DataFrame, key: str, value: object, changes: dict[str, Column], unique: tuple[str, ...] = (), must_exist: bool = True) -> DataFrame:
    """table with columns of one key's row changed."""
    mine = F.col(key) == F.lit(value)
    if must_exist and not table.where(mine).limit(1).count():
        raise NotFound(f"{key} {value}")
    out = table.withColumns({c: F.when(mine, v).otherwise(F.col(c)).cast(table.schema[c].dataType) for c, v in changes.items()})
    for c in unique:
        if out.where(F.col(c).isNotNull()).join(out.where(mine).select(c), c, "left_semi").limit(2).count() > 1:
            raise Duplicate(c)
    return out


def delete(tables: Tables, parent: str, ids: DataFrame, must_exist: bool = True) -> Tables:
    """tables without these parents, given by their key column; children go too, or lose the reference, level by level."""
    key = PRIMARY_KEYS[parent]
    gone = ids.select(key).distinct()
    if must_exist and gone.join(tables[parent], key, "left_anti").limit(1).count():
        raise NotFound(f"{parent} {key}")
    out = tables | {parent: tables[parent].join(gone, key, "left_anti")}
    for child, column, then in CHILDREN.get(parent, []):
        if child not in out:
            continue
        which = gone.select(F.col(key).alias(column))
        if then == "null":
            marked = out[child].join(which.withColumn("_gone", F.lit(True)), column, "left")
            out[child] = marked.withColumn(column, F.when(F.col("_gone").isNull(), F.col(column))).select(tables[child].columns)
        elif child in PRIMARY_KEYS:
            out = delete(out, child, out[child].join(which, column, "left_semi"), must_exist=False)
        else:
            out[child] = out[child].join(which, column, "left_anti").select(tables[child].columns)
    return out


def truncate(tables: Tables) -> Tables:
    """All tables empty."""
    return {name: df.limit(0) for name, df in tables.items()}


def link_tags(links: DataFrame, new: DataFrame) -> DataFrame:
    """links with new pairs, those it has already left out."""
    pair = ["torrent_id", "tag_id"]
    return links.unionByName(new.select(pair).distinct().join(links, pair, "left_anti"))


def unlink_tags(links: DataFrame, torrent_id: int, tag_id: int | None = None) -> DataFrame:
    """links without one tag of a torrent, or without any of its tags."""
    gone = F.col("torrent_id") == torrent_id
    return links.where(~(gone if tag_id is None else gone & (F.col("tag_id") == tag_id)))


def replace_tag_sets(links: DataFrame, wanted: DataFrame) -> DataFrame:
    """links with the tag sets of wanted(torrent_id, tag_ids) where they differ from what is there."""
    now = links.groupBy("torrent_id").agg(F.sort_array(F.collect_set("tag_id")).alias("now"))
    want = wanted.select("torrent_id", F.sort_array(F.array_distinct("tag_ids")).alias("want"))
    changed = want.join(now, "torrent_id", "left").where(F.col("want") != F.coalesce("now", F.expr("array()").cast("array<bigint>"))).select("torrent_id", "want")
    kept = links.join(changed.select("torrent_id"), "torrent_id", "left_anti")
    return kept.unionByName(changed.select("torrent_id", F.explode("want").alias("tag_id")))
