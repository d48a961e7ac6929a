"""Schemas of the catalogue's tables and of a decoded metainfo document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, LongType, ShortType, StringType, StructField, StructType, TimestampNTZType

TYPES = {"long": LongType(), "int": IntegerType(), "short": ShortType(), "string": StringType(), "boolean": BooleanType(), "binary": BinaryType(), "timestamp_ntz": TimestampNTZType()}


def _schema(columns: str) -> StructType:
    """A schema of "name type, …"; it needs no session."""
    return StructType([StructField(name, TYPES[kind]) for name, kind in (c.split() for c in columns.split(", "))])


TABLES: dict[str, StructType] = {
    "users": _schema("user_id long, date_registered timestamp_ntz, administrator boolean, date_imported timestamp_ntz"),
    "user_authentication": _schema("user_id long, password_hash string"),
    "user_profiles": _schema("user_id long, username string, email string, email_verified boolean, bio string, avatar string"),
    "tracker_keys": _schema("tracker_key_id long, user_id long, tracker_key string, date_expiry long"),
    "user_public_keys": _schema("public_key_id long, user_id long, public_key string, date_registered timestamp_ntz, date_expiry timestamp_ntz, revoked int"),
    "user_invitations": _schema("invitation_id long, user_id long, public_key string, signed_digest string, date_begin timestamp_ntz, date_expiry timestamp_ntz, max_uses int, personal_message string"),
    "user_invitation_uses": _schema("invitation_use_id long, invitation_id long, registered_user_id long, date_used timestamp_ntz"),
    "user_bans": _schema("ban_id long, user_id long, reason string, date_expiry timestamp_ntz"),
    "categories": _schema("category_id long, name string"),
    "torrents": _schema(
        "torrent_id long, uploader_id long, category_id long, info_hash string, size long, name string, pieces string, root_hash string, piece_length long, "
        "private short, is_bep_30 int, date_uploaded timestamp_ntz, source string, comment string, creation_date long, created_by string, encoding string, multi_file boolean"
    ),
    "torrent_info": _schema("torrent_id long, title string, description string"),
    "torrent_files": _schema("file_id long, torrent_id long, md5sum string, length long, path string"),
    "announce_urls": _schema("announce_url_id long, torrent_id long, tracker_url string"),
    "http_seeds": _schema("http_seed_id long, torrent_id long, seed_url string"),
    "nodes": _schema("node_id long, torrent_id long, node_ip string, node_port long"),
    "tags": _schema("tag_id long, name string, date_created timestamp_ntz"),
    "tag_links": _schema("torrent_id long, tag_id long"),
    "tracker_stats": _schema("torrent_id long, tracker_url string, seeders long, leechers long, updated_at timestamp_ntz"),
    "info_hashes": _schema("info_hash string, canonical_info_hash string, original_is_known boolean"),
}
#: Child tables by parent: (child, key of the child, what a deleted parent does to it).
CHILDREN: dict[str, list[tuple[str, str, str]]] = {
    "users": [(t, "user_id", "delete") for t in ("user_authentication", "user_profiles", "tracker_keys", "user_bans")] + [("torrents", "uploader_id", "delete")],
    "categories": [("torrents", "category_id", "null")],
    "tags": [("tag_links", "tag_id", "delete")],
    "torrents": [(t, "torrent_id", "delete") for t in ("torrent_info", "torrent_files", "announce_urls", "http_seeds", "nodes", "tag_links", "tracker_stats")],
}
PRIMARY_KEYS = {"users": "user_id", "categories": "category_id", "tags": "tag_id", "torrents": "torrent_id"}

_TEXTS = ArrayType(StringType())
_FILE = _schema("length long, md5sum string")
FILE = StructType([StructField("path", _TEXTS), *_FILE.fields])
INFO = StructType([
    *_schema("name string, pieces binary, piece_length long, md5sum string, length long").fields, StructField("files", ArrayType(FILE)),
    *_schema("private short").fields, StructField("path", _TEXTS), *_schema("root_hash string, source string").fields,
])
METAINFO = StructType([
    *_schema("announce string").fields, StructField("nodes", ArrayType(_schema("ip string, port long"))), *_schema("encoding string").fields, StructField("httpseeds", _TEXTS),
    StructField("announce_list", ArrayType(_TEXTS)), *_schema("creation_date long, comment string, created_by string").fields, StructField("info", INFO),
])
DECODED = _schema("error string, info_hash string, original_info_hash string").add("torrent", METAINFO)


def empty(spark: SparkSession, table: str) -> DataFrame:
    """A table without rows: what a new catalogue starts from."""
    return spark.createDataFrame([], TABLES[table])
