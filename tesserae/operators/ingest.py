"""Taking in metainfo documents: validation, duplicates, and the rows of all tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metainfo import flat_trackers, public_tiers, total_size
from ..functions.scalar import is_title
from .mutations import Tables, child_id, numbered


def classify(uploads: DataFrame, groups: DataFrame) -> DataFrame:
    """uploads(info_hash, original_info_hash) with `kind`: known (this original is there), alias (its canonical hash is), or new."""
    originals = groups.select(F.col("info_hash").alias("original_info_hash")).distinct().withColumn("_original", F.lit(True))
    canonicals = groups.select(F.col("canonical_info_hash").alias("info_hash")).distinct().withColumn("_canonical", F.lit(True))
    kind = F.when(F.col("_original"), "known").when(F.col("_canonical"), "alias").otherwise("new")
    return uploads.join(originals, "original_info_hash", "left").join(canonicals, "info_hash", "left").withColumn("kind", kind).drop("_original", "_canonical")


def announced(torrent: Column, tracker: str) -> Column:
    """The document under the catalogue's tracker: its own announce URL, and no tiers if it is private."""
    return torrent.withField("announce", F.lit(tracker)).withField("announce_list", public_tiers(torrent))


def ingest(tables: Tables, uploads: DataFrame, now: Column) -> tuple[Tables, DataFrame]:
    """Tables with the new uploads' rows, and all uploads with their kind and error.

    uploads: info_hash, original_info_hash, torrent, error, title, description,
    category_id, tag_ids, uploader_id. Of uploads with one canonical hash the one
    with the least original hash goes in. An alias is recorded though its upload
    is refused.
    """
    judged = classify(uploads, tables["info_hashes"]).withColumn("error", F.coalesce("error", F.when(~is_title(F.col("title")), F.lit("title too short"))))
    fit = judged.where(F.col("error").isNull())
    first = fit.where("kind = 'new'").groupBy("info_hash").agg(F.min("original_info_hash").alias("original_info_hash"))
    new = fit.join(first, ["info_hash", "original_info_hash"], "left_semi").dropDuplicates(["info_hash"])
    rows = numbered(new, tables["torrents"], "torrent_id", "info_hash")
    info, doc = F.col("torrent.info"), F.col("torrent")
    files = F.coalesce(info["files"], F.array(F.struct(F.coalesce(info["path"], F.array(F.lit(""))).alias("path"), info["length"].alias("length"), info["md5sum"].alias("md5sum"))))
    child = child_id(F.col("torrent_id"), F.col("pos"))

    def exploded(values: Column, key: str, *columns: Column) -> DataFrame:
        return rows.select("torrent_id", F.posexplode(values).alias("pos", "v")).select(child.alias(key), "torrent_id", *columns)

    made = {
        "torrents": rows.select(
            "torrent_id", "uploader_id", "category_id", "info_hash", total_size(info).alias("size"), info["name"].alias("name"), F.hex(info["pieces"]).alias("pieces"), info["root_hash"].alias("root_hash"),
            info["piece_length"].alias("piece_length"), info["private"].cast("short").alias("private"), info["root_hash"].isNotNull().cast("int").alias("is_bep_30"), now.cast("timestamp_ntz").alias("date_uploaded"),
            info["source"].alias("source"), doc["comment"].alias("comment"), doc["creation_date"].alias("creation_date"), doc["created_by"].alias("created_by"), doc["encoding"].alias("encoding"),
            info["files"].isNotNull().alias("multi_file"),
        ),
        "torrent_info": rows.select("torrent_id", "title", F.nullif("description", F.lit("")).alias("description")),
        "torrent_files": exploded(files, "file_id", F.col("v.md5sum").alias("md5sum"), F.col("v.length").alias("length"), F.array_join("v.path", "/").alias("path")),
        "announce_urls": exploded(flat_trackers(doc), "announce_url_id", F.col("v").alias("tracker_url")).where("tracker_url is not null"),
        "http_seeds": exploded(doc["httpseeds"], "http_seed_id", F.col("v").alias("seed_url")),
        "nodes": exploded(doc["nodes"], "node_id", F.col("v.ip").alias("node_ip"), F.col("v.port").alias("node_port")),
        "tag_links": rows.select("torrent_id", F.explode(F.array_distinct("tag_ids")).alias("tag_id")),
        "info_hashes": fit.where("kind = 'alias'").select(F.col("original_info_hash").alias("info_hash"), F.col("info_hash").alias("canonical_info_hash"), F.lit(True).alias("original_is_known"))
        .unionByName(rows.select(F.col("original_info_hash").alias("info_hash"), F.col("info_hash").alias("canonical_info_hash"), F.lit(True).alias("original_is_known"))).distinct(),
    }
    return tables | {name: tables[name].unionByName(df.select(tables[name].columns)) for name, df in made.items()}, judged
