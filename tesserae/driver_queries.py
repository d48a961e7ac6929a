"""Query key -> callable and oracle SQL for the catalogue operators.

Driver tables stand in for catalogue tables: orders for entities, customers for
their titles and owners, order priorities for categories, distinct return flags
of line items for tags, line items for statistics, documents and labels where a
left join must miss.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable
from dataclasses import replace
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from .functions import scalar as S
from .functions import tokens
from .functions.metainfo import bencode, decode_metainfo, encode_metainfo, flat_trackers
from .functions.metainfo import total_size as metainfo_size
from .operators import backfill, lookups, mutations, policy, stateful, stats
from .operators.freshness import StaleQueue
from .operators.ingest import classify, ingest
from .operators.sums import KeptSums, applied, signed
from .plans.listing import Catalogue, ListingRequest, Sorting, listing, specify, total
from .plans.search import TitleIndex
from .schemas import TABLES, empty
from .sources.migrations import Ledger, Step, connect_migrated
from .sources.storage import new_path, stored
from .streaming import timers
from .streaming.timers import run_available, timer_session

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
NOW = "TIMESTAMP '2024-06-01 12:00:00'"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Listing


def catalogue(spark: SparkSession, sf_dir: str) -> Catalogue:
    orders, customer, lines = (read(spark, sf_dir, t) for t in ("orders", "customer", "lineitem"))
    entities = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("entity_id"), F.col("c_name").alias("title"), F.col("o_custkey").alias("uploader"), F.col("o_orderpriority").alias("category"),
        F.col("o_totalprice").alias("size"), F.col("o_orderdate").alias("uploaded"),
    )
    seeders = F.col("l_linenumber")
    sums = lines.select(F.col("l_orderkey").alias("entity_id"), seeders.alias("seeders"), F.when(F.col("l_returnflag") == "R", seeders).otherwise(0).alias("leechers"))
    tags = lines.select(F.col("l_orderkey").alias("entity_id"), F.col("l_returnflag").alias("tag")).distinct()
    return Catalogue(entities, sums, tags, orders.select(F.col("o_orderpriority").alias("name")), lines.select(F.col("l_returnflag").alias("name")))


def listing_sql(where: str = "true", order: str = "uploaded DESC", limit: int = 10, offset: int = 0, times: str = "1", joins: str = "", title: str = "c_name") -> str:
    return f"""
        WITH e AS (
            SELECT o_orderkey AS entity_id, {title} AS title, o_custkey AS uploader, o_orderpriority AS category,
                   o_totalprice AS size, o_orderdate AS uploaded
            FROM orders JOIN customer ON o_custkey = c_custkey),
        s AS (
            SELECT l_orderkey AS entity_id, sum(l_linenumber) AS a, sum(CASE WHEN l_returnflag = 'R' THEN l_linenumber ELSE 0 END) AS b
            FROM lineitem GROUP BY 1),
        t AS (SELECT DISTINCT l_orderkey AS entity_id, l_returnflag AS tag FROM lineitem)
        SELECT entity_id, title, uploader, category, size, uploaded,
               CAST(coalesce(a, 0) * {times} AS BIGINT) AS seeders, CAST(coalesce(b, 0) * {times} AS BIGINT) AS leechers
        FROM e LEFT JOIN s USING (entity_id) {joins} WHERE {where}
        ORDER BY {order}, entity_id LIMIT {limit} OFFSET {offset}"""


def _listing(request: ListingRequest, fan_out: bool, spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing(catalogue(spark, sf_dir), specify(request), fan_out)


def add_listing(name: str, request: ListingRequest, sql: str, fan_out: bool = False) -> None:
    QUERIES[name], ORACLES[name] = partial(_listing, request, fan_out), sql


_MATCHES = "(SELECT count(*) FROM t WHERE t.entity_id = e.entity_id AND t.tag IN ('A', 'R'))"
add_listing("listing_page", ListingRequest(search="customer#0000001", sort=Sorting.SEEDERS_DESC, page=1), listing_sql("title ILIKE '%customer#0000001%'", "seeders DESC", 10, 10))
for _sort in Sorting:
    _column, _down = _sort.value
    _order = f"{_column} {'DESC NULLS LAST' if _down else 'ASC NULLS FIRST'}"
    add_listing(f"listing_sort_{ {'title': 'name'}.get(_column, _column)}_{'desc' if _down else 'asc'}", ListingRequest(sort=_sort), listing_sql(order=_order))
    add_listing(f"listing_deep_{ {'title': 'name'}.get(_column, _column)}_{'desc' if _down else 'asc'}", ListingRequest(sort=_sort, page=1234), listing_sql(order=_order, offset=12340))
add_listing("listing_no_search", ListingRequest(page_size=100), listing_sql(limit=30))
add_listing("listing_search_wildcard", ListingRequest(search="r#00_000_1", sort=Sorting.SIZE_DESC), listing_sql("title ILIKE '%r#00_000_1%'", "size DESC"))
add_listing("listing_category_filter", ListingRequest(categories="1-URGENT, 5-LOW"), listing_sql("category IN ('1-URGENT', '5-LOW')"))
add_listing("listing_tag_semi", ListingRequest(tags="A,R", sort=Sorting.SEEDERS_DESC), listing_sql(f"{_MATCHES} > 0", "seeders DESC"))
add_listing("listing_tag_fanout", ListingRequest(tags="A,R", sort=Sorting.SEEDERS_DESC), listing_sql(f"{_MATCHES} > 0", "seeders DESC", times=_MATCHES), fan_out=True)
add_listing("listing_unknown_filter_ignored", ListingRequest(tags="none such", categories="5-LOW,none such"), listing_sql("category = '5-LOW'"))


@query(listing_sql("entity_id % 11 <> 0 AND title ILIKE '%mer#00%23%'", "seeders DESC", 10, 10, title="CASE WHEN o_orderkey % 10 = 0 THEN 'Renamer#00' || o_orderkey ELSE c_name END"))
def listing_search_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search through an index of all titles that was refreshed with changed and deleted ones."""
    held = catalogue(spark, sf_dir)
    index = TitleIndex.build(held.entities, new_path(spark, "titles"))
    renamed = held.entities.where("entity_id % 10 = 0").withColumn("title", F.concat(F.lit("Renamer#00"), F.col("entity_id").cast("string")))
    index.refresh(renamed, held.entities.where("entity_id % 11 = 0").select("entity_id"))
    return listing(replace(held, index=index), specify(ListingRequest(search="MER#00%23", sort=Sorting.SEEDERS_DESC, page=1)))


@query("SELECT count(*) AS total FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_name ILIKE '%customer#0000001%' AND o_orderpriority IN ('1-URGENT', '5-LOW')")
def listing_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return total(catalogue(spark, sf_dir), specify(ListingRequest(search="Customer#0000001", categories="1-URGENT,5-LOW")))


def _kept_sums(spark: SparkSession, sf_dir: str) -> KeptSums:
    """Sums of line items after three batches: two thirds inserted, then the rest with changed ones, then deletes."""
    key = ["entity_id", "line", "part"]
    rows = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("entity_id"), F.col("l_linenumber").alias("line"), F.struct("l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate").cast("string").alias("part"),
        F.col("l_linenumber").cast("long").alias("seeders"), F.when(F.col("l_returnflag") == "R", F.col("l_linenumber")).otherwise(0).cast("long").alias("leechers"),
    )
    kept = KeptSums(spark, new_path(spark, "sums"))
    first = rows.where("line <= 4")
    kept.add(signed(first.limit(0), key, first))
    second = rows.where("line > 4 or line = 1").withColumn("seeders", F.when(F.col("line") == 1, 10).otherwise(F.col("seeders")))
    kept.add(signed(first, key, second))
    kept.add(signed(applied(first, key, second), key, deletes=rows.where("entity_id % 5 = 0 and line <= 2")))
    return kept


_RECOUNT = """
    SELECT l_orderkey AS entity_id, CAST(sum(CASE WHEN l_linenumber = 1 THEN 10 ELSE l_linenumber END) AS BIGINT) AS seeders,
           CAST(sum(CASE WHEN l_returnflag = 'R' THEN l_linenumber ELSE 0 END) AS BIGINT) AS leechers
    FROM lineitem WHERE NOT (l_orderkey % 5 = 0 AND l_linenumber <= 2) GROUP BY 1"""


@query(_RECOUNT)
def kept_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums that three batches of signed changes give."""
    return _kept_sums(spark, sf_dir).current()


@query(f"SELECT entity_id, title, uploader, category, size, uploaded, coalesce(r.seeders, 0) AS seeders, coalesce(r.leechers, 0) AS leechers FROM ({listing_sql(limit=10**9)}) AS e LEFT JOIN ({_RECOUNT}) AS r USING (entity_id) ORDER BY coalesce(r.seeders, 0) DESC, entity_id LIMIT 10 OFFSET 10")
def listing_kept_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page by seeders from kept sums, folded: nothing is added up."""
    kept = _kept_sums(spark, sf_dir)
    kept.fold()
    return listing(replace(catalogue(spark, sf_dir), stats=kept.current(), summed=True), specify(ListingRequest(sort=Sorting.SEEDERS_DESC, page=1)))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing's first page of hits by seeders."""
    return listing(catalogue(spark, sf_dir), specify(ListingRequest(search="customer", sort=Sorting.SEEDERS_DESC)))


# Scans and lookups


@query("SELECT o_orderkey, o_custkey FROM orders")
def scan_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")


@query("SELECT * FROM customer WHERE c_custkey = 42")
def lookup_pk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.by_key(read(spark, sf_dir, "customer"), "c_custkey", 42)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_name = (SELECT min(n_name) FROM nation)")
def lookup_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read(spark, sf_dir, "nation")
    return nation.join(nation.agg(F.min("n_name").alias("n_name")), "n_name", "left_semi")


@query("SELECT * FROM lineitem WHERE l_orderkey = 7 AND l_linenumber = 1")
def lookup_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.by_keys(read(spark, sf_dir, "lineitem"), l_orderkey=7, l_linenumber=1)


@query("SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents")
def lookup_blank_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.blank_nulls(read(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "lang", "source")


@query("SELECT n_name AS name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS num_entities FROM nation")
def category_count_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, customer = read(spark, sf_dir, "nation"), read(spark, sf_dir, "customer")
    return spark.sql("SELECT n_name AS name, (SELECT count(*) FROM {customer} c WHERE c.c_nationkey = n.n_nationkey) AS num_entities FROM {nation} n", nation=nation, customer=customer)


@query("SELECT n_name AS name, count(c_custkey) AS num_entities FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name")
def category_count_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = read(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "n_nationkey")
    return lookups.category_counts(read(spark, sf_dir, "nation"), customer, "n_nationkey", "n_name")


@query("SELECT c_custkey, c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING'")
def user_join_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = read(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'")
    return customer.join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", "n_name")


@query("SELECT DISTINCT l_orderkey AS entity_id, l_returnflag AS name FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT'")
def tags_for_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities = read(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("entity_id"))
    lines = read(spark, sf_dir, "lineitem")
    links = lines.select(F.col("l_orderkey").alias("entity_id"), F.ascii("l_returnflag").alias("tag_id")).distinct()
    tags = lines.select(F.ascii("l_returnflag").alias("tag_id"), F.col("l_returnflag").alias("name")).distinct()
    return lookups.tags_of(entities, links, tags).select("entity_id", "name")


@query("SELECT source, count(*) AS n, CAST(coalesce(sum(quality), 0) AS BIGINT) AS quality, CAST(coalesce(sum(toxic), 0) AS BIGINT) AS toxic FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def sparse_stats_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = read(spark, sf_dir, "documents").select("doc_id", "source").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    zero = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("quality", "toxic")]
    return both.groupBy("source").agg(F.count("*").alias("n"), *zero)


@query("SELECT count(*) AS n FROM orders")
def count_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").agg(F.count("*").alias("n"))


@query("SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE ts > TIMESTAMP '2024-01-01') WHERE r = 1")
def latest_key_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = read(spark, sf_dir, "events").where("ts > TIMESTAMP '2024-01-01'").select("user_id", "event_id", "ts")
    return lookups.latest(valid, "user_id", "ts", "event_id")


@query("SELECT user_id AS tracker_key_user, event_id AS tracker_key_id, CAST(floor(epoch(ts)) AS BIGINT) AS date_expiry FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT) DESC, event_id DESC) AS r FROM events WHERE CAST(floor(epoch(ts)) AS BIGINT) > 1704067200 + 3600) WHERE r = 1")
def latest_valid_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = read(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("tracker_key_id"), F.unix_timestamp("ts").alias("date_expiry"))
    return lookups.latest_valid_key(keys, 1704067200).withColumnRenamed("user_id", "tracker_key_user")


@query("SELECT o_orderkey AS entity_id, string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_partkey, l_suppkey, l_linenumber) AS lines, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY 1")
def entity_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").withColumn("o", F.struct("l_partkey", "l_suppkey", "l_linenumber"))
    arrays = lookups.children(lines, "l_orderkey", F.col("l_linenumber"), "o", "lines")
    orders = read(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    both = orders.join(arrays, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return both.select(F.col("o_orderkey").alias("entity_id"), F.array_join("lines", ",").alias("lines"), F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n"))


# Statistics


@query(f"SELECT doc_id AS torrent_id, quality AS updated_at FROM documents LEFT JOIN labels USING (doc_id) WHERE quality < 1 OR quality IS NULL ORDER BY quality ASC NULLS FIRST, doc_id LIMIT {stats.BATCH}")
def stale_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("torrent_id"))
    seen = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("torrent_id"), F.col("quality").alias("updated_at"))
    return stats.stale(docs, seen, F.lit(1))


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return stats.upsert(events.limit(0), events, "user_id", "event_id")


@query("SELECT user_id, CASE WHEN m > 100 THEN m ELSE n END AS event_id FROM (SELECT user_id, max(event_id) AS m, min(event_id) AS n FROM events GROUP BY user_id)")
def upsert_over_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").select("user_id", "event_id")
    state = events.groupBy("user_id").agg(F.min("event_id").alias("event_id"))
    return stats.upsert(state, events.where("event_id > 100"), "user_id", "event_id")


@query("SELECT doc_id AS torrent_id, 'udp://t' AS tracker_url, CAST(coalesce(quality, 0) AS BIGINT) AS seeders, CAST(coalesce(toxic, 0) AS BIGINT) AS leechers, TIMESTAMP '2024-06-01 12:00:00' AS updated_at FROM documents LEFT JOIN labels USING (doc_id)")
def refresh_default_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("torrent_id"), F.col("doc_id").cast("string").alias("info_hash"))
    got = read(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("info_hash"), F.col("quality").cast("long").alias("seeders"), F.col("toxic").cast("long").alias("leechers"))
    return stats.refreshed(entities, got, "udp://t", F.expr(NOW)).withColumn("updated_at", F.col("updated_at").cast("timestamp_ntz"))


# Backfills


@query("SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY p_name) > 1 THEN p_name || '_' || p_partkey ELSE p_name END AS p_name FROM part")
def rename_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backfill.rename_duplicates(read(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey", "p_name")


@query("""
    WITH d AS (SELECT sha1(text) AS h, CASE WHEN quality IS NULL THEN NULL WHEN quality = 1 THEN sha1(text) ELSE sha1('x' || text) END AS o FROM documents LEFT JOIN labels USING (doc_id))
    SELECT h AS info_hash, h AS canonical_info_hash, false AS original_is_known FROM d WHERE o IS NULL
    UNION ALL SELECT h, h, true FROM d WHERE o IS NOT NULL AND o = h
    UNION ALL SELECT h, h, true FROM d WHERE o IS NOT NULL AND o <> h
    UNION ALL SELECT o, h, true FROM d WHERE o IS NOT NULL AND o <> h""")
def backfill_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = read(spark, sf_dir, "documents").select("doc_id", "text").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    h = S.sha1_text(F.col("text"))
    original = F.when(F.col("quality") == 1, h).when(F.col("quality").isNotNull(), S.sha1_text(F.concat(F.lit("x"), "text")))
    return backfill.hash_groups(both.select(h.alias("info_hash"), original.alias("original")))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS root_hash, CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority END AS pieces FROM orders")
def case_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", (F.col("o_orderstatus") == "F").cast("int").alias("flag"))
    return backfill.split_by_flag(orders, "o_orderpriority", "flag", "root_hash", "pieces").drop("o_orderpriority", "flag")


@query("SELECT sha1(text) AS info_hash, min(doc_id) AS canonical, count(*) AS n FROM documents GROUP BY 1")
def canonical_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(S.sha1_text(F.col("text")).alias("info_hash"), "doc_id")
    return docs.groupBy("info_hash").agg(F.min("doc_id").alias("canonical"), F.count("*").alias("n"))


@query("""
    SELECT doc_id, CASE WHEN sha1(text) IN (SELECT sha1(text) FROM documents JOIN labels USING (doc_id) WHERE toxic = 1) THEN 'known'
        WHEN length(text) % 100 IN (SELECT length(text) % 100 FROM documents JOIN labels USING (doc_id) WHERE toxic = 1) THEN 'alias' ELSE 'new' END AS kind
    FROM documents""")
def duplicate_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", S.sha1_text(F.col("text")).alias("original_info_hash"), (F.char_length("text") % 100).cast("string").alias("info_hash"))
    held = docs.join(read(spark, sf_dir, "labels").where("toxic = 1"), "doc_id", "left_semi")
    groups = held.select(F.col("original_info_hash").alias("info_hash"), F.col("info_hash").alias("canonical_info_hash"))
    return classify(docs, groups).select("doc_id", "kind")


@query("SELECT c_custkey AS user_id, CAST(NULL AS TIMESTAMP) AS date_registered, c_acctbal < 0 AS administrator, c_name AS username, CAST(c_custkey AS VARCHAR) AS password_hash FROM customer")
def etl_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = read(spark, sf_dir, "customer")
    old = customer.select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("username"), F.lit(None).cast("string").alias("email"), F.lit(0).alias("email_verified"), F.col("c_custkey").cast("string").alias("password"), (F.col("c_acctbal") < 0).cast("int").alias("administrator"))
    made = backfill.upgrade_users(old, F.expr(NOW))
    out = made["users"].drop("date_imported").join(made["user_profiles"].select("user_id", "username"), "user_id").join(made["user_authentication"], "user_id")
    return out.select("user_id", "date_registered", "administrator", "username", "password_hash")


@query("SELECT o_orderkey, n_name AS username, n_nationkey AS user_id FROM orders JOIN nation ON o_custkey % 25 = n_nationkey")
def dimension_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("user_id"), F.col("n_name").alias("username"))
    facts = read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 25).alias("user_id")).join(nation, "user_id").select("o_orderkey", "username")
    return backfill.attach_dimension(facts, nation, "username", "user_id")


@query("SELECT p_partkey, lower(p_brand) AS p_brand FROM part")
def lower_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backfill.lower_hashes(read(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_brand")


# Scalars and arrays


@query("SELECT page_id, url_encode(url) AS encoded FROM pages")
def url_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", S.url_encode(F.col("url")).alias("encoded"))


@query("SELECT page_id, 'magnet:?xt=urn:btih:' || sha1(html) || '&dn=' || url_encode(url) || '&tr=' || url_encode('udp://a/b') || '&tr=' || url_encode(url) AS magnet FROM pages")
def magnet_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", S.magnet_link(S.sha1_text(F.col("html")), F.col("url"), F.array(F.lit("udp://a/b"), F.col("url"))).alias("magnet"))


@query("SELECT page_id, regexp_replace(url, '/+$', '') || '/k' || page_id AS personal FROM pages")
def personal_announce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", S.personal_announce_url(F.col("url"), F.concat(F.lit("k"), F.col("page_id").cast("string"))).alias("personal"))


@query("SELECT page_id, replace(url, '/', '|') AS parts, url AS joined FROM pages")
def path_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = S.path_parts(F.col("url"))
    return read(spark, sf_dir, "pages").select("page_id", F.array_join(parts, "|").alias("parts"), S.path_text(parts).alias("joined"))


@query("SELECT p_partkey, array_to_string(list_transform(string_split(p_name || ' , ' || p_brand, ','), lambda x: trim(x)), '|') AS items FROM part")
def csv_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(S.csv_items(F.concat_ws(" , ", "p_name", "p_brand")), "|").alias("items"))


@query("SELECT p_partkey, hex(encode(p_name)) AS hexed, p_name AS back FROM part")
def hex_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    hexed = S.upper_hex(F.col("p_name").cast("binary"))
    return read(spark, sf_dir, "part").select("p_partkey", hexed.alias("hexed"), S.parse_hex(hexed).cast("string").alias("back"))


@query("SELECT doc_id, sha1(text) AS info_hash, CAST(regexp_full_match(sha1(text), '[0-9a-fA-F]{40}') AS BOOLEAN) AS valid, lower(hex(unhex(sha1(text)))) AS parsed FROM documents")
def info_hash_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = S.sha1_text(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", h.alias("info_hash"), S.is_info_hash(h).alias("valid"), S.info_hash_text(S.parse_info_hash(h)).alias("parsed"))


@query("SELECT c_custkey, regexp_full_match(c_name, '[A-Za-z0-9_-]{1,20}') AS username, octet_length(encode(c_mktsegment)) >= 3 AS title, trim(c_mktsegment) <> '' AS name, nullif(c_mktsegment, 'BUILDING') AS segment FROM customer")
def validations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select("c_custkey", S.is_username(F.col("c_name")).alias("username"), S.is_title(F.col("c_mktsegment")).alias("title"), S.is_name(F.col("c_mktsegment")).alias("name"), F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"))


@query("SELECT page_id, array_to_string(list_concat([s[1]], list_filter(s, lambda x: x <> s[1])), '|') AS parts FROM (SELECT page_id, string_split(url, '/') AS s FROM pages)")
def announce_front(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.split("url", "/")
    return read(spark, sf_dir, "pages").select("page_id", F.array_join(S.front(parts[0], parts), "|").alias("parts"))


@query("SELECT page_id, array_to_string(list_transform(list_concat([['']], list_filter(list_transform([s, ['', ''], [s[1]]], lambda t: list_filter(t, lambda x: x <> '')), lambda t: len(t) > 0)), lambda t: array_to_string(t, '|')), ';') AS tiers FROM (SELECT page_id, string_split(url, '/') AS s FROM pages)")
def announce_front_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.split("url", "/")
    tiers = F.array(parts, F.array(F.lit(""), F.lit("")), F.array(parts[0]))
    return read(spark, sf_dir, "pages").select("page_id", F.array_join(F.transform(S.front_tier(F.lit(""), tiers), lambda t: F.array_join(t, "|")), ";").alias("tiers"))


@query("SELECT page_id, replace(url, '/', '|') || '|' || url AS urls FROM pages")
def flatten_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", F.array_join(F.flatten(F.array(F.split("url", "/"), F.array("url"))), "|").alias("urls"))


@query("SELECT page_id, CAST(i - 1 AS INTEGER) AS pos, s[i] AS part FROM (SELECT page_id, string_split(url, '/') AS s FROM pages), unnest(range(1, len(s) + 1)) AS u(i)")
def explode_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", F.posexplode(F.split("url", "/")).alias("pos", "part"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS text FROM events")
def timestamp_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", S.timestamp_text(F.col("ts")).alias("text"))


@query("SELECT o_orderkey, strftime(make_timestamp(o_orderkey * 100000 * 1000000), '%Y-%m-%d %H:%M:%S') AS text FROM orders")
def epoch_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", S.epoch_text(F.col("o_orderkey") * 100000).alias("text"))


@query("SELECT event_id, ts < TIMESTAMP '2024-06-01 12:00:00' - INTERVAL 3600 SECOND AS stale FROM events")
def seconds_ago(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit("2024-06-01 12:00:00").cast("timestamp_ntz")
    return read(spark, sf_dir, "events").select("event_id", (F.col("ts").cast("timestamp_ntz") < S.seconds_before(now, 3600)).alias("stale"))


@query("SELECT event_id, event_id + 3600 AS later FROM events")
def saturating_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", S.saturating_add(F.col("event_id"), 3600).alias("later"))


@query("SELECT event_id, CAST(props::JSON ->> 'k' AS BIGINT) AS k FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("SELECT l_orderkey, CAST(sum(l_linenumber) AS BIGINT) AS size FROM lineitem GROUP BY 1")
def total_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrays = lookups.children(read(spark, sf_dir, "lineitem"), "l_orderkey", F.col("l_linenumber").cast("long"), "l_linenumber", "sizes")
    return arrays.select("l_orderkey", F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("size"))


# Policy, folds and mutations


@query("SELECT c_custkey AS user_id, CASE WHEN c_acctbal < 0 THEN 'admin' ELSE 'registered' END AS role, 'delete_torrent' AS action FROM customer WHERE c_acctbal < 0")
def policy_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), (F.col("c_acctbal") < 0).alias("administrator"))
    requests = users.select("user_id").withColumn("action", F.lit("delete_torrent"))
    return policy.allowed(policy.roles(requests, users), policy.default_policy(spark)).select("user_id", "role", "action")


_QUOTA_STEPS = """
    WITH RECURSIVE u AS (
        SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS "at", event_id AS use_id, CAST(round(value) AS BIGINT) AS size,
               row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_id) AS k FROM events),
    f AS (
        SELECT user_id, "at", use_id, size, k, true AS allowed, size AS used, "at" AS start FROM u WHERE k = 1
        UNION ALL
        SELECT user_id, "at", use_id, size, k, base < 200, CASE WHEN base < 200 THEN base + size ELSE base END, start FROM (
            SELECT u.user_id, u."at", u.use_id, u.size, u.k, CASE WHEN u."at" - f.start > 86400 THEN 0 ELSE f.used END AS base,
                   CASE WHEN u."at" - f.start > 86400 THEN u."at" ELSE f.start END AS start
            FROM f JOIN u ON u.user_id = f.user_id AND u.k = f.k + 1))
    SELECT user_id, "at", use_id, size, allowed, used FROM f"""


@query(_QUOTA_STEPS)
def quota_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    uses = read(spark, sf_dir, "events").select("user_id", F.unix_timestamp("ts").alias("at"), F.col("event_id").alias("use_id"), F.round("value").cast("long").alias("size"))
    return stateful.quota_fold(uses, 200, 86_400)


def _events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as a stream from a session whose streams can have timers. A table's files have no order in time, so all are one batch."""
    schema = read(spark, sf_dir, "events").schema
    # A stream reads a table of a single file only by a pattern, as a path must be a folder there.
    return timer_session(spark).readStream.schema(schema).option("maxFilesPerTrigger", 1 << 30).parquet(f"{sf_dir}/{{events}}.parquet")


@query(_QUOTA_STEPS)
def quota_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotas of a stream of uses, up to the watermark, which is the last use here."""
    uses = _events_stream(spark, sf_dir).select("user_id", F.unix_timestamp("ts").alias("at"), F.col("event_id").alias("use_id"), F.round("value").cast("long").alias("size"))
    return run_available(timers.quota_stream(uses, 200, 86_400, "0 seconds"), new_path(spark, "quotas"))


_CHANGES = """
    WITH b AS (SELECT DISTINCT user_id AS job, CAST(floor(epoch(ts)) AS BIGINT) AS "at" FROM events),
    u AS (SELECT max("at") AS until FROM b),
    n AS (SELECT job, "at", until, lag("at") OVER w AS before, lead("at") OVER w AS after FROM b, u WINDOW w AS (PARTITION BY job ORDER BY "at"))
    SELECT job, "at", true AS alive FROM n WHERE before IS NULL OR "at" - before > 3611
    UNION ALL
    SELECT job, "at" + 3611, false FROM n WHERE coalesce(after, until + 1) - "at" > 3611"""


def _beats(events: DataFrame) -> DataFrame:
    return events.select(F.col("user_id").alias("job"), F.unix_timestamp("ts").alias("at"))


@query(_CHANGES)
def liveness_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each job is found dead and alive again, up to the last beat of any."""
    beats = _beats(read(spark, sf_dir, "events"))
    until = beats.agg(F.max("at")).first()[0]
    return stats.liveness_changes(beats, F.lit(until).cast("long"), 3600)


@query(_CHANGES)
def liveness_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream of beats with timers."""
    return run_available(timers.liveness_stream(_beats(_events_stream(spark, sf_dir)), 3600, delay="0 seconds"), new_path(spark, "liveness"))


@query("""
    SELECT cache, "at", size FROM (
        SELECT user_id % 16 AS cache, event_id AS "at", CAST(round(value) AS BIGINT) AS size,
               sum(CAST(round(value) AS BIGINT)) OVER (PARTITION BY user_id % 16 ORDER BY event_id DESC ROWS UNBOUNDED PRECEDING) AS run
        FROM events WHERE CAST(round(value) AS BIGINT) <= 100)
    WHERE run <= 1000""")
def fifo_cache_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    puts = read(spark, sf_dir, "events").select((F.col("user_id") % 16).alias("cache"), F.col("event_id").alias("at"), F.round("value").cast("long").alias("size"))
    return stateful.cache_content(puts, 1000, 100)


def _order_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    orders, lines = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    return {
        "users": read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id")),
        "categories": read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("category_id")),
        "torrents": orders.select(F.col("o_orderkey").alias("torrent_id"), F.col("o_custkey").alias("uploader_id"), (F.col("o_custkey") % 25).alias("category_id")),
        "torrent_files": lines.select(F.col("l_orderkey").alias("torrent_id"), F.col("l_linenumber").alias("file_id")),
    }


@query("SELECT l_orderkey AS torrent_id, l_linenumber AS file_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey % 3 <> 0")
def delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = _order_tables(spark, sf_dir)
    return mutations.delete(tables, "users", tables["users"].where("user_id % 3 = 0"))["torrent_files"]


@query("SELECT o_orderkey AS torrent_id, o_custkey AS uploader_id, nullif(o_custkey % 25, 3) AS category_id FROM orders")
def set_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = _order_tables(spark, sf_dir)
    return mutations.delete(tables, "categories", tables["categories"].where("category_id = 3"))["torrents"]


@query("SELECT DISTINCT l_orderkey AS torrent_id, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE ascii(l_returnflag) END::BIGINT AS tag_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def tag_set_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    links = lines.select(F.col("l_orderkey").alias("torrent_id"), F.ascii("l_returnflag").cast("long").alias("tag_id")).distinct()
    wanted = orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("torrent_id"), F.array(F.lit(1).cast("long"), F.lit(1).cast("long")).alias("tag_ids"))
    return mutations.replace_tag_sets(links, wanted.join(links, "torrent_id", "left_semi"))


@query("SELECT c_custkey, CASE WHEN c_custkey = 7 THEN 'renamed' ELSE c_name END AS c_name FROM customer")
def guarded_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mutations.update(read(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey", 7, {"c_name": F.lit("renamed")}, ("c_name",))


@query("SELECT n_name AS name, false AS added, 30 AS ids FROM nation UNION ALL SELECT 'region ' || r_name, true, 30 FROM region")
def insert_with_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("category_id"), F.col("n_name").alias("name"))
    new = read(spark, sf_dir, "region").select(F.concat(F.lit("region "), "r_name").alias("name")).coalesce(1)
    out = mutations.insert(nation, new, "category_id", ("name",), "name")
    ids = out.agg(F.countDistinct("category_id").cast("int").alias("ids"))
    return out.select("name", (F.col("category_id") > 24).alias("added")).crossJoin(F.broadcast(ids))  # one row


# Metainfo documents


@F.arrow_udf(BinaryType())
def sample_document(number: pa.Array) -> pa.Array:
    """A valid document for each number."""
    return pa.array([bencode({"announce": "udp://t", "info": {"name": f"{i}", "piece length": 16384, "length": i, "pieces": b"p" * 20}}) for i in number.to_pylist()], pa.binary())


@query("SELECT doc_id, true AS same, NULL::VARCHAR AS error FROM documents")
def metainfo_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document made from each row decodes, encodes and decodes to one hash."""
    first = read(spark, sf_dir, "documents").select("doc_id", decode_metainfo(sample_document("doc_id")).alias("d"))
    again = first.select("doc_id", "d", decode_metainfo(encode_metainfo(F.col("d.torrent"))).alias("e"))
    return again.select("doc_id", ((F.col("d.info_hash") == F.col("e.info_hash")) & (F.col("d.info_hash") == F.col("d.original_info_hash"))).alias("same"), F.col("d.error").alias("error"))


_TEXT = "octet_length(encode(coalesce({0}, ''))) || ':' || coalesce({0}, '')"
_KNOWN = f"'6:lengthi' || n_chars || 'e4:name' || {_TEXT.format('source')} || '12:piece lengthi16384e6:pieces20:{'p' * 20}e'"
_CUSTOM = f"'6:customl' || {_TEXT.format('lang')} || 'li-5eee'"


@query(f"""
    SELECT doc_id, CASE WHEN doc_id % 7 <> 3 THEN sha1('d' || {_KNOWN}) END AS info_hash, CASE WHEN doc_id % 7 <> 3 THEN sha1('d' || {_CUSTOM} || {_KNOWN}) END AS original_info_hash,
           doc_id % 7 = 3 AS bad, CASE WHEN doc_id % 7 <> 3 THEN 'udp://t,udp://u,' || coalesce(source, '') END AS trackers
    FROM documents""")
def metainfo_unknown_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes and trackers of documents with an unknown member of the info value and tiers of trackers; one in seven is cut short."""
    text = lambda c: F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("string").alias("n"), *(F.coalesce(c, F.lit("")).alias(c) for c in ("source", "lang")))
    info = F.concat(F.lit("d6:customl"), text(F.col("lang")), F.lit("li-5eee6:lengthi"), F.col("n"), F.lit("e4:name"), text(F.col("source")), F.lit(f"12:piece lengthi16384e6:pieces20:{'p' * 20}e"))
    whole = F.concat(F.lit("d8:announce7:udp://x13:announce-listll7:udp://t7:udp://uel"), text(F.col("source")), F.lit("ee4:info"), info, F.lit("e"))
    cut = F.when(F.col("doc_id") % 7 == 3, F.substring(whole, 1, 40)).otherwise(whole)
    d = docs.select("doc_id", decode_metainfo(cut.cast("binary")).alias("d"))
    return d.select("doc_id", "d.info_hash", "d.original_info_hash", F.col("d.error").isNotNull().alias("bad"), F.when(F.col("d.error").isNull(), F.array_join(flat_trackers(F.col("d.torrent")), ",")).alias("trackers"))


@query("SELECT doc_id, 16384 + doc_id AS size, 'udp://t' AS tracker FROM documents")
def metainfo_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of decoded documents: total size and trackers."""
    d = read(spark, sf_dir, "documents").select("doc_id", decode_metainfo(sample_document("doc_id")).alias("d"))
    return d.select("doc_id", (metainfo_size(F.col("d.torrent.info")) + F.col("d.torrent.info.piece_length")).alias("size"), flat_trackers(F.col("d.torrent"))[0].alias("tracker"))


# More lookups


@query("SELECT sha1(text) AS canonical_info_hash, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS members FROM documents GROUP BY 1")
def canonical_group_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(S.sha1_text(F.col("text")).alias("canonical_info_hash"), "doc_id")
    return lookups.children(docs, "canonical_info_hash", F.col("doc_id"), "doc_id", "members").withColumn("members", F.array_join("members", ","))


@query("SELECT doc_id::VARCHAR AS info_hash, CASE WHEN quality IS NULL THEN doc_id::VARCHAR ELSE 'group ' || quality END AS canonical_info_hash FROM documents LEFT JOIN labels USING (doc_id)")
def canonical_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashes = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("info_hash"))
    groups = read(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("info_hash"), F.concat(F.lit("group "), F.col("quality").cast("string")).alias("canonical_info_hash"))
    return lookups.canonical(hashes, groups)


@query("SELECT e.event_id, CASE WHEN c_custkey IS NULL THEN 'guest' WHEN c_acctbal < 0 THEN 'admin' ELSE 'registered' END AS role FROM events e LEFT JOIN customer ON user_id = c_custkey + 50")
def roles_of_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = read(spark, sf_dir, "customer").select((F.col("c_custkey") + 50).alias("user_id"), (F.col("c_acctbal") < 0).alias("administrator"))
    return policy.roles(read(spark, sf_dir, "events").select("event_id", "user_id"), users).select("event_id", "role")


@query("SELECT event_id, event_id % 3 = 0 OR user_id % 10 = event_id % 10 AS may FROM events")
def ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    return events.select("event_id", policy.may_edit(F.col("user_id") % 10, F.col("event_id") % 10, F.col("event_id") % 3 == 0).alias("may"))


@query("SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey")
def ordered_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey")


@query("SELECT event_id, epoch(TIMESTAMP '2024-06-01 12:00:00')::BIGINT - CAST(floor(epoch(ts)) AS BIGINT) <= 3600 + 10 AS alive FROM events")
def heartbeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit("2024-06-01 12:00:00").cast("timestamp")
    return read(spark, sf_dir, "events").select("event_id", stats.is_alive(F.col("ts"), now, 3600).alias("alive"))


@query()
def fifo_cache_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    puts = read(spark, sf_dir, "events").select((F.col("user_id") % 16).alias("cache"), F.col("event_id").alias("at"), (F.col("event_id") % 40).cast("string").alias("key"), F.round("value").cast("long").alias("size"))
    return stateful.cache_fold(puts, 1000, 100)


@query("SELECT doc_id AS torrent_id, CAST(coalesce(quality, 0) + CASE WHEN doc_id % 7 = 0 THEN 100 - coalesce(quality, 0) ELSE 0 END AS BIGINT) AS seeders, CAST(CASE WHEN doc_id % 7 = 0 THEN 5 ELSE coalesce(toxic, 0) END AS BIGINT) AS leechers FROM documents LEFT JOIN labels USING (doc_id)")
def details_live_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("torrent_id"))
    have = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("torrent_id"), F.col("quality").alias("seeders"), F.col("toxic").alias("leechers"))
    live = ids.where("torrent_id % 7 = 0").select("torrent_id", F.lit(100).cast("long").alias("seeders"), F.lit(5).cast("long").alias("leechers"))
    return lookups.with_stats(ids, have, live)


@query("SELECT o_orderkey, hex(encode(o_orderkey::VARCHAR)) AS key FROM orders ORDER BY o_orderkey::VARCHAR LIMIT 30")
def bytewise_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page by the byte order of a text key."""
    key = F.hex(F.col("o_orderkey").cast("string"))
    return read(spark, sf_dir, "orders").select("o_orderkey", key.alias("key")).orderBy(S.info_hash_order(F.col("key"))).limit(30)


@query("SELECT c_custkey, coalesce(nullif(trim(c_mktsegment), 'BUILDING'), 'none') AS segment FROM customer")
def blank_to_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("c_mktsegment") == "BUILDING", "").otherwise(F.col("c_mktsegment"))
    return read(spark, sf_dir, "customer").select("c_custkey", F.coalesce(S.blank_to_null(text), F.lit("none")).alias("segment"))


@query("SELECT part.p_partkey, p_name, n > 1 AS repeats FROM part JOIN (SELECT p_name, count(*) AS n FROM part GROUP BY 1) USING (p_name) WHERE n > 1")
def duplicate_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name")
    twice = part.groupBy("p_name").count().where("count > 1")
    return part.join(twice.select("p_name"), "p_name", "left_semi").withColumn("repeats", F.lit(True))


# Awkward texts, tokens and numbers


@query(r"""
    SELECT c_custkey, regexp_full_match(c_name || CASE WHEN c_custkey % 2 = 0 THEN chr(10) ELSE '' END, '[A-Za-z0-9_-]{1,20}') AS username,
           c_custkey % 2 <> 0 AS info_hash, c_custkey % 2 <> 0 AS hex, c_custkey % 3 <> 0 AS name, c_mktsegment || '|' || c_name AS items, c_name AS token
    FROM customer""")
def awkward_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tabs, newlines and no-break spaces around names, hashes, lists and tokens."""
    end = F.when(F.col("c_custkey") % 2 == 0, "\n").otherwise("")
    name = F.when(F.col("c_custkey") % 3 == 0, "\t\n   ").otherwise(F.concat(F.lit("\t"), "c_name"))
    items = S.csv_items(F.concat(F.lit("\t"), "c_mktsegment", F.lit("\n, "), "c_name", F.lit(" \r\n")))
    return read(spark, sf_dir, "customer").select(
        "c_custkey", S.is_username(F.concat("c_name", end)).alias("username"), S.is_info_hash(F.concat(F.sha1("c_name"), end)).alias("info_hash"),
        S.parse_hex(F.concat(F.sha1("c_name"), end)).isNotNull().alias("hex"), S.is_name(name).alias("name"), F.array_join(items, "|").alias("items"), S.bearer_token(F.concat(F.lit("Bearer \t"), "c_name", F.lit("\n"))).alias("token"),
    )


@query("SELECT event_id, CASE WHEN event_id < 3600 THEN 9223372036854775807 ELSE 9223372036854775807 - event_id + 3600 END AS later FROM events")
def saturating_add_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", S.saturating_add(F.lit((1 << 63) - 1) - F.col("event_id"), 3600).alias("later"))


@query("""
    SELECT event_id, CASE WHEN e < 0 THEN -1 WHEN e < 604800 THEN 1000 + 1209600 ELSE 1000 + e END AS expiry
    FROM (SELECT event_id, (event_id % 1000) * 2000 - 1000 AS e FROM events)""")
def token_renewal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", F.coalesce(S.token_expiry((F.col("event_id") % 1000) * 2000, F.lit(1000)), F.lit(-1)).alias("expiry"))


@query("""
    SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0 WHEN event_id % 3 = 1 THEN -1 ELSE 2 * event_id END AS total FROM events""")
def tag_id_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing, malformed and good JSON arrays of ids."""
    k = F.col("event_id")
    text = F.when(k % 3 == 0, "").when(k % 3 == 1, "[1,").otherwise(F.concat(F.lit("["), k.cast("string"), F.lit(", "), k.cast("string"), F.lit("]")))
    return read(spark, sf_dir, "events").select("event_id", F.coalesce(F.aggregate(S.tag_ids(text), F.lit(0).cast("long"), lambda a, x: a + x), F.lit(-1)).alias("total"))


_GUEST = "get_about get_license get_categories get_image get_public_settings get_site_name get_tags get_torrent get_torrent_info list_torrents"
_USER = "add_torrent get_canonical_info_hash change_password"
_ADMIN = "add_category delete_category get_settings get_secret_settings add_tag delete_tag delete_torrent ban_user"


@query(f"""
    WITH r AS (SELECT c_custkey AS user_id, CASE WHEN c_custkey % 3 = 0 THEN 'guest' WHEN c_acctbal < 0 THEN 'admin' ELSE 'registered' END AS role FROM customer),
    a AS (SELECT unnest(string_split('{_GUEST} {_USER} {_ADMIN}', ' ')) AS action)
    SELECT user_id, role, action FROM r, a
    WHERE contains(' {_GUEST} ', ' ' || action || ' ') OR (role <> 'guest' AND contains(' {_USER} ', ' ' || action || ' ')) OR role = 'admin'""")
def policy_every_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every action asked for by guests, users and administrators."""
    customers = read(spark, sf_dir, "customer")
    users = customers.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("user_id"), (F.col("c_acctbal") < 0).alias("administrator"))
    requests = customers.select(F.col("c_custkey").alias("user_id"), F.explode(F.split(F.lit(f"{_GUEST} {_USER} {_ADMIN} unknown"), " ")).alias("action"))
    return policy.allowed(policy.roles(requests, users), policy.default_policy(spark)).select("user_id", "role", "action")


# Children, groups and links


@query("SELECT l_orderkey AS torrent_id, string_agg(l_returnflag, ';' ORDER BY l_linenumber, l_returnflag) AS tiers, count(*) AS n FROM lineitem GROUP BY 1")
def child_announce_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("torrent_id"), F.col("l_linenumber").alias("announce_url_id"), F.col("l_returnflag").alias("tracker_url"))
    out = lookups.announce_tiers(urls)
    return out.select("torrent_id", F.array_join(F.flatten("announce_list"), ";").alias("tiers"), F.size("announce_list").cast("long").alias("n"))


@query("""
    SELECT l_orderkey AS torrent_id, string_agg(l_linestatus, ';' ORDER BY l_linenumber, l_linestatus) AS http_seeds,
           string_agg(l_linestatus || ':' || l_suppkey, ';' ORDER BY l_linenumber, l_linestatus, l_suppkey) AS nodes
    FROM lineitem GROUP BY 1""")
def child_seeds_and_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").withColumns({"torrent_id": F.col("l_orderkey"), "http_seed_id": F.col("l_linenumber"), "node_id": F.col("l_linenumber"), "seed_url": F.col("l_linestatus"), "node_ip": F.col("l_linestatus"), "node_port": F.col("l_suppkey")})
    both = lookups.http_seeds(lines).join(lookups.dht_nodes(lines), "torrent_id")
    nodes = F.array_join(F.transform("nodes", lambda n: F.concat(n["ip"], F.lit(":"), n["port"].cast("string"))), ";")
    return both.select("torrent_id", F.array_join("http_seeds", ";").alias("http_seeds"), nodes.alias("nodes"))


@query("SELECT coalesce(bool_or(c_mktsegment = 'BUILDING' AND lower(sha1(c_name)) = lower((SELECT sha1(min(c_name)) FROM customer))), false) AS member FROM customer")
def group_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = read(spark, sf_dir, "customer")
    groups = customer.select(F.sha1("c_name").alias("info_hash"), F.sha1("c_mktsegment").alias("canonical_info_hash"))
    first = customer.agg(F.upper(F.sha1(F.min("c_name")))).scalar()
    return lookups.in_group(groups, hashlib.sha1(b"BUILDING").hexdigest().upper(), first)


@query("""
    SELECT DISTINCT l_orderkey AS torrent_id, l_linenumber::BIGINT AS tag_id FROM lineitem WHERE l_linenumber <= 2
    UNION SELECT o_orderkey, 1 FROM orders""")
def tag_links_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = read(spark, sf_dir, "lineitem").where("l_linenumber <= 2").select(F.col("l_orderkey").alias("torrent_id"), F.col("l_linenumber").cast("long").alias("tag_id")).distinct()
    return mutations.link_tags(links, read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("torrent_id"), F.lit(1).cast("long").alias("tag_id")))


@query("SELECT DISTINCT l_orderkey AS torrent_id, l_linenumber::BIGINT AS tag_id FROM lineitem WHERE NOT (l_orderkey = 7 AND l_linenumber = 2)")
def tag_links_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("torrent_id"), F.col("l_linenumber").cast("long").alias("tag_id")).distinct()
    return mutations.unlink_tags(links, 7, 2)


@query("SELECT c_custkey AS user_id, 'no reason' AS reason, '9999-01-01 00:00:00' AS date_expiry, count(*) OVER () AS ids FROM customer WHERE c_acctbal < 0")
def bans(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = read(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("user_id"))
    out = mutations.ban_users(empty(spark, "user_bans"), users)
    ids = out.agg(F.countDistinct("ban_id").alias("ids"))
    return out.select("user_id", "reason", S.timestamp_text(F.col("date_expiry")).alias("date_expiry")).crossJoin(F.broadcast(ids))  # one row


@query()
def cached_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of 40 images through 16 caches, with quotas of their readers."""
    kind = F.when(F.col("event_id") % 11 == 0, "text/html").otherwise("image/png")
    reads = read(spark, sf_dir, "events").select((F.col("user_id") % 16).alias("cache"), F.col("event_id").alias("at"), "user_id", (F.col("event_id") % 40).cast("string").alias("key"), F.round("value").cast("long").alias("size"), kind.alias("content_type"))
    return stateful.read_fold(reads, 1000, 100, 500, 3600)


# Whole mutations


@query("""
    SELECT c_name AS username, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_name || '@x.org' END AS email, false AS email_verified,
           sha1(c_name) AS password_hash, count(*) OVER () AS ids, 1::BIGINT AS administrators
    FROM customer""")
def inserted_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = read(spark, sf_dir, "customer").select(F.col("c_name").alias("username"), F.when(F.col("c_mktsegment") == "BUILDING", "").otherwise(F.concat("c_name", F.lit("@x.org"))).alias("email"), F.sha1("c_name").alias("password_hash"))
    out = mutations.insert_users({t: empty(spark, t) for t in ("users", "user_authentication", "user_profiles")}, new, F.lit("2024-06-01 12:00:00"))
    counts = out["users"].agg(F.countDistinct("user_id").alias("ids"), F.count(F.when(F.col("administrator"), 1)).alias("administrators"))
    both = out["user_profiles"].join(out["user_authentication"], "user_id")
    return both.select("username", "email", "email_verified", "password_hash").crossJoin(F.broadcast(counts))  # one row


_INFO_HASH = "sha1('d6:lengthi' || {0} || 'e4:name' || length({0}::VARCHAR) || ':' || {0} || '12:piece lengthi16384e6:pieces20:pppppppppppppppppppp' || 'e')"


@query(f"SELECT doc_id, {_INFO_HASH.format('doc_id')} AS info_hash, {_INFO_HASH.format('doc_id')} AS original_info_hash FROM documents")
def known_info_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of documents whose bytes SQL writes out."""
    return read(spark, sf_dir, "documents").select("doc_id", decode_metainfo(sample_document("doc_id")).alias("d")).select("doc_id", "d.info_hash", "d.original_info_hash")


@query(f"""
    SELECT k::VARCHAR AS name, k AS size, k AS length, '' AS path, 'udp://t' AS tracker_url, 'title' AS title, {_INFO_HASH.format('k')} AS info_hash, {_INFO_HASH.format('k')} AS canonical_info_hash, n AS ids
    FROM (SELECT DISTINCT doc_id // 2 AS k FROM documents), (SELECT count(DISTINCT doc_id // 2) AS n FROM documents)""")
def ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document uploaded twice: one of both goes in, with its file, tracker, title and hash group."""
    d = read(spark, sf_dir, "documents").select("doc_id", decode_metainfo(sample_document(F.expr("doc_id div 2"))).alias("d"))
    uploads = d.select("d.*", F.lit("title").alias("title"), F.lit("").alias("description"), F.lit(1).cast("long").alias("category_id"), F.array(F.lit(7).cast("long")).alias("tag_ids"), F.lit(1).cast("long").alias("uploader_id"))
    tables, _ = ingest({t: empty(spark, t) for t in TABLES}, uploads, F.lit("2024-06-01 12:00:00"))
    both = tables["torrents"].join(tables["torrent_files"], "torrent_id").join(tables["announce_urls"], "torrent_id").join(tables["torrent_info"], "torrent_id").join(tables["info_hashes"], "info_hash")
    ids = tables["torrents"].agg(F.countDistinct("torrent_id").alias("ids"))
    return both.select("name", "size", "length", "path", "tracker_url", "title", "info_hash", "canonical_info_hash").crossJoin(F.broadcast(ids))  # one row


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as torrents and their lines as files."""
    orders, lines = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    torrents = orders.select(F.col("o_orderkey").alias("torrent_id"), F.col("o_orderpriority").alias("name"), F.lit("6162").alias("pieces"), F.lit(5).cast("long").alias("piece_length"), F.lit(0).cast("short").alias("private"), F.lit(None).cast("string").alias("root_hash"), F.lit("s").alias("source"), (F.col("o_orderkey") % 2 == 0).alias("multi_file"))
    files = lines.select(F.col("l_orderkey").alias("torrent_id"), F.col("l_linenumber").cast("long").alias("file_id"), F.concat_ws("/", "l_returnflag", "l_linestatus").alias("path"), F.col("l_quantity").cast("long").alias("length"), F.lit(None).cast("string").alias("md5sum"))
    return torrents, files


@query("""
    WITH f AS (
        SELECT l_orderkey AS torrent_id, count(*) AS n, string_agg(l_returnflag || '/' || l_linestatus, ';' ORDER BY l_linenumber, l_returnflag, l_linestatus) AS files,
               string_agg(l_returnflag, ';' ORDER BY l_linenumber, l_returnflag) FILTER (l_linenumber <= 2) AS trackers,
               string_agg(l_linestatus || ':' || l_suppkey, ';' ORDER BY l_linestatus, l_suppkey) FILTER (l_linenumber = 1) AS nodes
        FROM lineitem GROUP BY 1),
    g AS (SELECT l_orderkey AS torrent_id, string_agg(flag, ';' ORDER BY flag) AS tags FROM (SELECT DISTINCT l_orderkey, l_returnflag AS flag FROM lineitem) GROUP BY 1)
    SELECT o_orderkey AS torrent_id, o_orderstatus AS title, CASE WHEN n = 1 THEN o_orderpriority ELSE coalesce(files, '') END AS files,
           coalesce(trackers, '') AS trackers, '' AS http_seeds, coalesce(nodes, '') AS nodes, coalesce(tags, '') AS tags
    FROM orders LEFT JOIN f ON o_orderkey = f.torrent_id LEFT JOIN g ON o_orderkey = g.torrent_id""")
def whole_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    torrents, files = _parts(spark, sf_dir)
    lines = read(spark, sf_dir, "lineitem").withColumn("torrent_id", F.col("l_orderkey"))
    info = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("torrent_id"), F.col("o_orderstatus").alias("title"))
    urls = lines.where("l_linenumber <= 2").select("torrent_id", F.col("l_linenumber").alias("announce_url_id"), F.col("l_returnflag").alias("tracker_url"))
    nodes = lines.where("l_linenumber = 1").select("torrent_id", F.col("l_linenumber").alias("node_id"), F.col("l_linestatus").alias("node_ip"), F.col("l_suppkey").alias("node_port"))
    links = lines.select("torrent_id", F.ascii("l_returnflag").cast("long").alias("tag_id")).distinct()
    tags = lines.select(F.ascii("l_returnflag").cast("long").alias("tag_id"), F.col("l_returnflag").alias("name")).distinct()
    out = lookups.details(torrents.select("torrent_id", "name"), info, files, urls, empty(spark, "http_seeds"), nodes, links, tags)
    shown = F.array_join(F.transform("files", lambda f: F.array_join(f["path"], "/")), ";")
    at = F.array_join(F.transform("nodes", lambda n: F.concat(n["ip"], F.lit(":"), n["port"].cast("string"))), ";")
    return out.select("torrent_id", "title", shown.alias("files"), F.array_join("trackers", ";").alias("trackers"), F.array_join("http_seeds", ";").alias("http_seeds"), at.alias("nodes"), F.array_join("tags", ";").alias("tags"))


@query("""
    SELECT o_orderkey AS torrent_id, o_orderpriority AS name, o_orderkey % 2 = 0 AS listed,
           CASE WHEN o_orderkey % 2 = 0 THEN total ELSE first END AS size, CASE WHEN o_orderkey % 2 <> 0 THEN path END AS path
    FROM orders LEFT JOIN (
        SELECT l_orderkey, CAST(sum(CAST(trunc(l_quantity) AS BIGINT)) AS BIGINT) AS total,
               (array_agg(CAST(trunc(l_quantity) AS BIGINT) ORDER BY l_linenumber, l_returnflag, l_linestatus, trunc(l_quantity)))[1] AS first,
               (array_agg(l_returnflag || '/' || l_linestatus ORDER BY l_linenumber, l_returnflag, l_linestatus, trunc(l_quantity)))[1] AS path
        FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey WHERE total IS NOT NULL""")
def hydrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Info structs of one and of many files, with their sizes."""
    torrents, files = _parts(spark, sf_dir)
    out = lookups.hydrate(torrents, files)
    return out.select("torrent_id", "info.name", F.col("info.files").isNotNull().alias("listed"), metainfo_size(F.col("info")).alias("size"), F.array_join("info.path", "/").alias("path")).where("size is not null")


@query("""
    SELECT o_orderkey AS torrent_id, o_custkey AS uploader_id, sha1(o_orderkey::VARCHAR) AS info_hash, o_orderkey AS size, o_orderkey::VARCHAR AS name, '' AS path, o_orderkey AS length,
           'udp://t' AS tracker_url, o_orderstatus AS title, make_timestamp((o_orderkey * 1000)::BIGINT * 1000000) AS date_uploaded
    FROM orders JOIN customer ON o_custkey = c_custkey""")
def upgraded_torrents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Torrents of the first catalogue with their documents, in the new one's tables."""
    customer = read(spark, sf_dir, "customer").select(F.col("c_name").alias("username"), F.col("c_custkey").alias("user_id"))
    orders = read(spark, sf_dir, "orders").join(customer, F.col("o_custkey") == F.col("user_id"))
    old = orders.select(F.col("o_orderkey").alias("torrent_id"), F.col("username").alias("uploader"), F.lit(1).cast("long").alias("category_id"), F.upper(F.sha1(F.col("o_orderkey").cast("string"))).alias("info_hash"), F.col("o_orderkey").alias("file_size"), (F.col("o_orderkey") * 1000).alias("upload_date"), F.col("o_orderstatus").alias("title"), F.lit("").alias("description"))
    documents = old.select("torrent_id", decode_metainfo(sample_document("torrent_id"))["torrent"].alias("torrent"))
    out = backfill.upgrade_torrents(old, customer, documents)
    both = out["torrents"].join(out["torrent_files"], "torrent_id").join(out["announce_urls"], "torrent_id").join(out["torrent_info"], "torrent_id")
    return both.select("torrent_id", "uploader_id", "info_hash", "size", "name", "path", "length", "tracker_url", "title", "date_uploaded")


# Migrations

_STEPS = (
    Step("trimmed", {"torrents": "SELECT o_orderkey AS torrent_id, o_custkey AS uploader_id, lower(trim(o_orderpriority)) AS category, o_totalprice AS size FROM {orders}"}),
    Step("categories", {
        "categories": "SELECT DISTINCT category AS name FROM {torrents}",
        "torrents": "SELECT torrent_id, uploader_id, category, CAST(floor(size) AS BIGINT) AS size, false AS hidden FROM {torrents}",
    }),
    Step("uploads", {
        "uploads": "SELECT uploader_id, c.name AS category, count(t.torrent_id) AS n, coalesce(sum(t.size), 0) AS size FROM {categories} c JOIN {torrents} t ON t.category = c.name GROUP BY uploader_id, c.name",
        "categories": None,
    }),
)


@query("""
    SELECT o_custkey AS uploader_id, lower(trim(o_orderpriority)) AS category, count(*) AS n, sum(CAST(floor(o_totalprice) AS BIGINT))::BIGINT AS size
    FROM orders GROUP BY 1, 2""")
def migrated_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table after three steps, the last two in a later run that finds the first in the ledger."""
    url = new_path(spark, "migrated")
    read(spark, sf_dir, "orders").write.parquet(f"{url}/orders.parquet")
    Ledger(spark, url).migrate(_STEPS[:1])
    return connect_migrated(spark, url, _STEPS)("uploads")


# Tokens

_PEPPER = b"token pepper"
_PADS = ["".join(f"\\x{b ^ pad:02x}" for b in _PEPPER.ljust(64, b"\0")) for pad in (0x36, 0x5C)]
_URL = "rtrim(translate(to_base64({0}), '+/', '-_'), '=')"
_CLAIMS_SQL = """'{"user":{"user_id":' || c_custkey || ',"username":"' || c_name || '","administrator":' || CASE WHEN c_acctbal < 0 THEN 'true' ELSE 'false' END || '},"exp":' || CAST(1700000000 + 1209600 AS VARCHAR) || '}'"""


@query(f"""
    WITH h AS (SELECT c_custkey, {_URL.format("encode('" + tokens.HEADER + "')")} || '.' || {_URL.format(f"encode({_CLAIMS_SQL})")} AS head FROM customer)
    SELECT c_custkey, head || '.' || {_URL.format(f"unhex(sha256('{_PADS[1]}'::BLOB || unhex(sha256('{_PADS[0]}'::BLOB || encode(head)))))")} AS token FROM h""")
def signed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A token for every customer."""
    return read(spark, sf_dir, "customer").select("c_custkey", tokens.sign(_PEPPER, F.col("c_custkey"), F.col("c_name"), F.col("c_acctbal") < 0, F.lit(1_700_000_000)).alias("token"))


@query("""
    SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN 'valid' WHEN 1 THEN 'valid' WHEN 2 THEN 'expired' ELSE 'invalid' END AS status, CASE WHEN c_custkey % 7 < 2 THEN c_name END AS username,
           CASE c_custkey % 7 WHEN 0 THEN true WHEN 1 THEN false END AS kept
    FROM customer""")
def verified_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens that are good, near their end, expired, long expired, forged, altered and cut short; good ones are renewed in their last week."""
    now, made, k = 1_700_000_000, read(spark, sf_dir, "customer"), F.col("c_custkey") % 7
    past = F.when(k == 1, 700_000).when(k == 2, 1_209_630).when(k == 3, 1_300_000).otherwise(0)
    sign = lambda secret: tokens.sign(secret, F.col("c_custkey"), F.col("c_name"), F.col("c_acctbal") < 0, now - past)
    token = F.when(k == 4, sign(b"another")).when(k == 5, F.regexp_replace(sign(_PEPPER), r"\.(.)", ".X$1")).when(k == 6, F.expr("substring(token, 1, length(token) - 2)")).otherwise(F.col("token"))
    held = made.withColumn("token", sign(_PEPPER)).withColumn("token", token)
    seen = tokens.verify(_PEPPER, F.col("token"), F.lit(now))
    return held.select("c_custkey", seen["status"].alias("status"), seen["claims"]["user"]["username"].alias("username"), (tokens.renew(_PEPPER, F.col("token"), F.lit(now)) == F.col("token")).alias("kept"))


# Freshness


@query("""
    SELECT o_orderkey, CAST((row_number() OVER (ORDER BY CASE WHEN o_orderkey % 50 > 0 THEN o_orderdate END NULLS FIRST, o_orderkey) - 1) // 250 AS INTEGER) AS tick
    FROM orders QUALIFY tick < 3""")
def stale_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oldest orders of three ticks, each of which refreshes what it finds; some were never refreshed."""
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("torrent_id"), F.col("o_orderdate").alias("updated_at"))
    queue = StaleQueue.build(orders, orders.where("torrent_id % 50 > 0"), new_path(spark, "queue"))
    now, out = F.lit("2030-01-01 00:00:00").cast("timestamp_ntz"), []
    for tick in range(3):
        batch = stored(queue.oldest(now, 250), "batch")
        queue.refreshed(batch, now)
        out.append(batch.select(F.col("key").alias("o_orderkey"), F.lit(tick).alias("tick")))
    return out[0].unionByName(out[1]).unionByName(out[2])


_KINDS = ("image/png", "image/svg+xml", "IMAGE/PNG", "image/jpeg", "", "image/gif")


@query("SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'image/png' ELSE 'image/jpeg' END AS content_type FROM events WHERE event_id % 6 IN (0, 3)")
def cacheable_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers whose content type may be cached; null and other ones may not."""
    kind = F.get(F.array(*map(F.lit, _KINDS)), (F.col("event_id") % 6).cast("int"))
    return stateful.accepted_types(read(spark, sf_dir, "events").select("event_id", F.nullif(kind, F.lit("")).alias("content_type")))


@query("SELECT count(*) AS n, true AS one, true AS fresh FROM events")
def query_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of a query has the same present second, which is that of the clock."""
    now = read(spark, sf_dir, "events").select(S.now_seconds().alias("now"))
    return now.agg(F.count("*").alias("n"), (F.min("now") == F.max("now")).alias("one"), (F.abs(F.max("now") - F.lit(int(time.time()))) < 3600).alias("fresh"))
