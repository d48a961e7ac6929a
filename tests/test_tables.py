from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tesserae.operators import backfill, lookups, mutations, policy, stateful, stats
from tesserae.schemas import TABLES, empty
from tesserae.functions.metainfo import decode_metainfo
from tesserae.sources.tables import NotFound, backup, connect, metainfo_responses, one, parse_stats, restore, seed_catalogue, service_stats


def now():
    return F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def test_insert_users_and_uniqueness(spark):
    tables = {t: empty(spark, t) for t in ("users", "user_authentication", "user_profiles")}
    new = spark.createDataFrame([("ann", "", "h1"), ("bob", "b@x.y", "h2")], "username string, email string, password_hash string")
    tables = mutations.insert_users(tables, new, now())
    assert sorted(r.user_id for r in tables["users"].collect()) == [1, 2]
    assert [r.user_id for r in tables["users"].where("administrator").collect()] == [1]
    assert dict(rows(tables["user_profiles"], "username", "email"))["ann"] is None
    with pytest.raises(mutations.Duplicate, match="email"):
        mutations.insert_users(tables, spark.createDataFrame([("cyd", "b@x.y", "h")], new.schema), now())
    with pytest.raises(mutations.Duplicate, match="username"):
        mutations.insert_users(tables, spark.createDataFrame([("d", None, "h"), ("d", None, "h")], new.schema), now())


def test_cascades(spark):
    torrents = spark.createDataFrame([(1, 1, 5), (2, 2, 5), (3, 2, None)], "torrent_id long, uploader_id long, category_id long")
    tables = {
        "users": spark.createDataFrame([(1,), (2,)], "user_id long"), "categories": spark.createDataFrame([(5,)], "category_id long"), "torrents": torrents,
        "tag_links": spark.createDataFrame([(1, 7), (2, 7), (3, 8)], "torrent_id long, tag_id long"), "tags": spark.createDataFrame([(7,), (8,)], "tag_id long"),
    }
    gone = mutations.delete(tables, "users", spark.createDataFrame([(2,)], "user_id long"))
    assert rows(gone["torrents"], "torrent_id") == [(1,)] and rows(gone["tag_links"]) == [(1, 7)]
    assert {r.category_id for r in mutations.delete(tables, "categories", spark.createDataFrame([(5,)], "category_id long"))["torrents"].collect()} == {None}
    assert rows(mutations.delete(tables, "tags", spark.createDataFrame([(7,)], "tag_id long"))["tag_links"]) == [(3, 8)]
    with pytest.raises(NotFound):
        mutations.delete(tables, "tags", spark.createDataFrame([(99,)], "tag_id long"))
    assert all(df.count() == 0 for df in mutations.truncate(tables).values())


def test_updates_and_tag_sets(spark):
    users = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    assert rows(mutations.update(users, "id", 1, {"name": F.lit("c")}, ("name",))) == [(1, "c"), (2, "b")]
    with pytest.raises(mutations.Duplicate):
        mutations.update(users, "id", 1, {"name": F.lit("b")}, ("name",))
    with pytest.raises(NotFound):
        mutations.update(users, "id", 9, {"name": F.lit("b")})
    assert rows(mutations.update(users, "id", 9, {"name": F.lit("b")}, must_exist=False)) == rows(users)
    links = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "torrent_id long, tag_id long")
    wanted = spark.createDataFrame([(1, [2, 1, 1]), (2, [3]), (3, [4])], "torrent_id long, tag_ids array<long>")
    assert rows(mutations.replace_tag_sets(links, wanted)) == [(1, 1), (1, 2), (2, 3), (3, 4)]
    assert rows(mutations.link_tags(links, spark.createDataFrame([(1, 1), (5, 5), (5, 5)], links.schema))) == [(1, 1), (1, 2), (2, 1), (5, 5)]
    assert rows(mutations.unlink_tags(links, 1)) == [(2, 1)] and rows(mutations.unlink_tags(links, 1, 2)) == [(1, 1), (2, 1)]


def test_lookups(spark, tmp_path):
    torrents = spark.createDataFrame([(1, "ab"), (2, "cd")], "torrent_id long, info_hash string")
    assert one(lookups.by_info_hash(torrents, "CD"), "torrent")["torrent_id"] == 2
    with pytest.raises(NotFound):
        one(lookups.by_key(torrents, "torrent_id", 9), "torrent")
    groups = spark.createDataFrame([("ab", "zz", True)], "info_hash string, canonical_info_hash string, original_is_known boolean")
    assert rows(lookups.canonical(torrents, groups), "info_hash", "canonical_info_hash") == [("ab", "zz"), ("cd", "cd")]
    torrents.write.parquet(f"{tmp_path}/torrents.parquet")
    reader = connect(spark, str(tmp_path))
    assert reader("torrents").count() == 2 and reader("tags").count() == 0 and reader("tags").schema == TABLES["tags"]


def test_details_and_hydration(spark):
    torrents = spark.createDataFrame([(1, "one", "6162", 5, None, None, None, False), (2, "two", "6162", 5, 1, None, "s", True), (3, "bare", None, 5, None, "ff", None, True)], "torrent_id long, name string, pieces string, piece_length long, private short, root_hash string, source string, multi_file boolean")
    make = lambda t, data: spark.createDataFrame(data, TABLES[t])
    files = make("torrent_files", [(1, 1, None, 3, None), (2, 2, None, 4, "a/b"), (3, 2, None, 1, "c")])
    got = lookups.details(torrents, make("torrent_info", [(1, "t1", None), (2, "t2", "d"), (3, "t3", None)]), files, make("announce_urls", [(2, 1, "u2"), (1, 1, "u1")]), make("http_seeds", []), make("nodes", [(1, 2, "1.1.1.1", 9)]), make("tag_links", [(2, 1)]), make("tags", [(1, "x", None)]))
    by = {r.torrent_id: r for r in got.collect()}
    assert by[1].trackers == ["u1", "u2"] and by[1].files[0].path == ["one"] and by[2].tags == ["x"] and by[2].nodes[0].port == 9 and by[3].files == []
    assert [f.path for f in by[2].files] == [["a", "b"], ["c"]]
    info = {r.torrent_id: r.info for r in lookups.hydrate(torrents, files).collect()}
    assert info[1].length == 3 and info[1].path is None and info[1].files is None and info[2].files[1].length == 1 and info[2].source == "s" and info[3].root_hash == "ff"


def test_stale_upsert_and_refresh_modes(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    entities = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "torrent_id long, info_hash string")
    have = spark.createDataFrame([(1, "u", 1, 1, t(1)), (2, "u", 1, 1, t(9)), (4, "u", 1, 1, None)], TABLES["tracker_stats"])
    got = stats.stale(entities, have, F.lit(t(5)).cast("timestamp_ntz"))
    assert [r.torrent_id for r in got.collect()] == [3, 4, 1]
    fetched = spark.createDataFrame([("a", 7, 8)], "info_hash string, seeders long, leechers long")
    after = stats.refresh(have, entities.where("torrent_id in (1, 3)"), fetched, "v", now())
    assert rows(after, "torrent_id", "tracker_url", "seeders") == [(1, "v", 7), (2, "u", 1), (3, "v", 0), (4, "u", 1)]
    assert stats.refresh(have, entities, None, "v", now()) is have
    assert {r.seeders for r in stats.refresh(have, entities, None, "v", now(), zero_on_failure=True).collect()} == {0}
    alive = spark.range(1).select(stats.is_alive(F.lit("2024-01-01 00:00:00").cast("timestamp"), F.lit("2024-01-01 00:00:12").cast("timestamp"), 2).alias("a")).first().a
    assert alive


def test_external_statistics(spark):
    hashes = spark.createDataFrame([("a",), ("b",)], "info_hash string")
    got = service_stats(hashes, lambda hs: [{"info_hash": h, "seeders": 1, "completed": 2, "leechers": 3} for h in hs if h != "b"])
    assert rows(got) == [("a", 1, 2, 3)]
    text = spark.createDataFrame([('[{"info_hash":"x","seeders":4,"completed":5,"leechers":6}]',), ("junk",)], "j string")
    assert rows(parse_stats(text, "j")) == [("x", 4, 5, 6)]


def test_backfills(spark):
    names = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id long, name string")
    assert rows(backfill.rename_duplicates(names, "id", "name"), "id", "name") == [(1, "a_1"), (2, "a_2"), (3, "b")]
    groups = spark.createDataFrame([("x", None), ("y", "y"), ("z", "o")], "info_hash string, original string")
    assert rows(backfill.hash_groups(groups)) == [("o", "z", True), ("x", "x", False), ("y", "y", True), ("z", "z", True)]
    with pytest.raises(LookupError):
        backfill.attach_dimension(names, names.where("id = 3").select("name", F.col("id").alias("k")), "name", "k")
    old = spark.createDataFrame([(1, "ann", "e", True, "pw", False)], "user_id long, username string, email string, email_verified boolean, password string, administrator boolean")
    made = backfill.upgrade_users(old, now())
    assert made["users"].first().date_registered is None and made["user_profiles"].first().bio is None
    keys = spark.createDataFrame([(1, 2, "k", 99)], "key_id long, user_id long, key string, valid_until long")
    assert backfill.upgrade_keys(keys).schema == TABLES["tracker_keys"]


def test_upgrade_torrents(spark):
    from tesserae.functions import metainfo as M

    raw = M.bencode({"announce": "udp://t", "info": {"name": "n", "piece length": 1, "pieces": b"", "files": [{"path": ["a", "b"], "length": 3}]}})
    docs = spark.createDataFrame([(1, bytearray(raw))], "torrent_id long, b binary").select("torrent_id", M.decode_metainfo("b").alias("d")).select("torrent_id", "d.torrent")
    old = spark.createDataFrame([(1, "ann", "AB", "title", 3, None, 1667546358, 3)], "torrent_id long, uploader string, info_hash string, title string, category_id long, description string, upload_date long, file_size long")
    made = backfill.upgrade_torrents(old, spark.createDataFrame([("ann", 7)], "username string, user_id long"), docs)
    row = made["torrents"].first()
    assert (row.uploader_id, row.info_hash, str(row.date_uploaded), row.private, row.multi_file) == (7, "ab", "2022-11-04 07:19:18", 0, True)
    assert made["torrents"].schema.names == TABLES["torrents"].names
    assert made["torrent_files"].first().path == "a/b" and made["announce_urls"].first().tracker_url == "udp://t"


def test_policy(spark):
    default = policy.default_policy(spark)
    assert rows(default.groupBy("role").count()) == [("admin", 21), ("guest", 10), ("registered", 13)]
    users = spark.createDataFrame([(1, True), (2, False)], "user_id long, administrator boolean")
    asks = spark.createDataFrame([(1, "delete_torrent"), (2, "delete_torrent"), (2, "add_torrent"), (None, "list_torrents"), (9, "add_torrent")], "user_id long, action string")
    got = policy.allowed(policy.roles(asks, users), default)
    assert sorted((r.user_id or 0, r.action) for r in got.collect()) == [(0, "list_torrents"), (1, "delete_torrent"), (2, "add_torrent")]
    owner = spark.createDataFrame([("a", "a", False), ("a", "b", False), ("a", "b", True), ("a", None, None)], "o string, u string, adm boolean").select(policy.may_edit(F.col("o"), F.col("u"), F.col("adm")).alias("x"))
    assert [r.x for r in owner.collect()] == [True, False, True, False]


def test_cache_rules():
    c = stateful.ByteCache(10, 6)
    assert not c.put("big", 7) and c.put("a", 4) and c.put("b", 4) and c.put("c", 4)
    assert list(c.entries) == ["b", "c"]
    assert c.put("b", 1) and list(c.entries) == ["c", "b"]
    small = stateful.ByteCache(3, 6)
    assert small.put("a", 3) and not small.put("a", 5) and not small.entries


def test_folds_match_models(spark):
    rng = random.Random(3)
    data = [(rng.randrange(5), rng.randrange(400), i, rng.randrange(60)) for i in range(400)]
    uses = spark.createDataFrame(data, "user_id long, at long, use_id long, size long")
    got = {r.use_id: (r.allowed, r.used) for r in stateful.quota_fold(uses, 100, 50).collect()}
    model = {u: stateful.Quota(100, 50) for u in range(5)}
    for u, at, i, size in sorted(data, key=lambda x: (x[0], x[1], x[2])):
        allowed = model[u].take(at, size)
        assert got[i] == (allowed, model[u].used)
    puts = spark.createDataFrame([(c, at, f"k{at}", 1 + (at * 7) % 20) for c in range(3) for at in range(60)], "cache long, at long, key string, size long")
    left = rows(stateful.cache_content(puts, 50, 15), "cache", "key")
    expected = []
    for c in range(3):
        cache = stateful.ByteCache(50, 15)
        for at in range(60):
            cache.put(f"k{at}", 1 + (at * 7) % 20)
        expected += [(c, k) for k in cache.entries]
    assert left == sorted(expected)
    assert stateful.cache_fold(puts, 50, 15).where("stored").count() == puts.where("size <= 15").count()


def test_refresh_ticks(spark):
    from tesserae.streaming.refresh import start_refresh

    seen = []
    q = start_refresh(spark, lambda: seen.append(1), seconds=1)
    q.processAllAvailable()
    q.stop()
    assert seen


def test_whole_upgrade(spark):
    from tesserae.functions import metainfo as M

    raw = M.bencode({"info": {"name": "n", "piece length": 1, "pieces": b"", "length": 3}})
    docs = spark.createDataFrame([(1, bytearray(raw))], "torrent_id long, b binary").select("torrent_id", M.decode_metainfo("b").alias("d")).select("torrent_id", "d.torrent")
    old = {
        "categories": spark.createDataFrame([(3, "movies")], "category_id long, name string"),
        "users": spark.createDataFrame([(7, "ann", None, True, "pw", True)], "user_id long, username string, email string, email_verified boolean, password string, administrator boolean"),
        "tracker_keys": spark.createDataFrame([(1, 7, "k", 99)], "key_id long, user_id long, key string, valid_until long"),
        "torrents": spark.createDataFrame([(1, "ann", "AB", "t", 3, None, 0, 3)], "torrent_id long, uploader string, info_hash string, title string, category_id long, description string, upload_date long, file_size long"),
    }
    made = backfill.upgrade(old, docs, now())
    assert {t: df.count() for t, df in made.items()} == {"categories": 1, "users": 1, "user_authentication": 1, "user_profiles": 1, "tracker_keys": 1, "torrents": 1, "torrent_info": 1, "torrent_files": 1, "announce_urls": 0}
    with pytest.raises(ValueError):
        backfill.upgrade_categories(old["categories"], spark.createDataFrame([(4, "movies")], "category_id long, name string"))


def test_live_stats_and_group_membership(spark):
    ids = spark.createDataFrame([(1,), (2,), (3,)], "torrent_id long")
    have = spark.createDataFrame([(1, 5, 6), (2, 7, 8)], "torrent_id long, seeders long, leechers long")
    live = spark.createDataFrame([(2, 1, 0)], have.schema)
    assert rows(lookups.with_stats(ids, have, live)) == [(1, 5, 6), (2, 1, 0), (3, 0, 0)]
    assert rows(lookups.with_stats(ids, have)) == [(1, 5, 6), (2, 7, 8), (3, 0, 0)]
    groups = spark.createDataFrame([("aa", "cc", True)], TABLES["info_hashes"])
    assert lookups.in_group(groups, "CC", "AA").first().member and not lookups.in_group(groups, "cc", "zz").first().member
    assert not lookups.in_group(groups.limit(0), "cc", "aa").first().member


@pytest.mark.parametrize(
    "customers, member",
    [
        ([("b", "BUILDING"), ("a", "BUILDING"), ("Customer#000000001", "MACHINERY"), ("Aa", "BUILDING")], True), ([("a", "MACHINERY"), ("b", "BUILDING")], False), ([("a", "Building")], False),
        ([("a", "MACHINERY"), ("a", "BUILDING")], True), ([(None, "BUILDING"), ("b", "BUILDING"), ("c", None)], True), ([(None, "BUILDING")], False), ([], False),
    ],
)
def test_group_membership_of_the_first_name(spark, tmp_path, customers, member):
    """The query asks for the first name that the table has, and for its segment as it is written."""
    from tesserae.driver_queries import ORACLES, group_member

    duckdb = pytest.importorskip("duckdb")
    spark.createDataFrame(customers, "c_name string, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    assert [r.member for r in group_member(spark, str(tmp_path)).collect()] == [member]
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
        assert con.execute(ORACLES["group_member"]).fetchall() == [(member,)]


def test_files_and_synthetic_uploads(spark, tmp_path):
    from tesserae.sources.tables import metainfo_files, synthetic_uploads

    made = synthetic_uploads(spark, 5).collect()
    assert len({r.uuid for r in made}) == 5
    for i, r in enumerate(made):
        (tmp_path / f"{i}.torrent").write_bytes(bytes(r.content))
    (tmp_path / "bad.torrent").write_bytes(b"junk")
    got = metainfo_files(spark, str(tmp_path))
    assert got.where("error is null").select("info_hash").distinct().count() == 5 and got.where("error is not null").count() == 1


def test_new_rows_and_their_limits(spark, tmp_path):
    bans = mutations.ban_users(empty(spark, "user_bans"), spark.createDataFrame([(7,)], "user_id long"))
    assert rows(bans, "ban_id", "user_id", "reason", "date_expiry") == [(1, 7, "no reason", dt.datetime(9999, 1, 1))]
    keys = mutations.add_tracker_keys(empty(spark, "tracker_keys"), spark.createDataFrame([(7, "k", 9)], "user_id long, tracker_key string, date_expiry long"))
    assert rows(keys) == [(1, 7, "k", 9)]
    groups = mutations.add_to_groups(empty(spark, "info_hashes"), spark.createDataFrame([("a", "b")], "info_hash string, canonical_info_hash string"))
    assert rows(groups) == [("a", "b", True)]
    with pytest.raises(mutations.Duplicate):
        mutations.add_to_groups(groups, groups.select("info_hash", "canonical_info_hash"))
    ids = spark.createDataFrame([(3, 5)], "p long, c int").select(mutations.child_id(F.col("p"), F.col("c")).alias("i"))
    assert ids.first().i == (3 << 20) + 5
    for p, c in ((3, 1 << 20), (1 << 43, 0)):
        with pytest.raises(Exception, match="too many children"):
            spark.createDataFrame([(p, c)], "p long, c int").select(mutations.child_id(F.col("p"), F.col("c"))).collect()
    tables = {"info_hashes": groups, "tracker_keys": keys}
    backup(tables, str(tmp_path / "copy"))
    back = restore(spark, str(tmp_path / "copy"))
    assert rows(back["info_hashes"]) == rows(groups) and back["users"].count() == 0 and set(back) == set(TABLES)


def test_refresh_of_each_and_upgrade_checks(spark):
    entities = spark.createDataFrame([(1, "a"), (2, "b")], "torrent_id long, info_hash string")
    after = stats.refresh_each(empty(spark, "tracker_stats"), entities, lambda hs: [{"info_hash": h, "seeders": len(hs), "completed": 0, "leechers": 4} for h in hs if h == "a"], "u", now())
    assert rows(after, "torrent_id", "seeders", "leechers") == [(1, 1, 4), (2, 0, 0)]
    old = spark.createDataFrame([(1, "x")], "category_id long, name string")
    with pytest.raises(ValueError, match="change its id"):
        backfill.upgrade_categories(old, spark.createDataFrame([(2, "x")], old.schema))
    torrents = spark.createDataFrame([(1, "u")], "torrent_id long, uploader string")
    with pytest.raises(LookupError, match="no document for torrent 1"):
        backfill.upgrade_torrents(torrents, old, spark.createDataFrame([], "torrent_id long, torrent string"))


def test_reads_through_a_cache(spark):
    state = stateful.CachedReads(capacity=10, entry_limit=6, most=12, period=100)
    steps = [(0, 1, "a", 5, True, "fetched"), (1, 1, "a", 5, True, "hit"), (2, 1, "b", 7, True, "too big"), (3, 1, "c", 5, False, "no image"), (4, 1, "c", 6, True, "fetched"), (5, 1, "a", 5, True, "fetched"), (6, 1, "d", 1, True, "quota met"), (7, 2, "d", 1, True, "fetched"), (500, 1, "e", 1, True, "quota met"), (501, 1, "d", 1, True, "hit")]
    assert [state.read(*s[:5]) for s in steps] == [s[5] for s in steps] and state.cache.held == sum(state.cache.entries.values())
    reads = spark.createDataFrame([(1, at, user, key, size, "image/png" if ok else None) for at, user, key, size, ok, _ in steps], "cache long, at long, user_id long, key string, size long, content_type string")
    assert [r.outcome for r in stateful.read_fold(reads, 10, 6, 12, 100).orderBy("at").collect()] == [s[5] for s in steps]


def test_download_answers_and_seeding(spark):
    seen = []
    seed_catalogue(spark, 3, lambda df: seen.append(df.select("content", "uuid").collect()), seconds=0.01)
    assert [len(x) for x in seen] == [1, 1, 1] and len({x[0].uuid for x in seen}) == 3
    docs = spark.createDataFrame([(bytes(x[0].content),) for x in seen], "content binary").select(decode_metainfo("content").alias("d")).select("d.*")
    for r in metainfo_responses(docs).collect():
        assert r.headers["content-type"] == "application/x-bittorrent" and r.headers["content-disposition"] == f"attachment; filename={r.filename}" and r.headers["x-info-hash"] == r.info_hash
        assert bytes(r.content) in {bytes(x[0].content) for x in seen}
