from __future__ import annotations

import hashlib
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tesserae.functions import metainfo as M
from tesserae.functions import scalar as S
from tesserae.operators.ingest import announced, ingest
from tesserae.schemas import DECODED, TABLES, empty


def doc(**info):
    return {"announce": "udp://t", "info": {"name": "n", "piece length": 16384, "pieces": b"p" * 20, "length": 5} | info}


def random_value(rng, depth=0):
    kind = rng.randrange(4 if depth < 3 else 2)
    if kind == 0:
        return rng.randrange(-(10**12), 10**12)
    if kind == 1:
        return rng.randbytes(rng.randrange(12))
    if kind == 2:
        return [random_value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.randbytes(3): random_value(rng, depth + 1) for _ in range(rng.randrange(4))}


def test_codec_round_trip():
    rng = random.Random(1)
    for _ in range(300):
        value = random_value(rng)
        assert M.bdecode(M.bencode(value)) == value


def test_known_bytes():
    assert M.bencode({"b": 1, "a": [b"x", -2], "c": None}) == b"d1:al1:xi-2ee1:bi1ee"


@pytest.mark.parametrize("bad", [b"", b"i12", b"ie", b"i1-e", b"5:abc", b"d1:ae", b"di1ei2ee", b"l", b"e", b"i1ei2e", b"x"])
def test_bad_bytes(bad):
    with pytest.raises(M.MetainfoError):
        M.bdecode(bad)


def test_unknown_info_keys_change_only_the_original_hash():
    a, b = M.decode(M.bencode(doc(custom="custom 01"))), M.decode(M.bencode(doc(custom="custom 02")))
    plain = M.decode(M.bencode(doc()))
    assert a["info_hash"] == b["info_hash"] == plain["info_hash"] == plain["original_info_hash"]
    assert len({a["original_info_hash"], b["original_info_hash"], plain["original_info_hash"]}) == 3
    assert plain["info_hash"] == hashlib.sha1(M.bencode(doc()["info"])).hexdigest()


@pytest.mark.parametrize("extra", [{"source": "s"}, {"private": 1}])
def test_known_optional_keys_change_the_hash(extra):
    assert M.decode(M.bencode(doc(**extra)))["info_hash"] != M.decode(M.bencode(doc()))["info_hash"]


def test_pieces_must_be_whole_hashes():
    assert "20-byte" in M.decode(M.bencode(doc(pieces=b"p" * 21)))["error"]


def test_synthetic():
    t = M.synthetic("d6170378-2c14-4ccc-870d-2a8e15195e23")
    assert t["info"]["length"] == 37 and t["info"]["name"] == "file-d6170378-2c14-4ccc-870d-2a8e15195e23.txt"


def test_udfs_and_column_functions(spark):
    many = doc() | {"announce-list": [["udp://t", "udp://u"], ["udp://u"]], "nodes": [["1.2.3.4", 80]]}
    many["info"] = {"name": "d", "piece length": 1, "pieces": b"", "private": 1, "files": [{"path": ["a", "b"], "length": 3}, {"path": ["c"], "length": 4}]}
    df = spark.createDataFrame([(1, bytearray(M.bencode(doc()))), (2, bytearray(M.bencode(many))), (3, bytearray(b"junk")), (4, None)], "id long, b binary")
    got = df.select("id", M.decode_metainfo("b").alias("d")).select("id", "d.*", M.total_size(F.col("d.torrent.info")).alias("size"), M.flat_trackers(F.col("d.torrent")).alias("urls"), M.public_tiers(F.col("d.torrent")).alias("tiers"), M.encode_metainfo("d.torrent").alias("back"))
    rows = {r.id: r for r in got.collect()}
    assert rows[1].size == 5 and rows[2].size == 7 and rows[1].urls == ["udp://t"] and rows[2].urls == ["udp://t", "udp://u", "udp://u"]
    assert rows[2].tiers is None and bytes(rows[2].back) == M.bencode(many) and bytes(rows[1].back) == M.bencode(doc())
    assert rows[3].error and rows[4].error and rows[3].torrent is None and rows[3].back is None


def test_ingest_classifies_and_fills_all_tables(spark):
    tables = {t: empty(spark, t) for t in TABLES}
    raw = [M.bencode(doc()), M.bencode(doc(custom="1")), M.bencode(doc(name="other")), b"junk"]
    rows = [M.decode(b) | {"title": f"title {i}", "description": "", "category_id": None, "tag_ids": [1, 1, 2], "uploader_id": 9} for i, b in enumerate(raw)]
    schema = "title string, description string, category_id long, tag_ids array<long>, uploader_id long"
    make = lambda rs: spark.createDataFrame([[r[f] for f in (*DECODED.names, "title", "description", "category_id", "tag_ids", "uploader_id")] for r in rs], type(DECODED)([*DECODED.fields, *type(DECODED).fromDDL(schema).fields]))
    now = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    tables, judged = ingest(tables, make([rows[0], rows[2], rows[3]]), now)
    tables = {t: spark.createDataFrame(df.collect(), TABLES[t]) for t, df in tables.items()}
    assert tables["torrents"].count() == 2 and tables["tag_links"].count() == 4 and tables["torrent_files"].count() == 2
    assert sorted(r.torrent_id for r in tables["torrents"].collect()) == [1, 2]
    tables, judged = ingest(tables, make([rows[0], rows[1]]), now)
    assert sorted(r.kind for r in judged.collect()) == ["alias", "known"]
    assert tables["torrents"].count() == 2 and tables["info_hashes"].count() == 3


def test_scalars(spark):
    row = spark.createDataFrame([("AbC", "a@bc.de", "a@b", " x , y,", "00zz")], "u string, e string, bad string, csv string, h string").select(
        S.is_username(F.col("u")).alias("u"), S.is_email(F.col("e")).alias("e"), S.is_email(F.col("bad")).alias("bad"), S.csv_items(F.col("csv")).alias("csv"), S.parse_hex(F.col("h")).alias("h"),
        S.sha1_text(F.lit("hello world")).alias("sha"), S.epoch_text(F.lit(1667546358)).alias("t"), S.saturating_add(F.lit((1 << 63) - 1), 5).alias("most"),
        S.is_password(F.lit("secret"), F.lit("secret")).alias("p"), S.is_password(F.lit("short"), F.lit("short")).alias("q"),
    ).first()
    assert (row.u, row.e, row.bad, row.csv, row.h) == (True, True, False, ["x", "y", ""], None)
    assert row.sha == "2aae6c35c94fcfb415dbe95f408b9ce91ee846ed" and row.t == "2022-11-04 07:19:18" and row.most == (1 << 63) - 1
    assert row.p and not row.q
    private = announced(F.col("t"), "udp://mine")
    assert private is not None


def test_epoch_text_of_any_year(spark):
    """Years past 9999 have no sign, seconds may have more than 12 digits, and a clock change in the session's zone doesn't matter."""
    texts = {
        0: "1970-01-01 00:00:00", -1: "1969-12-31 23:59:59", -62_135_596_801: "0000-12-31 23:59:59", 253_402_300_799: "9999-12-31 23:59:59", 253_402_300_800: "10000-01-01 00:00:00",
        900_000_000_000: "30489-11-11 16:00:00", 9_223_372_036_854: "294247-01-10 04:00:54", 1_710_037_800: "2024-03-10 02:30:00", None: None,
    }
    given = spark.createDataFrame([(t,) for t in texts], "t long")
    back = given.select("t", F.unix_seconds(F.to_timestamp_ntz(S.epoch_text(F.col("t"))).cast("timestamp")).alias("back"))
    assert all(r.back == r.t for r in back.collect())
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for other in (zone, "America/Los_Angeles"):
            spark.conf.set("spark.sql.session.timeZone", other)
            assert {r.t: r.text for r in given.select("t", S.epoch_text(F.col("t")).alias("text")).collect()} == texts
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def awkward_document(rng):
    """Bytes of a document with known, unknown, nested and wrong members, which may be cut, altered or not canonical."""
    text = lambda: rng.choice(["udp://t", "é漢", "", "x" * 50])
    info = {"name": text(), "piece length": 16384, "pieces": b"p" * 20 * rng.randrange(3)}
    if rng.random() < 0.5:
        info["length"] = rng.randrange(10**9)
    else:
        more = [{}, {"crc32": text(), "zz": [1, [2]]}, {"md5sum": "m"}]
        info["files"] = [{"path": [text() for _ in range(rng.randrange(3))], "length": rng.randrange(99)} | rng.choice(more) for _ in range(rng.randrange(4))]
    for key, value in (("private", rng.choice([0, 1, -5, 40000])), ("source", "s"), ("custom", random_value(rng)), ("root hash", "r"), ("path", ["a", "b"]), ("md5sum", rng.choice(["m", 5])), ("length", 1 << 70), ("aaa", 1)):
        if rng.random() < 0.15:
            info[key] = value
    out = {"info": info if rng.random() > 0.03 else rng.choice([5, [], {}])}
    for key, value in (("announce", text()), ("announce-list", [[text()], [], [text(), text()]]), ("nodes", rng.choice([[["1.2.3.4", 80], ["h", 1]], [["x"]], []])), ("httpseeds", [text()]), ("comment", rng.choice([text(), b"\xff\xfe"])), ("creation date", 5), ("created by", text()), ("unknown", random_value(rng)), ("announce", 7)):
        if rng.random() < 0.2:
            out[key] = value
    data, kind = M.bencode(out), rng.randrange(24)
    at = rng.randrange(len(data))
    return {
        0: data[:at], 1: data[:at] + rng.randbytes(1) + data[at + 1 :], 2: data + b"x", 3: data.replace(b"i16384e", b"i016384e"), 4: b"d4:infod6:lengthi5e4:name1:x12:piece lengthi1ee8:announce1:ue",
        5: b"l" * 40 + b"e" * 40, 6: rng.choice([b"", b"e", b"de", b"i5e", b"3:abc", b"d4:info"]), 7: data.replace(b"d", b"d1:a1:b1:a1:c", 1),
    }.get(kind, data)


@pytest.mark.parametrize("seed", range(6))
def test_scanned_batches_equal_documents_read_one_by_one(seed):
    rng = random.Random(seed)
    docs = [awkward_document(rng) for _ in range(300)] + [None]
    got = M.decode_all(pa.array([b"sliced off", *docs], pa.binary()).slice(1))
    got.validate(full=True)
    want = [M.decode(x or b"") for x in docs]
    assert got.to_pylist() == pa.array(want, got.type).to_pylist()
    assert 50 < sum(w["error"] is None for w in want) < 290
    assert M.decode_all(pa.array([], pa.binary())).to_pylist() == []


def test_a_long_document_does_not_hold_up_its_batch(monkeypatch):
    files = [{"path": ["a"], "length": i} for i in range(3000)]
    docs = [M.bencode(doc(length=None, files=files))] + [M.bencode(doc(length=i)) for i in range(100)]
    slow = []
    real = M.decode
    monkeypatch.setattr(M, "decode", lambda x: slow.append(x) or real(x))
    got = M.decode_all(pa.array(docs, pa.binary())).to_pylist()
    assert len(slow) == 1 and len(got[0]["torrent"]["info"]["files"]) == 3000 and [g["torrent"]["info"]["length"] for g in got[1:]] == list(range(100))


def test_canonical_documents_need_no_reader(monkeypatch):
    monkeypatch.setattr(M, "decode", None)
    got = M.decode_all(pa.array([M.bencode(doc(custom=[["x"], 1])), M.bencode(doc())], pa.binary())).to_pylist()
    assert got[0]["info_hash"] == got[1]["info_hash"] == got[1]["original_info_hash"] != got[0]["original_info_hash"]
