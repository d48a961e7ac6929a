from __future__ import annotations

import base64
import hashlib
import hmac
import json

import pytest
from pyspark.sql import functions as F

from tesserae.functions import tokens as T

SECRET = b"pepper of the tokens"
NOW = 1_700_000_000
USER = {"user_id": 7, "username": "ann \"é\" \\", "administrator": True}


def b64(data):
    return base64.urlsafe_b64encode(data).rstrip(b"=").decode()


def made(claims, secret=SECRET, header=T.HEADER):
    head = f"{b64(header.encode())}.{b64(claims if isinstance(claims, bytes) else json.dumps(claims, separators=(',', ':'), ensure_ascii=False).encode())}"
    return f"{head}.{b64(hmac.new(secret, head.encode(), hashlib.sha256).digest())}"


#: Test cases of RFC 4231: key, data, code.
VECTORS = [
    (b"\x0b" * 20, b"Hi There", "b0344c61d8db38535ca8afceaf0bf12b881dc200c9833da726e9376c2e32cff7"),
    (b"Jefe", b"what do ya want for nothing?", "5bdcc146bf60754e6a042426089575c75a003f089d2739839dec58b964ec3843"),
    (b"\xaa" * 20, b"\xdd" * 50, "773ea91e36800e46854db8ebd09181a72959098b3ef8c122d9635514ced565fe"),
    (b"\xaa" * 131, b"Test Using Larger Than Block-Size Key - Hash Key First", "60e431591ee0b67f0d8a26aacbf5b77f8e0bc6213728c5140546040f0ee37f54"),
]


@pytest.mark.parametrize("key, data, code", VECTORS)
def test_hmac_vectors(spark, key, data, code):
    assert spark.createDataFrame([(data,)], "d binary").select(F.lower(F.hex(T.hmac_sha256(key, F.col("d"))))).first()[0] == code


def test_hmac_and_base64url_of_many_lengths(spark):
    rows = [(bytes(range(i % 256)) * (1 + i // 200),) for i in range(0, 300, 7)]
    df = spark.createDataFrame(rows, "d binary")
    for size in (0, 1, 63, 64, 65, 200):
        key = b"k" * size
        got = df.select("d", T.hmac_sha256(key, F.col("d")).alias("h"), T.base64url(F.col("d")).alias("b"), T.from_base64url(T.base64url(F.col("d"))).alias("back")).collect()
        assert all(bytes(r.h) == hmac.new(key, bytes(r.d), hashlib.sha256).digest() and r.b == b64(bytes(r.d)) and r.back == r.d for r in got)


def test_bad_base64url(spark):
    got = spark.createDataFrame([(x,) for x in ("ab+/", "ab==", "a", "a b", "é", "")], "t string").select(T.from_base64url(F.col("t"))).collect()
    assert [r[0] for r in got] == [None] * 5 + [bytearray()]


def test_sign_is_what_others_sign(spark):
    df = spark.createDataFrame([tuple(USER.values())], "user_id long, username string, administrator boolean")
    token = df.select(T.sign(SECRET, F.col("user_id"), F.col("username"), F.col("administrator"), F.lit(NOW))).first()[0]
    assert token == made({"user": USER, "exp": NOW + 1_209_600})


def test_verify(spark):
    good = {"user": USER, "exp": NOW + 5}
    head, claims, code = made(good).split(".")
    cases = {
        made(good): "valid", made(good | {"exp": NOW}): "valid", made(good | {"exp": NOW - 1}): "expired", made(good | {"exp": NOW - 60}): "expired", made(good | {"exp": NOW - 61}): "invalid",
        made(good, b"other"): "invalid", made(good)[:-1]: "invalid", f"{head}.{claims}": "invalid", f"{head}.{claims}.": "invalid", f"{head}.{claims}.{code}.x": "invalid", f"{head}.{claims}.{code}=": "invalid",
        f"{head}.{b64(json.dumps(good | {'exp': NOW + 9}).encode())}.{code}": "invalid", made(good, header='{"alg":"none"}'): "invalid", made(good, header='{"alg":"HS512"}'): "invalid", made(good, header="x"): "invalid",
        made({"user": USER}): "invalid", made({"exp": NOW + 5}): "invalid", made({"user": {"user_id": 1}, "exp": NOW + 5}): "invalid", made(b"[1"): "invalid", made(b"\xff\xfe"): "invalid", made(good | {"exp": -1}): "invalid",
        "": "invalid", ".": "invalid", "..": "invalid", "a.b.c": "invalid", None: "invalid",
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string").select("t", T.verify(SECRET, F.col("t"), F.lit(NOW)).alias("v"))
    got = {r.t: r.v for r in df.collect()}
    assert {t: v.status for t, v in got.items()} == cases
    assert got[made(good)].claims.asDict(recursive=True) == good
    assert all(v.claims is None for v in got.values() if v.status != "valid")


def test_renew(spark):
    week = 604_800
    tokens = [made({"user": USER, "exp": NOW + left}) for left in (week, week - 1, 0, -5)] + ["x", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in tokens], "t string").coalesce(1).select(T.renew(SECRET, F.col("t"), F.lit(NOW))).collect()]
    new = made({"user": USER, "exp": NOW + 2 * week})
    assert got == [tokens[0], new, new, None, None, None]
