"""Signed tokens as column expressions: HMAC-SHA-256, base64url, signing, verifying and renewing.

All of it is built-in functions over columns, in generated code. The secret is a
literal of the plan: both padded keys are made once, where the plan is made.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import RENEW_SECONDS, TOKEN_SECONDS

#: The block size of the hash and its paddings, the header of a token, and seconds that a token may be over and still is known as such.
BLOCK, INNER, OUTER = 64, 0x36, 0x5C
HEADER = '{"typ":"JWT","alg":"HS256"}'
LEEWAY = 60
CLAIMS = "user struct<user_id: bigint, username: string, administrator: boolean>, exp bigint"
VALID, EXPIRED, INVALID = "valid", "expired", "invalid"


def _sha256(c: Column) -> Column:
    return F.unhex(F.sha2(c, 256))


def hmac_sha256(secret: bytes, message: Column) -> Column:
    """The message's authentication code, 32 bytes, under a secret of any length."""
    key = (hashlib.sha256(secret).digest() if len(secret) > BLOCK else secret).ljust(BLOCK, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in key)) for pad in (INNER, OUTER))
    return _sha256(F.concat(outer, _sha256(F.concat(inner, message.cast("binary")))))


def base64url(c: Column) -> Column:
    """Bytes as base64 with - and _, without padding or line ends."""
    return F.translate(F.base64(c), "+/=\r\n", "-_")


def from_base64url(c: Column) -> Column:
    """The bytes; null for anything that isn't base64url without padding."""
    plain = F.translate(c, "-_", "+/")
    filled = F.concat(plain, F.repeat(F.lit("="), F.pmod(-F.length(c), F.lit(4))))
    return F.when(c.rlike(r"\A[A-Za-z0-9_-]*\z") & (F.length(c) % 4 != 1), F.try_to_binary(filled, F.lit("base64")))


def token_text(secret: bytes, claims: Column) -> Column:
    """A token of these claims, a JSON text."""
    head = F.concat(base64url(F.lit(HEADER).cast("binary")), F.lit("."), base64url(claims.cast("binary")))
    return F.concat(head, F.lit("."), base64url(hmac_sha256(secret, head)))


def sign(secret: bytes, user_id: Column, username: Column, administrator: Column, now: Column) -> Column:
    """A user's token, good for two weeks from now (epoch seconds)."""
    user = F.struct(user_id.cast("long").alias("user_id"), username.alias("username"), administrator.alias("administrator"))
    return token_text(secret, F.to_json(F.struct(user.alias("user"), (now + TOKEN_SECONDS).cast("long").alias("exp"))))


def verify(secret: bytes, token: Column, now: Column) -> Column:
    """status and claims of a token: valid, expired, or invalid, which any other is, an unsigned, forged, cut or long expired one too.

    Signatures are compared by digests of the same length, so how much of a forged
    one is right can't show in the time that it takes. Only a valid token has claims.
    """
    part = lambda i: F.get(F.split(token, r"\."), F.lit(i))
    right = hmac_sha256(secret, F.concat(part(0), F.lit("."), part(1)))
    signed = F.sha2(F.concat(right, F.lit(secret)), 256) == F.sha2(F.concat(from_base64url(part(2)), F.lit(secret)), 256)
    kind = F.get_json_object(from_base64url(part(0)).cast("string"), "$.alg")
    claims = F.from_json(from_base64url(part(1)).cast("string"), CLAIMS)
    whole = claims["user"]["user_id"].isNotNull() & claims["user"]["username"].isNotNull() & claims["user"]["administrator"].isNotNull() & (claims["exp"] >= 0)
    good = F.coalesce((F.size(F.split(token, r"\.")) == 3) & signed & (kind == "HS256") & whole & (claims["exp"] >= now - LEEWAY), F.lit(False))
    status = F.when(~good, INVALID).when(claims["exp"] < now, EXPIRED).otherwise(VALID)
    return F.struct(status.alias("status"), F.when(status == VALID, claims).alias("claims"))


def renew(secret: bytes, token: Column, now: Column) -> Column:
    """A valid token as it is, or a new one for the same user if less than a week is left; null for any other."""
    seen = verify(secret, token, now)
    user, left = seen["claims"]["user"], seen["claims"]["exp"] - now
    return F.when(seen["status"] == VALID, F.when(left < RENEW_SECONDS, sign(secret, user["user_id"], user["username"], user["administrator"], now)).otherwise(token))
