"""Column helpers: text, hashes, encodings and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"
#: Seconds that a token is good for, and of its last ones in which it is renewed.
TOKEN_SECONDS, RENEW_SECONDS = 1_209_600, 604_800


def upper_hex(c: Column) -> Column:
    """Bytes as upper-case hex, as piece hashes are stored."""
    return F.hex(c)


def info_hash_text(c: Column) -> Column:
    """A 20-byte hash as it is shown: lower-case hex."""
    return F.lower(F.hex(c))


def is_info_hash(c: Column) -> Column:
    return c.rlike(r"\A[0-9a-fA-F]{40}\z")


def parse_info_hash(c: Column) -> Column:
    """20 bytes of 40 hex digits; null for anything else."""
    return F.when(is_info_hash(c), F.unhex(c))


def parse_hex(c: Column) -> Column:
    """Bytes of an even number of hex digits; null for anything else."""
    return F.when(c.rlike(r"\A(?:[0-9a-fA-F]{2})*+\z"), F.unhex(c))


def sha1_text(c: Column) -> Column:
    return F.sha1(c.cast("binary"))


def info_hash_order(c: Column) -> Column:
    """What hashes in hex are ordered by: their bytes."""
    return F.unhex(c)


def trimmed(c: Column) -> Column:
    """Without any white space at both ends: tabs, newlines and Unicode's too."""
    return F.regexp_replace(c, r"\A\p{IsWhite_Space}++|\p{IsWhite_Space}++\z", "")


def csv_items(c: Column) -> Column:
    """Trimmed items of a comma-separated parameter; null for a blank one. Empty items stay."""
    return F.when(trimmed(c) != "", F.transform(F.split(c, ","), trimmed))


def tag_ids(c: Column) -> Column:
    """A JSON array of ids; none for a missing or empty text, null for anything that is no such array."""
    return F.when(F.coalesce(c, F.lit("")) == "", F.expr("array()").cast("array<bigint>")).otherwise(F.from_json(c, "array<bigint>"))


def bearer_token(header: Column) -> Column:
    """The token of an authorization header: what stands between the first word Bearer and the next, trimmed; null without one."""
    return trimmed(F.get(F.split(header, "Bearer"), F.lit(1)))


def token_expiry(expiry: Column, now: Column) -> Column:
    """When a token, checked now, runs out: two weeks from now if less than one is left, null if it has run out."""
    return F.when((expiry >= now) & (expiry - now < RENEW_SECONDS), now + TOKEN_SECONDS).when(expiry >= now, expiry)


def now_seconds() -> Column:
    """The present as epoch seconds, one value a query."""
    return F.unix_timestamp()


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def like_pattern(search: str | None) -> str | None:
    """Pattern of a substring search; % and _ in it stay wildcards, a backslash is plain."""
    return None if not search else "%" + search.replace("\\", "\\\\") + "%"


def url_encode(c: Column) -> Column:
    """Percent-encoding of all but letters, digits and -._~"""
    out = F.url_encode(c)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def magnet_link(info_hash: Column, title: Column, trackers: Column) -> Column:
    """xt, dn, then one tr for each tracker in order."""
    tail = F.array_join(F.transform(trackers, lambda t: F.concat(F.lit("&tr="), url_encode(t))), "")
    return F.concat(F.lit("magnet:?xt=urn:btih:"), info_hash, F.lit("&dn="), url_encode(title), tail)


def personal_announce_url(tracker: Column, key: Column) -> Column:
    """The tracker's URL with a user's key as its last path segment."""
    return F.concat(F.regexp_replace(tracker, "/+$", ""), F.lit("/"), key)


def path_parts(c: Column) -> Column:
    """Path segments; a missing path is one empty segment."""
    return F.split(F.coalesce(c, F.lit("")), "/")


def path_text(parts: Column) -> Column:
    return F.array_join(parts, "/")


def is_name(c: Column) -> Column:
    """Not blank."""
    return trimmed(c) != ""


def is_title(c: Column) -> Column:
    """At least three bytes."""
    return F.octet_length(c) >= 3


def is_username(c: Column) -> Column:
    """1 to 20 of A-Z a-z 0-9 - _"""
    return c.rlike(r"\A[A-Za-z0-9_-]{1,20}\z")


def is_email(c: Column) -> Column:
    """A common form of address whose domain has a dot and at least four characters."""
    domain = F.substring_index(c, "@", -1)
    return c.rlike(r"\A[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*+\z") & domain.contains(".") & (F.length(domain) >= 4)


def is_password(c: Column, confirm: Column, least: int = 6, most: int = 64) -> Column:
    return (c == confirm) & F.octet_length(c).between(least, most)


def timestamp_text(c: Column) -> Column:
    return F.date_format(c, TIMESTAMP_FORMAT)


def epoch_text(c: Column) -> Column:
    """Epoch seconds as text in UTC, whatever the session's zone; a year past 9999 has all its digits and no sign."""
    epoch = F.make_timestamp_ntz(F.lit(1970), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    second = F.pmod(c, F.lit(86_400))
    # The days apart, as an interval takes no more than 12 digits of seconds.
    day = ((c - second) / 86_400).cast("int")
    # Formatting would take the session's zone, which has no 02:30 on some days.
    return F.ltrim((epoch + F.make_dt_interval(day, F.lit(0), F.lit(0), second)).cast("string"), F.lit("+"))


def seconds_before(now: Column, seconds: int) -> Column:
    return now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds))


def saturating_add(c: Column, seconds: int) -> Column:
    most = F.lit((1 << 63) - 1)
    return F.coalesce(F.try_add(c, F.lit(seconds)), F.when(c.isNotNull(), most))


def front(value: Column, values: Column) -> Column:
    """values with one value at the front and nowhere else."""
    return F.concat(F.array(value), F.array_remove(values, value))


def front_tier(value: Column, tiers: Column) -> Column:
    """Tiers with value as a tier of its own ahead; other mentions go, and tiers emptied by that."""
    rest = F.filter(F.transform(tiers, lambda t: F.array_remove(t, value)), lambda t: F.size(t) > 0)
    return F.concat(F.array(F.array(value)), rest)
