"""The conversation trie against plain rebuilding."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from tesserae.llm import prefix_trie as T

SCHEMA = "conv_id long, turn long, role string, text string, c long, fp string, depth int, s long, at long"


def brute(rows):
    own = {}
    for c, turn, role, text, *_ in rows:
        own.setdefault(-1 if c is None else c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        rebuilt[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members, ends = {}, {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
        ends.setdefault(turns, []).append(c)
    out = []
    for p, cs in members.items():
        below = [q for q in members if q[: len(p)] == p]
        kids = [q for q in below if len(q) == len(p) + 1]
        leaves = sum(not any(r[: len(q)] == q and len(r) > len(q) for r in below) for q in below)
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q)
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(kids), leaves, saved, hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations(seed):
    rng = random.Random(seed)
    openers = [("system", "You are hélpful"), ("user", ""), ("user", "a"), ("assistant", "a"), ("user", "漢字 \n x")]
    rows = []
    for c in [0, *range(1, 60), 100, *range(130, 160), *range(300, 310), -5, -105, 100000]:
        n = rng.choice([1, 2, 3, 5, 6, 7, 9])
        for t in range(n):
            role, text = openers[min(t, 4)] if rng.random() < 0.7 else rng.choice(openers)
            rows.append((c, t, role, text))
    rows += [(7, None, "user", "first"), (7, None, None, None), (8, 2, "user", "tie"), (8, 2, "assistant", "tie"), (8, 2, "user", "tie"), (None, 1, "user", "x"), (None, None, None, "y"), (500, 0, "user", "z" * 100000)]
    rows += [(c, t, "user", f"{c % 3} {t}") for c in (900, 901, 902, 903, 904) for t in range(40)]
    rows += [(1000, t, "user", f"long {t % 7}") for t in range(700)] + [(1001, t, "user", f"long {t % 7}") for t in range(690)]
    rows += [(2000, 0, "user", "p"), (2000, 1, "user", "q"), (2100, 0, "user", "q"), (2100, 1, "user", "p")]
    rng.shuffle(rows)
    return [(*r, 1, "f", 2, 3, 4) for r in rows]


def found(df):
    got = T.prefix_trie(df)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


def test_prefix_trie(spark, monkeypatch):
    rows = conversations(1)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = brute(rows)
    monkeypatch.setattr(T, "BASES", (1, *T.BASES[:1]))  # base 1 can't tell "p q" from "q p": verified, and done again
    monkeypatch.setattr(T, "SEGMENT", 3)
    assert found(df) == want
    assert found(df.limit(0)) == []


def test_no_base_tells_prefixes_apart(spark, monkeypatch):
    monkeypatch.setattr(T, "BASES", (1,))
    df = spark.createDataFrame([(2000, 0, "user", "p"), (2000, 1, "user", "q"), (2100, 0, "user", "q"), (2100, 1, "user", "p")], "conv_id long, turn long, role string, text string")
    with pytest.raises(ValueError):
        T.prefix_trie(df)


def test_long_conversation_over_many_tasks(spark):
    """Sums of one conversation's parts compose over partitions."""
    rows = [(0, t, "user", f"{t % 11}") for t in range(5000)] + [(100, t, "user", f"{t % 11}") for t in range(5000)] + [(200, t, "user", f"{t % 11}") for t in range(3000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = T.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
        deep = {r.depth: r for r in got.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(deep) == 5001
    assert [deep[d].n_convs for d in (0, 1, 3000, 3001, 5000)] == [3, 3, 3, 2, 2]
    assert deep[0].saved_tokens == sum(len(str(t % 11)) * (2 if t < 3000 else 1) for t in range(5000))
    assert deep[5000].ends_sha256 == hashlib.sha256(b"0,100").hexdigest()


def test_arithmetic():
    rng = np.random.default_rng(0)
    a, b = (rng.integers(0, T.PRIME, 500).astype(np.uint64) for _ in range(2))
    assert T.mulmod(a, b).tolist() == [int(x) * int(y) % T.PRIME for x, y in zip(a, b)]
    assert T._sums(a).tolist() == [sum(map(int, a[:i])) % T.PRIME for i in range(501)]
    assert T._powers(T.BASES[0], 100).tolist() == [pow(T.BASES[0], i, T.PRIME) for i in range(100)]
