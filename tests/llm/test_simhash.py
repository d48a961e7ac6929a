"""SimHash near-duplicates against all pairs."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from tesserae.llm import simhash as S


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints):
    """Least name reachable, by all pairs."""
    least = list(range(len(prints)))

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                least[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def texts():
    rng = random.Random(9)
    vocab = ["".join(rng.choices("abcdefgéß漢", k=rng.randrange(1, 14))) for _ in range(80)]
    out = []
    for _ in range(50):
        base = rng.choices(vocab, k=rng.randrange(1, 200))
        out.append(" ".join(base))
        for _ in range(4):
            near = list(base)
            near[rng.randrange(len(near))] = rng.choice(vocab)
            out.append(rng.choice([" ", "\n", "\t \r"]).join(near).upper() if rng.random() < 0.3 else " ".join(near))
    return out + [None, "", " \t\v\f", "A", "a", "a b c", "x" * 3000, "İ ǅ ẞ", " ".join(rng.choices(vocab, k=20000)), "a b c d a b c d a b c d", "dup", "dup"]


def test_xxh64_of_every_length():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 4000, dtype=np.uint8)
    start = rng.integers(0, 3700, 600)
    end = start + np.concatenate([np.arange(200), rng.integers(0, 300, 400)])
    want = [xxhash.xxh64_intdigest(data[a:b].tobytes(), 42) for a, b in zip(start, end)]
    assert S.xxh64(data, start, end).tolist() == want


@pytest.mark.parametrize("nodes", [1 << 15, 3])
def test_simhash(spark, monkeypatch, nodes):
    monkeypatch.setattr(S, "TREE_NODES", nodes)
    monkeypatch.setattr(S, "CHUNK", 64)
    rows = [(i, t, 0, 1, "x") for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp long, tree int, component string")
    got = {r.doc_id: r for r in S.simhash_components(docs).collect()}
    assert len(got) == len(rows)
    prints = [plain(t) for _, t, *_ in rows]
    assert [got[i].fingerprint for i in range(len(rows))] == [f"{p:016x}" for p in prints]
    want = classes(prints)
    assert len(set(want)) < len(set(prints)) - 20
    assert [got[i].component_id for i in range(len(rows))] == want
    assert S.simhash_components(docs.limit(0)).count() == 0


def test_null_and_repeated_ids(spark):
    rows = [(None, "one two three four five"), (None, "quite another text stands here now"), (7, "one two three four five"), (7, "one two three four five"), (9, "lone"), (9, None)]
    got = sorted((r.doc_id, r.component_id) for r in S.simhash_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(-1, -1), (-1, -1), (7, -1), (7, -1), (9, 9), (9, 9)]


@pytest.mark.parametrize("first", [4, 1 << 10])
def test_links_of_crowded_shards(monkeypatch, first):
    """Many fingerprints within the radius of each other: same components as by all pairs, at most one link a fingerprint."""
    monkeypatch.setattr(S, "FIRST_ROUND", first)
    rng = random.Random(2)
    prints = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(60):
            prints.add(centre ^ sum(1 << b for b in {rng.randrange(64) for _ in range(rng.randrange(0, 5))}))
    prints = sorted(prints)
    fp = np.array(prints, np.uint64)
    for parts in (1, 3):
        pairs = [(p, q) for q in range(parts) for p in range(q + 1)]
        part = np.tile(np.arange(len(fp)) % parts, len(pairs))
        tree = np.repeat(np.arange(len(pairs)), len(fp))
        low, high = (np.array(x)[tree] for x in zip(*pairs))
        a, b = S.links_of(tree, np.tile(fp, len(pairs)), part == low, part == high)
        place = {p: i for i, p in enumerate(prints)}
        label, _ = S.spanning(np.arange(len(fp)), np.array([place[int(x)] for x in a]), np.array([place[int(x)] for x in b]))
        assert label.tolist() == classes(prints)
        assert len(a) < len(prints)
    assert not len(S.links_of(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, bool))[0])


def test_search_follows_only_edges_within_the_radius():
    rng = np.random.default_rng(4)
    fp = np.unique(rng.integers(0, 1 << 63, 3000, dtype=np.uint64))
    trees = S.Trees(np.zeros(len(fp), np.int64), fp)
    lone = np.arange(len(fp))
    asked = 0
    real = S.distance

    def counted(a, b):
        nonlocal asked
        asked += len(a)
        return real(a, b)

    S.distance = counted
    try:
        found, node = trees.search(fp, np.full(len(fp), trees.roots[0]), np.full(len(fp), -1), lone)
    finally:
        S.distance = real
    want = {(i, j) for i in range(len(fp)) for j in np.flatnonzero(np.bitwise_count(fp ^ fp[i]) <= 4)}
    assert set(zip(found.tolist(), node.tolist())) == want
    assert asked < 0.8 * len(fp) ** 2
