"""Hard negatives against a plain loop over all pairs."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.llm import negatives as N

SCHEMA = "vec_id long, embedding array<float>, label int, key long, rank int, v string"


def row(vec_id, vector, label):
    return (vec_id, vector, label, 7, 1, "x")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    centre = [[rng.gauss(0, 0.2) for _ in range(6)] for _ in range(4)]
    out = []
    for i in range(300):
        label = rng.randrange(4)
        out.append(row(i, [float(np.float32(c + rng.gauss(0, 0.05))) for c in centre[label]], label))
    same = [0.25, -0.5, 0.125, 0.0, 0.5, -0.125]
    out += [row(300 + i, same, i % 3) for i in range(60)]  # ties everywhere
    out += [row(400, None, 1), row(401, same, None), row(402, [0.5, None, 0.1], 1), row(403, [math.nan] * 6, 1), row(404, [math.inf] * 6, 1), row(500, [], 1), row(600, [0.0] * 6, 2)]
    out += [row(None, same, 2), row(None, same, 1), row(20, same, 0), row(20, same, 1), row(700, [-0.5, 0.25], 3), row(801, [1e30] * 6, 3), row(-40, same, 2)]
    return out


def brute(rows, anchors_every=20, positives=5, negatives=10):
    held = []
    for i, v, label, *_ in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        v = [max(-N.CLAMP, min(N.CLAMP, math.floor(max(-1e18, min(1e18, 256 * float(np.float32(x))))))) for x in v]
        held.append((-1 if i is None else i, label, v))
    out = []
    for a, (aid, alabel, av) in enumerate(held):
        if aid % anchors_every:
            continue
        scored = [(-sum(x * y for x, y in zip(av, v)), i, label) for b, (i, label, v) in enumerate(held) if b != a]
        for s, pid, _ in sorted(x for x in scored if x[2] == alabel)[:positives]:
            ps = -s
            found = sorted((s, i) for s, i, label in scored if label != alabel and 30 * ps <= -100 * s <= 90 * ps)[:negatives]
            out += [(aid, pid, k + 1, i, ps, -s) for k, (s, i) in enumerate(found)]
    return sorted(out)


def mined(df, **more):
    got = N.hard_negatives(df, F.col("label"), F.col("vec_id") % 20 == 0, **more)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("block, anchors", [(4096, 512), (37, 5)])
def test_hard_negatives(spark, rows, monkeypatch, block, anchors):
    monkeypatch.setattr(N, "BLOCK_ROWS", block)
    monkeypatch.setattr(N, "BLOCK_ANCHORS", anchors)
    want = brute(rows)
    assert len(want) > 500
    assert mined(spark.createDataFrame(rows, SCHEMA)) == want


def test_empty_tables_and_tables_without_anchors(spark):
    assert mined(spark.createDataFrame([], SCHEMA)) == []
    assert mined(spark.createDataFrame([row(1, [1.0], 1), row(2, [1.0], 2)], SCHEMA)) == []
    assert mined(spark.createDataFrame([row(20, [1.0], 1)], SCHEMA)) == []


def test_search_stops_once_the_threshold_is_below_the_last_hit():
    rng = np.random.default_rng(0)
    values = rng.integers(-9, 9, (2000, 3))
    values[:40] += 300  # far ahead of the rest
    lists = N.Lists(values, 400)
    scored = []

    class Seen(np.ndarray):
        def __getitem__(self, rows):
            scored.append(len(rows))
            return np.asarray(self)[rows]

    lists.values = lists.values.view(Seen)
    low, high = np.array([-(10**9), 2000]), np.array([10**9, 10**9])
    found = lists.best(np.array([1, 2, 1]), np.ones(2000, bool), low, high, 5)
    score = values @ np.array([1, 2, 1])
    want = sorted(range(2000), key=lambda i: (-score[i], i))[:5]
    assert found[0][0].tolist() == want and found[0][1].tolist() == score[want].tolist()
    assert len(found[1][0]) == 0
    assert sum(scored) < 400  # of 2000: the rest never met


@pytest.mark.parametrize("scale", [1, 1 << 12, 1 << 22])
def test_threshold_search_against_sorting(scale):
    rng = np.random.default_rng(scale)
    for trial in range(20):
        m, width = int(rng.integers(1, 200)), int(rng.integers(1, 9))
        values = rng.integers(-3, 4, (m, width)) * scale
        anchor = rng.integers(-2, 3, width) * scale
        allowed = rng.random(m) < 0.7
        score = values @ anchor
        low, high = np.array([-(1 << 60), 0, int(score.max()) // 2]), np.array([1 << 60, int(score.max()), int(score.max())])
        lists = N.Lists(values, int(np.abs(anchor).max(initial=0)))
        for (rows, of), a, b in zip(lists.best(anchor, allowed, low, high, 4), low, high):
            want = sorted((i for i in range(m) if allowed[i] and a <= score[i] <= b), key=lambda i: (-score[i], i))[:4]
            assert rows.tolist() == want and of.tolist() == score[want].tolist()
