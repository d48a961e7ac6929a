from __future__ import annotations

import io
import random
from contextlib import redirect_stdout

import pytest

from tesserae.operators.sums import KeptSums, applied, signed
from tesserae.sources.storage import new_path

SCHEMA = "entity_id long, tracker string, seeders long, leechers long, n string"
KEY = ["entity_id", "tracker"]


def recount(rows):
    out = {}
    for e, _, s, l, _ in rows:
        a, b = out.get(e, (0, 0))
        out[e] = a + (s or 0), b + (l or 0)
    return out


def current(kept):
    got = kept.current().collect()
    assert len({r.entity_id for r in got}) == len(got)
    return {r.entity_id: (r.seeders, r.leechers) for r in got}


def test_batches_of_changes_give_what_a_recount_gives(spark):
    rng = random.Random(1)
    kept, state = KeptSums(spark, new_path(spark, "sums")), {}
    for batch in range(3):
        upserts = {(rng.randrange(12) if batch else i // 3, rng.choice("abc")): (rng.randrange(9), rng.choice([None, 4])) for i in range(40)}
        deletes = {k for k in state if rng.random() < 0.3} | {(99, "none")} if batch else set()
        if batch == 2:
            deletes |= {k for k in state if k[0] == 3}
            upserts = {k: v for k, v in upserts.items() if k[0] != 3}
        stats = spark.createDataFrame([(*k, *v, "x") for k, v in state.items()], SCHEMA)
        up = spark.createDataFrame([(*k, *v, "x") for k, v in upserts.items()], SCHEMA)
        gone = spark.createDataFrame(sorted(deletes), "entity_id long, tracker string")
        kept.add(signed(stats, KEY, up, gone))
        state = {k: v for k, v in state.items() if k not in deletes} | upserts
        after = applied(stats, KEY, up, gone).collect()
        assert sorted(map(tuple, after), key=repr) == sorted(((*k, *v, "x") for k, v in state.items()), key=repr)
        assert current(kept) == recount((*k, *v, "x") for k, v in state.items())
    assert 3 not in current(kept)
    before = current(kept)
    kept.fold()
    assert len(kept.parts.numbers()) == 1 and current(kept) == before
    out = io.StringIO()
    with redirect_stdout(out):
        kept.current().explain()
    assert "Aggregate" not in out.getvalue() and "Exchange" not in out.getvalue()


@pytest.mark.parametrize("what", ["upserts", "deletes", "neither"])
def test_changes_of_one_kind(spark, what):
    stats = spark.createDataFrame([(1, "a", 5, 1, ""), (1, "b", 2, 0, ""), (2, "a", 7, 7, "")], SCHEMA)
    up = spark.createDataFrame([(1, "a", 6, 0, ""), (3, "a", 1, 1, "")], SCHEMA) if what == "upserts" else None
    gone = spark.createDataFrame([(1, "b"), (1, "b"), (2, "a")], "entity_id long, tracker string") if what == "deletes" else None
    want = {"upserts": {(1, 1, -1, 0), (3, 1, 1, 1)}, "deletes": {(1, -2, 0, -1), (2, -7, -7, -1)}, "neither": set()}[what]
    assert {tuple(r) for r in signed(stats, KEY, up, gone).collect()} == want
