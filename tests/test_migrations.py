from __future__ import annotations

import pytest

from tesserae.sources import migrations as M
from tesserae.sources.migrations import Ledger, LedgerError, Step, connect_migrated

FIRST = Step("names", {"tags": "SELECT tag_id, lower(name) AS name FROM {tags}"})
SECOND = Step("split", {"tags": "SELECT tag_id, name, length(name) AS size FROM {tags}", "long_tags": "SELECT tag_id FROM {tags} WHERE length(name) > 3"})
THIRD = Step("drop", {"long_tags": None, "counts": "SELECT count(*) AS n FROM {long_tags}"})


@pytest.fixture
def url(spark, tmp_path):
    spark.createDataFrame([(1, "ABC"), (2, "Drama"), (3, "X")], "tag_id long, name string").write.parquet(f"{tmp_path}/tags.parquet")
    return str(tmp_path)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_three_versions(spark, url):
    assert rows(connect_migrated(spark, url, [FIRST])("tags")) == [(1, "abc"), (2, "drama"), (3, "x")]
    read = connect_migrated(spark, url, [FIRST, SECOND, THIRD])
    assert rows(read("tags")) == [(1, "abc", 3), (2, "drama", 5), (3, "x", 1)] and rows(read("counts")) == [(1,)]
    with pytest.raises(LookupError):
        read("long_tags")
    assert read("users").count() == 0 and "user_id" in read("users").columns
    ledger = Ledger(spark, url)
    assert [(e["number"], e["name"]) for e in ledger.entries()] == [(0, "names"), (1, "split"), (2, "drop")]
    assert ledger.migrate([FIRST, SECOND, THIRD]) == []
    assert rows(spark.read.parquet(f"{url}/tags.parquet"))[0] == (1, "ABC")  # the folder's own table stays


@pytest.mark.parametrize("steps, why", [
    ([Step("names", {"tags": "SELECT tag_id, upper(name) AS name FROM {tags}"}), SECOND], "has changed"), ([FIRST], "now is 'drop'"), ([SECOND, FIRST], "was 'names'"),
    ([FIRST, Step("between", {}), SECOND], "was 'split'"), ([FIRST, Step("names", {})], "one name"),
])
def test_steps_that_contradict_the_ledger_are_refused(spark, url, steps, why):
    ledger = Ledger(spark, url)
    ledger.migrate([FIRST, SECOND])
    before = rows(ledger.reader()("tags"))
    with pytest.raises(LedgerError, match=why):
        ledger.migrate([*steps, THIRD])
    assert rows(ledger.reader()("tags")) == before and len(ledger.entries()) == 2


def test_white_space_does_not_change_a_step(spark, url):
    Ledger(spark, url).migrate([FIRST])
    assert Ledger(spark, url).pending([Step("names", {"tags": "SELECT tag_id,\n  lower(name) AS name\nFROM {tags}"})]) == []


def test_a_step_that_breaks_off_is_done_again(spark, url):
    ledger = Ledger(spark, url)
    ledger.migrate([FIRST])
    broken = Step("split", {**SECOND.queries, "worse": "SELECT raise_error('stop') AS x FROM {tags}"})
    with pytest.raises(Exception, match="stop"):
        ledger.migrate([FIRST, broken, THIRD])
    assert rows(ledger.reader()("tags")) == [(1, "abc"), (2, "drama"), (3, "x")] and len(ledger.entries()) == 1
    assert ledger.migrate([FIRST, SECOND, THIRD]) == ["split", "drop"]
    assert rows(ledger.reader()("counts")) == [(1,)]


def test_an_entry_counts_once_it_is_whole(spark, url, tmp_path):
    ledger = Ledger(spark, url)
    ledger.migrate([FIRST])
    (tmp_path / "_ledger" / "0000" / "_SUCCESS").unlink()
    assert ledger.entries() == []
    assert ledger.migrate([FIRST]) == ["names"]


def test_named_tables():
    assert M._named("SELECT * FROM {a} JOIN {b} USING (x) WHERE '{{c}}' = y") == {"a", "b"}
