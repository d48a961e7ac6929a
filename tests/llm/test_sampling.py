"""Bounded samples to fit on, and what the operators that use them make of long texts, null ids and clashing names."""

from __future__ import annotations

import random
import zlib

import pytest
from pyspark.sql import functions as F

from tesserae.llm import sampling
from tesserae.llm.langid import identify
from tesserae.llm.packing import best_fit_packing
from tesserae.llm.quality import classify
from tesserae.llm.queries import tokenizer_file
from tesserae.llm.sampling import MOST_BYTES, PIECES, bounded, excerpt, fold
from tesserae.llm.toxicity import score_toxicity

EN, DE = "the of and to in that with was for it".split(), "der die und nicht mit das ist ein zu von".split()
CLASHES = ("text", "doc_id", "held_out", "score", "predicted", "label", "flags", "_of", "_share", "pattern", "count", "lang_pred", "found")


def speech(rng, words, n):
    return " ".join(rng.choices(words, k=n))


def test_excerpt(spark):
    whole, odd = "é" * (MOST_BYTES // 2), "".join(chr(0x10000 + k % 5000) for k in range(70_000))
    got = [r[0] for r in spark.createDataFrame([(0, whole), (1, whole + "x"), (2, odd), (3, None)], "id int, t string").orderBy("id").select(excerpt(F.col("t"))).collect()]
    size = MOST_BYTES // (4 * PIECES) - 1
    assert got[0] == whole and got[3] is None
    for text, cut in zip((whole + "x", odd), got[1:3]):
        pieces = cut.split(" ")
        assert len(pieces) == PIECES and all(len(x) == size and x in text for x in pieces) and len(cut.encode()) <= MOST_BYTES
        assert text.startswith(pieces[0]) and text.endswith(pieces[-1])


def test_rows_without_id_and_repeated_rows_are_sampled_by_their_text(spark):
    rows = [(None, f"null {i}", "a") for i in range(6000)] + [(i, f"own {i}", "a") for i in range(4000)] + [(7, "hot", "a")] * 5000 + [(i, "b", "b") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7)
    got = bounded(df, "lang", ["doc_id", "text"], 1000).collect()
    kinds = [r for r in got if r.lang == "a"]
    assert 850 < len(kinds) < 1150 and len(set(kinds)) == len(kinds)
    assert 0.5 < sum(r.doc_id is None for r in kinds) / len(kinds) < 0.7
    assert sum(r.lang == "b" for r in got) == 30


def test_a_sample_of_long_texts_has_fewer(spark, monkeypatch):
    monkeypatch.setattr(sampling, "SAMPLE_BYTES", 400_000)
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.repeat(F.lit("x"), 996), F.col("id") + 1000).alias("text"), F.lit(1).alias("label"))
    assert 320 < bounded(df, "label", ["doc_id", "text"], 1500, "text").count() < 480


def test_languages_of_long_texts_only(spark):
    """Labelled texts that are all over MOST_BYTES are learned from."""
    rng = random.Random(1)
    rows = [(i, speech(rng, EN if i % 2 else DE, 25_000), "en" if i % 2 else "de") for i in range(6)]
    rows += [(10, "that was for the", None), (11, "das ist ein und", None)]
    got = {r.doc_id: r.lang_pred for r in identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True)).collect()}
    assert got == {i: "en" if i % 2 else "de" for i in range(6)} | {10: "en", 11: "de"}


@pytest.fixture(scope="module")
def awkward(spark):
    """Toxic and bad texts, some without an id or over MOST_BYTES, with columns of any name."""
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(160):
        text = speech(rng, EN, 20_000 if i % 40 < 2 else 40)
        if i % 2:
            text = " ".join(w + (" idiot scum" if k % 9 == 0 else "%%%") for k, w in enumerate(text.split()))
        rows.append((None if i % 16 > 13 else i, text, "en" if i % 3 else None))
        labels.append((None if i % 16 > 13 else i, 1 - i % 2, i % 2))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    clash = [F.lit("x").alias(name.upper() if name in ("text", "doc_id") else name) for name in CLASHES[2:]]
    return rows, docs.select("*", *clash), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def check_classifier(rows, got, training, positive):
    """One row each, those without an id under -1 and its fold, and the held-out ones told apart."""
    assert sorted(r.doc_id for r in got) == sorted(-1 if i is None else i for i, _, _ in rows)
    assert all(r.held_out == training(zlib.crc32(str(r.doc_id).encode())) for r in got)
    known = [r for r in got if r.held_out and r.doc_id >= 0]
    assert known and sum(r.predicted == positive(r.doc_id) for r in known) / len(known) > 0.95


def test_quality_of_awkward_rows(awkward):
    rows, docs, labels = awkward
    got = classify(docs, labels.withColumn("text", F.lit("y")), "quality", fold(F.col("doc_id"), 5) != 0).collect()
    check_classifier(rows, got, lambda crc: crc % 5 == 0, lambda i: 1 - i % 2)


def test_toxicity_of_awkward_rows(awkward):
    rows, docs, labels = awkward
    got = score_toxicity(docs, labels.withColumn("text", F.lit("y")), fold(F.col("doc_id"), 3) != 1).collect()
    check_classifier(rows, got, lambda crc: crc % 3 == 1, lambda i: i % 2)
    alone = score_toxicity(docs, labels.limit(0), fold(F.col("doc_id"), 3) != 1)
    assert alone.count() == len(rows)


def test_language_of_awkward_rows(awkward):
    rows, docs, _ = awkward
    got = identify(docs, fold(F.col("doc_id"), 4) != 2).collect()
    assert sorted(r.doc_id for r in got) == sorted(-1 if i is None else i for i, _, _ in rows)
    assert {r.lang_pred for r in got} == {"en"}


def test_packing_of_rows_without_id(spark):
    docs = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (None, None), (3, "")], "doc_id long, text string")
    got = best_fit_packing(docs, tokenizer_file()).collect()
    assert sorted(r.doc_id for r in got) == [-1, -1, -1, 3] and len({(r.sequence_id, r.offset) for r in got}) == 4
