"""The pipeline's stages against brute force on a small fixture."""

from __future__ import annotations

import corpus_pipeline
from test_operators import brute_components, brute_hits, strip

from tesserae.llm.langid import identify
from tesserae.llm.storage import write_table


def test_stages(spark, tmp_path):
    from pyspark.sql import functions as F
    from test_operators import corpus

    rows = [(i, t) for i, t in corpus(seed=9, n=40)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    items = [(1, rows[3][1] + " tail words so that the item has more than ten of them"), (2, "zz top")]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, seen = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns
        now = spark.createDataFrame(now.collect(), docs.schema)
        seen.append({r.doc_id for r in now.collect()})
    kept = dict(rows)
    und = {r.doc_id for r in identify(docs, F.lit(True)).where("lang_pred = 'und'").collect()}
    kept = {i: t for i, t in kept.items() if i not in und}
    assert und and set(kept) == seen[0]
    best = {}
    for i, t in kept.items():
        best[strip(t)] = min(best.get(strip(t), (0, 1 << 60)), (-len(t), i))
    kept = {i: kept[i] for _, i in best.values()}
    assert set(kept) == seen[1]
    groups = brute_components(list(kept.items()))
    kept = {i: t for i, t in kept.items() if groups[i][1] == i}
    assert set(kept) == seen[2]
    hits = brute_hits(list(kept.items()), items)
    kept = {i: t for i, t in kept.items() if not hits[i][4]}
    assert set(kept) == seen[3] and len(kept) < len(groups)
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(kept)


def test_null_ids_and_repeated_rows(spark, tmp_path):
    import random

    from test_operators import prose

    rng = random.Random(5)
    a, b, c, d, e, f = (prose(rng, 60) for _ in range(6))
    near, leak = d + " zz", prose(rng, 30)
    rows = [(None, a), (None, b), (None, None), (7, c), (7, c), (7, e), (8, d), (None, near), (9, f), (None, leak + " " + f[:40]), (None, " " + f), (3, leak)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t, "en", None, None) for i, t in rows], schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = write_table(stage(spark, now, str(tmp_path)), name)
        seen.append(sorted(((-1 if r.doc_id is None else r.doc_id), r.text) for r in now.collect()))
    want = sorted((-1 if i is None else i, t) for i, t in rows if t)
    assert seen[0] == want
    want.remove((7, c))
    want.remove((9, f))
    assert seen[1] == want
    want.remove((8, d))
    assert seen[2] == want
    assert seen[3] == [(i, t) for i, t in want if leak not in t]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen[3])


def test_long_labelled_texts_free_names_and_several_runs(spark, tmp_path):
    import random

    from test_operators import prose

    rng = random.Random(8)
    texts = [prose(rng, 24000) for _ in range(3)] + ["123 456"]
    assert min(len(t.encode()) for t in texts[:3]) > 1 << 16
    rows = [(i, t, "en", 100 + i, i) for i, t in enumerate(texts)] + [(9, texts[0], "en", 109, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, _row_key long, _ROW_KEY_ long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, prose(rng, 30))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = write_table(stage(spark, now, str(tmp_path)), name)
        assert now.columns == docs.columns
        ids = [0, 1, 2, 9] if name == "language_id" else [0, 1, 2]  # no text is dropped for its length
        assert {r.doc_id: (r["_row_key"], r["_ROW_KEY_"]) for r in now.collect()} == {i: (100 + i, i) for i in ids}
    one, two = (corpus_pipeline.run(spark, str(tmp_path)) for _ in range(2))
    assert sorted(map(tuple, one.select("doc_id", "piece", "length").collect())) == sorted(map(tuple, two.select("doc_id", "piece", "length").collect()))
    assert one.count() > 3


def test_entry_adds_the_subpackage():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
    assert set(__spark_entry__.oracle_sql()) <= set(names)
