"""The driver's queries for this subpackage's operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import decontaminate
from .exact_dedup import exact_dedup
from .jaccard import jaccard_components
from .langid import identify
from .negatives import hard_negatives
from .packing import best_fit_packing
from .pii import replace_pii
from .prefix_trie import prefix_trie
from .quality import classify
from .sampling import fold
from .simhash import simhash_components
from .suffix_dedup import suffix_dedup
from .suffix_tree import score_texts
from .toxicity import score_toxicity


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir), table(spark, sf_dir, "labels"), "quality", fold(F.col("doc_id"), 5) != 0)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir), fold(F.col("doc_id"), 4) != 2)


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(documents(spark, sf_dir), table(spark, sf_dir, "benchmark")).drop("hit")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(documents(spark, sf_dir), fold(F.col("doc_id"), 10) != 0)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(documents(spark, sf_dir)).drop("kept")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


def op8_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_pii(documents(spark, sf_dir), "surrogate key")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(documents(spark, sf_dir), tokenizer_file())


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(documents(spark, sf_dir), table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 3) != 1)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives(table(spark, sf_dir, "embeddings"), moved, F.col("vec_id") % 100 == 0)


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(documents(spark, sf_dir))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_language_id": op2_language_id,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_decontamination": op4_decontamination,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_pii_surrogates": op8_pii_surrogates,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_toxicity": op10_toxicity,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_simhash": op12_simhash,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLES: dict[str, str] = {
    "op3_jaccard_join": r"""
        WITH RECURSIVE t AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x20\x09-\x0D]+') AS ws
            FROM documents),
        s AS (
            SELECT DISTINCT doc_id, array_to_string(ws[i:i + least(len(ws), 5) - 1], ' ') AS shingle
            FROM t, unnest(range(1, len(ws) - least(len(ws), 5) + 2)) AS u(i) WHERE len(ws) > 0),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s AS x JOIN s AS y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM c JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r AS (SELECT doc_id, doc_id AS start FROM documents UNION SELECT e.b, r.start FROM r JOIN e ON r.doc_id = e.a)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id
        FROM (SELECT doc_id, min(start) AS component_id FROM r GROUP BY 1) LEFT JOIN n USING (doc_id)
    """,
    "op4_decontamination": r"""
        WITH t AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
            FROM documents),
        b AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                               '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
            FROM benchmark),
        bw AS (
            SELECT DISTINCT item_id, least(len(ws), 10) AS l, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS win
            FROM b, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS u(i) WHERE len(ws) > 0),
        dw AS (
            SELECT doc_id, l, i, array_to_string(ws[i:i + l - 1], ' ') AS win
            FROM t, (SELECT DISTINCT l FROM bw) AS s, unnest(range(1, len(ws) - l + 2)) AS u(i)),
        hits AS (SELECT doc_id, i, dw.l, item_id FROM dw JOIN bw USING (win)),
        n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM hits) GROUP BY doc_id),
        m AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
            FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
        SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM t LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
    """,
    "op7_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS n,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS h
            FROM documents),
        w AS (
            SELECT doc_id, h, count(*) OVER (PARTITION BY h) AS group_size,
                   first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS keep_id
            FROM d)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM w
    """,
    "op11_hard_negatives": r"""
        WITH e AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT a.vec_id AS anchor_id, n.vec_id AS other_id, n.label = a.label AS same, list_dot_product(a.v, n.v)::BIGINT AS score
            FROM e AS a JOIN e AS n ON a.vec_id % 100 = 0 AND n.vec_id <> a.vec_id),
        p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
        r AS (
            SELECT p.anchor_id, p.other_id AS positive_id, n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
                   row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY n.score DESC, n.other_id)::INTEGER AS rank
            FROM p JOIN s AS n ON n.anchor_id = p.anchor_id AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score)
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM r WHERE rank <= 10
    """,
    "op13_prefix_trie": r"""
        WITH own AS (
            SELECT conv_id AS c, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS ts
            FROM conversations GROUP BY 1),
        crc AS (
            SELECT c, ts, xor(list_reduce([4294967295] || list_transform(string_split(c::VARCHAR, ''), lambda x: ord(x)::BIGINT),
                                          lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda u, v: xor(u >> 1, 3988292384 * (u & 1)))), 4294967295) % 6 AS h
            FROM own),
        built AS (SELECT o.c, coalesce(b.ts, [])[1:o.h] || o.ts[o.h + 1:] AS p FROM crc AS o LEFT JOIN own AS b ON b.c = o.c - o.c % 100),
        m AS (SELECT c, d, p[1:d] AS k, d = len(p) AS whole FROM built, unnest(range(0, len(p) + 1)) AS u(d)),
        n AS (
            SELECT d, k, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * coalesce(length(k[d].t), 0) AS saved,
                   sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE whole), '')) AS ends_sha256
            FROM m GROUP BY d, k),
        ch AS (SELECT d - 1 AS d, k[1:d - 1] AS k, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1, 2),
        w AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN ch ON ch.d = n.d AND ch.k = n.k),
        s AS (
            SELECT x.d, x.k, count(*) FILTER (WHERE y.n_children = 0) AS n_leaves, sum(y.saved)::BIGINT AS saved_tokens
            FROM w AS x JOIN w AS y ON y.d >= x.d AND y.k[1:x.d] = x.k GROUP BY 1, 2)
        SELECT w.conv_id, w.d AS depth, up.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves, saved_tokens, w.ends_sha256
        FROM w JOIN s ON s.d = w.d AND s.k = w.k LEFT JOIN w AS up ON up.d = w.d - 1 AND up.k = w.k[1:w.d - 1]
    """,
}
