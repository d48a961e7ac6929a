"""Language identification by multilingual mixture inference.

Each language has smoothed likelihoods of byte 3- and 4-grams of words. Within a
document every word comes from one language; expectation-maximisation estimates
the languages' proportions. The set of languages is the one with the highest
penalised likelihood: languages join it in the order of their proportions among
all languages, each at the cost of `PENALTY` times the logarithm of the number of
words, as long as that pays; the proportions are estimated anew for each set. The
prediction is the set's most frequent language, its score that proportion.

Languages are learned from about `PER_LANGUAGE` distinct training documents each,
chosen by a hash, of about `sampling.SAMPLE_BYTES` in all at most; texts over
`sampling.MOST_BYTES` bytes give pieces from all over them. A null text or one without
letters is `und` with score 0 and no languages. Repeated rows get equal results,
an empty table an empty one; ties between languages go by name. A null doc_id
counts as -1; columns other than doc_id, text and lang are not read. Without
training rows everything is `und`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import GRAM_BITS, grams, padded, row_sums, slices, word_spans
from .sampling import bounded, excerpt, row_id

PER_LANGUAGE = 1500
SMOOTHING = 0.5
#: Share of a gram's log-likelihood that counts, as overlapping grams are no independent evidence.
TEMPER = 0.5
ROUNDS = 8
PENALTY = 3.0
SCHEMA = "lang_pred string, score double, languages array<string>, proportions array<double>"


def train(texts: pa.Array, labels: np.ndarray, n_labels: int) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihood tables (bucket, language) of 3- and 4-grams."""
    counts = np.zeros((2, n_labels, 1 << GRAM_BITS))
    for s in slices(texts):
        text, begin = padded(s.data, s.offsets)
        three, four = grams(text)
        label = np.repeat(labels[s.first : s.last], np.diff(begin))[: len(three)]
        for k, g in enumerate((three, four)):
            flat = label[: len(g)] * (1 << GRAM_BITS) + g[: len(label)]
            counts[k] += np.bincount(flat, minlength=n_labels << GRAM_BITS).reshape(n_labels, -1)
    odds = np.log((counts + SMOOTHING) / (counts.sum(axis=2, keepdims=True) + SMOOTHING * (1 << GRAM_BITS)))
    return odds[0].T.astype(np.float32).copy(), odds[1].T.astype(np.float32).copy()


def word_likelihoods(text: np.ndarray, start: np.ndarray, end: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Tempered log-likelihood of each word in each language."""
    three, four = grams(text)
    total = np.zeros((len(three) + 1, tables[0].shape[1]))
    out = np.zeros((len(start), tables[0].shape[1]))
    for size, g, table in ((3, three, tables[0]), (4, four, tables[1])):
        np.cumsum(table[g], axis=0, dtype=np.float64, out=total[1:])
        first = start - 1
        last = np.clip(end + 2 - size, first, len(three))
        out += total[last] - total[first]
    return out * (TEMPER / 2)


def mixture(like: np.ndarray, first: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of the allowed languages in each row and the row's log-likelihood. Every row has words."""
    count = np.diff(first)
    row = np.repeat(np.arange(len(count)), count)
    top = like.max(axis=1)
    weight = np.exp(like - top[:, None])
    share = allowed / allowed.sum(axis=1, keepdims=True)
    alone = allowed.sum(axis=1).max() == 1
    for _ in range(1 if alone else ROUNDS):
        part = weight * share[row]
        total = part.sum(axis=1) + 1e-300
        if not alone:
            share = np.add.reduceat(part / total[:, None], first[:-1], axis=0) / count[:, None]
    return share, row_sums(np.log((weight * share[row]).sum(axis=1) + 1e-300) + top, first)


def infer(like: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Proportions of the chosen language set in each row; 0 outside it."""
    rows, n = len(first) - 1, like.shape[1]
    share, _ = mixture(like, first, np.ones((rows, n)))
    order = np.argsort(-share, axis=1, kind="stable")
    cost = PENALTY * np.log(np.diff(first) + 1.0)
    best, best_score = np.zeros((rows, n)), np.full(rows, -np.inf)
    todo = np.arange(rows)
    for size in range(1, n + 1):
        keep = np.zeros(rows, bool)
        keep[todo] = True
        mine = np.repeat(keep, np.diff(first))
        allowed = np.zeros((len(todo), n))
        np.put_along_axis(allowed, order[todo][:, :size], 1.0, axis=1)
        cut = np.concatenate([[0], np.cumsum(np.diff(first)[todo])])
        got, score = mixture(like[mine], cut, allowed)
        score -= cost[todo] * (size - 1)
        better = score > best_score[todo]
        best[todo[better]], best_score[todo[better]] = got[better], score[better]
        todo = todo[better]
        if not len(todo):
            break
    return best


def language_of(docs: DataFrame, training: Column, per_language: int = PER_LANGUAGE) -> Column:
    """A column over docs: struct of lang_pred, score, languages and proportions (by proportion) of `text`.

    training: which rows may be learned from, where their lang is not null.
    """
    known = docs.where(training & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", excerpt(F.col("text")).alias("text"))
    sample = bounded(known, "lang", ["doc_id", "text"], per_language, "text").select("lang", "text").toArrow()
    names = sorted(set(sample["lang"].to_pylist()))
    number = {x: i for i, x in enumerate(names)}
    tables = train(sample["text"].combine_chunks() if sample.num_rows else pa.array([], pa.string()), np.array([number[x] for x in sample["lang"].to_pylist()], np.int64), len(names)) if names else None
    text = F.coalesce("text", F.lit(""))
    return F.arrow_udf(_predict(tables, names), SCHEMA)(text, text.rlike(r"\p{L}"))


def identify(docs: DataFrame, training: Column, per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score, languages and proportions for every row of docs."""
    return docs.select(row_id(), (~training).alias("held_out"), language_of(docs, training, per_language).alias("found")).select("doc_id", "held_out", "found.*")


def _predict(tables: tuple[np.ndarray, np.ndarray] | None, names: list[str]) -> Callable[[Iterator[tuple[pa.Array, pa.Array]]], Iterator[pa.Array]]:
    label = np.array([*names, "und"], object)
    limit = max(1 << 15, (1 << 20) // max(4, len(names)))

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, has_letters in batches:
            letters, m = has_letters.to_numpy(zero_copy_only=False), len(texts)
            best, score = np.full(m, len(names)), np.zeros(m)
            chosen: list[list[int]] = [[] for _ in range(m)]
            shares: list[list[float]] = [[] for _ in range(m)]
            for s in slices(texts, limit):
                text, begin = padded(s.data, s.offsets)
                if tables is None:
                    continue
                start, end, first = word_spans(text, begin)
                rows = np.flatnonzero(letters[s.first : s.last] & (np.diff(first) > 0))
                if not len(rows):
                    continue
                like = word_likelihoods(text, start, end, tables)
                mine = np.zeros(s.last - s.first, bool)
                mine[rows] = True
                cut = np.concatenate([[0], np.cumsum(np.diff(first)[rows])])
                share = infer(like[np.repeat(mine, np.diff(first))], cut)
                order = np.argsort(-share, axis=1, kind="stable")
                best[s.first + rows] = order[:, 0]
                score[s.first + rows] = np.take_along_axis(share, order[:, :1], axis=1)[:, 0]
                for r, o, p in zip(s.first + rows, order.tolist(), share.tolist()):
                    chosen[r] = [k for k in o if p[k] > 0]
                    shares[r] = [p[k] for k in chosen[r]]
            languages = [[names[k] for k in ks] for ks in chosen]
            yield pa.StructArray.from_arrays([pa.array(label[best], pa.string()), pa.array(np.clip(score, 0.0, 1.0)), pa.array(languages, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))], ["lang_pred", "score", "languages", "proportions"])

    return run
