"""Quality classifier on supervised subword embeddings.

A document's features are its words, pairs of neighbouring words and byte 3- and
4-grams, hashed into one table of learned vectors. Their average goes through a
softmax over the two labels. Table and softmax are trained together by numpy
stochastic gradient descent on at most `PER_LABEL` documents a label (a bounded
sample of the labelled rows, chosen by a hash; of texts over `sampling.MOST_BYTES`
bytes, excerpts); their prior is put back to the
labelled rows' own. To score, each vector is projected on the softmax once, so
a text costs one look-up a feature, over its whole length.

Null and empty texts have no features and get the prior. Without labelled rows
of both kinds every score is the share of label 1 among them, or 0.5. Labels other
than 0 and 1 are no labels. Only text enters a score: doc_id picks the fold, lang,
source and labels are not read. Equal texts get equal scores, so repeated rows and
ties do; a null doc_id counts as -1; other columns, whatever their names, are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import GRAM_BITS, ORDER_CODE, U, grams, mix, padded, prefix_sums, range_hash, slices, word_spans
from .sampling import labelled_sample, row_id

PER_LABEL = 1500
DIM = 8
EPOCHS = 5
BATCH = 16
RATE = 2.0
SEED = 7
FAMILIES = 4
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def features(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each family, the buckets of its features in order and where each row's begin and end. No feature crosses rows.

    A word equal to the one before it gives a pair of its own, whatever the word.
    """
    text, begin = padded(data, offsets, lower=False)
    size = 1 << GRAM_BITS
    start, end, first = word_spans(text, begin)
    word = range_hash(prefix_sums(text), start, end)
    pair = mix(word[:-1] * ORDER_CODE[0] + word[1:] * ORDER_CODE[1]) >> U(64 - GRAM_BITS)
    pair[word[:-1] == word[1:]] = 0
    pair = np.concatenate([pair, np.zeros(min(1, len(word)), np.uint64)])
    last = first[1:][np.diff(first) > 0] - 1
    pair[last] = 1  # no word follows
    three, four = grams(text)
    at, end = begin[:-1], begin[1:]
    out = [(word >> U(64 - GRAM_BITS), first[:-1], first[1:]), (pair, first[:-1], first[1:]), (three, at, np.maximum(at, end - 1)), (four, at, np.maximum(at, end - 2))]
    return [(b.astype(np.int64) + k * size, i, j) for k, (b, i, j) in enumerate(out)]


def _sparse(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows' distinct features (as a run each), their shares of the row, and the runs' bounds."""
    index, share, bound = [], [], [0]
    for s in slices(texts):
        found = features(s.data, s.offsets)
        for r in range(s.last - s.first):
            ids, count = np.unique(np.concatenate([b[i[r] : j[r]] for b, i, j in found]), return_counts=True)
            index.append(ids.astype(np.int32))
            share.append((count / max(1, count.sum())).astype(np.float32))
            bound.append(bound[-1] + len(ids))
    return np.concatenate(index), np.concatenate(share), np.array(bound)


def train(texts: pa.Array, labels: np.ndarray) -> tuple[np.ndarray, float]:
    """Logit of label 1 for each feature bucket, and its bias."""
    rng = np.random.default_rng(SEED)
    index, share, bound = _sparse(texts)
    table = rng.uniform(-1 / DIM, 1 / DIM, (FAMILIES << GRAM_BITS, DIM)).astype(np.float32)
    top, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    hot = np.eye(2, dtype=np.float32)[labels]
    n, step, steps = len(labels), 0, EPOCHS * -(-len(labels) // BATCH)
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for i in range(0, n, BATCH):
            rows = order[i : i + BATCH]
            rows = rows[bound[rows + 1] > bound[rows]]
            if not len(rows):
                continue
            sizes = bound[rows + 1] - bound[rows]
            cut = np.concatenate([[0], np.cumsum(sizes)])
            at = np.repeat(bound[rows] - cut[:-1], sizes) + np.arange(cut[-1])
            ids, w = index[at], share[at]
            mean = np.add.reduceat(table[ids] * w[:, None], cut[:-1], axis=0)
            z = mean @ top + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            error = hot[rows] - p
            rate = RATE * (1 - step / steps)
            step += 1
            back = error @ top.T
            top += rate / len(rows) * mean.T @ error
            bias += rate / len(rows) * error.sum(axis=0)
            np.add.at(table, ids, (rate * w)[:, None] * np.repeat(back, sizes, axis=0))
    return (table @ (top[:, 1] - top[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def _score(weights: np.ndarray | None, bias: float, threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            logit = np.zeros(batch.num_rows)
            for s in slices(batch["text"]) if weights is not None else ():
                total, count = np.zeros(s.last - s.first), np.zeros(s.last - s.first)
                for bucket, first, last in features(s.data, s.offsets):
                    sums = np.zeros(len(bucket) + 1)
                    np.cumsum(weights[bucket], out=sums[1:], dtype=np.float64)
                    total += sums[last] - sums[first]
                    count += last - first
                logit[s.first : s.last] = total / np.maximum(count, 1)
            score = 1 / (1 + np.exp(-np.clip(logit + bias, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def classify(docs: DataFrame, labels: DataFrame, label: str, training: Column, threshold: float = 0.3, per_label: int = PER_LABEL) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs.

    training: which rows' labels may be learned from, over doc_id.
    """
    found, counts = labelled_sample(docs, labels, label, training, per_label)
    sample = found.toArrow()  # at most 4 * per_label rows of MOST_BYTES
    y = sample["label"].to_numpy()
    weights, bias = None, 0.0
    if len(np.unique(y)) == 2:
        weights, bias = train(sample["text"].combine_chunks(), y)
        bias += np.log(counts[1] / counts[0]) - np.log(y.sum() / (len(y) - y.sum()))
    elif counts:
        bias = np.log((counts.get(1, 0) + 1e-9) / (counts.get(0, 0) + 1e-9))
    rows = docs.select(row_id(), (~training).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(_score(weights, float(bias), threshold), SCHEMA)
