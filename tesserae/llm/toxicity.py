"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier.

Voters fire or not on a document: a fixed list of insults and threats, words and
word beginnings that stand out in labelled toxic rows, patterns (second-person
insults, shouting, runs of punctuation), and counts of list entries. The label
model is generative: given the class, a voter's firing depends on one other
voter's, the one it is most correlated with beyond the class, or on none (a
maximum spanning tree of conditional mutual information). Its accuracies and
correlations are estimated by expectation-maximisation over the voters' patterns
on all training documents, counted by Spark; labelled rows weigh as much in
all as the others. The posteriors of a bounded sample of labelled rows (`SAMPLE` a
label, excerpts of texts over `sampling.MOST_BYTES` bytes) then train a logistic classifier over
hashed words and word beginnings, those whose use differs between the posterior
classes beyond chance; it scores every whole text.

Null and empty texts have no words and get the classifier's bias. Only text
enters a score: doc_id picks the fold, lang, source and labels are not read. Labels
other than 0 and 1 are no labels. Equal texts get equal scores, so repeated rows
and ties do; a null doc_id counts as -1; other columns, whatever their names, are
not read; an empty table gives an empty result. Without labelled rows the fixed
voters drive the label model, on a sample of training rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import ASCII_LOWER, ORDER_CODE, U, buffers, prefix_sums, range_hash, slices, words
from .sampling import bounded, excerpt, labelled_sample, row_id
from .storage import write_table

SAMPLE = 2000
#: Mined voters at most: those with the surest difference.
MINED = 150
#: Likelihood-ratio statistic from which a difference or a dependence is beyond chance (one in 100,000).
SURE = 20.0
#: Lengths in bytes of the word beginnings that are units beside the words.
PREFIXES = (3, 4, 5, 6, 7, 8)
BITS = 20
EPOCHS, RATE, DECAY, SEED = 12, 0.5, 1e-5, 11
#: Least number of training steps: small samples get more epochs.
STEPS = 40_000
EM_ROUNDS = 5
#: Added to each count of the label model.
SMOOTHING = 0.5
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
#: Letters and digits, and all bytes of other scripts.
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

#: Common insults and threats.
LEXICON = (
    "idiot stupid moron dumb loser trash garbage pathetic worthless disgusting scum clown fool jerk imbecile "
    "freak ugly vile filthy hate kill die shut hell damn crap bastard pig rat coward liar creep psycho"
).split()
#: Pattern voters.
PATTERNS = {
    "second person": r"(?i)\byou(?:'re| are)? (?:an? |the |such an? )?(?:" + "|".join(LEXICON) + r")\b",
    "shouting": r"\b[A-Z]{4,} [A-Z]{4,} [A-Z]{4,}\b",
    "punctuation": r"[!?]{3,}",
    "masked": r"\b\w\*{2,}\w*\b",
    "wish": r"(?i)\b(?:go|hope you|should) (?:die|hang|burn)\b",
}


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each word and its beginnings, A-Z lowered, and the first of each row."""
    low = ASCII_LOWER[data]
    w = words(low, offsets, WORD_BYTES)
    sums = prefix_sums(low)
    out = np.empty((len(w.start), len(PREFIXES) + 1), np.uint64)
    there = np.empty(out.shape, bool)
    out[:, 0], there[:, 0] = range_hash(sums, w.start, w.end), True
    for k, size in enumerate(PREFIXES, 1):
        there[:, k] = w.end - w.start > size
        out[:, k] = range_hash(sums, w.start, np.where(there[:, k], w.start + size, w.end)) ^ ORDER_CODE[10]
    return out[there], np.concatenate([[0], np.cumsum(there.sum(axis=1))])[w.first]


def bags(texts: pa.Array) -> list[np.ndarray]:
    """The distinct units of each row."""
    out = []
    for s in slices(texts):
        unit, first = units(s.data, s.offsets)
        out += [np.unique(unit[i:j]) for i, j in zip(first, first[1:])]
    return out


def lexicon_units() -> np.ndarray:
    return np.array([units(*buffers(pa.array([w])))[0][0] for w in LEXICON], np.uint64)


def differences(held: list[np.ndarray], weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units, the likelihood-ratio statistic of their use in rows weighted by weight and by 1 - weight, and whether the former have them more often."""
    unit, at = np.unique(np.concatenate(held), return_inverse=True)
    w = np.repeat(weight, [len(x) for x in held])
    toxic, clean = np.bincount(at, weights=w), np.bincount(at, weights=1 - w)
    n, m = max(weight.sum(), 1e-9), max((1 - weight).sum(), 1e-9)

    def likelihood(k: np.ndarray, of: float, p: np.ndarray) -> np.ndarray:
        p = np.clip(p, 1e-12, 1 - 1e-12)
        return k * np.log(p) + (of - k) * np.log1p(-p)

    same = (toxic + clean) / (n + m)
    statistic = 2 * (likelihood(toxic, n, toxic / n) + likelihood(clean, m, clean / m) - likelihood(toxic, n, same) - likelihood(clean, m, same))
    return unit, statistic, toxic / n > clean / m


def mine(held: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Units that stand out in rows labelled toxic, the surest first."""
    known = np.flatnonzero(labels >= 0)
    if len(np.unique(labels[known])) < 2:
        return np.zeros(0, np.uint64)
    unit, statistic, more = differences([held[i] for i in known], labels[known].astype(float))
    able = np.flatnonzero(more & (statistic >= SURE))
    return unit[able[np.argsort(-statistic[able], kind="stable")]][:MINED]


def votes(texts: pa.Array, flags: pa.Array, lexicon: np.ndarray) -> np.ndarray:
    """(documents, voters): 1 where a voter fires. flags: what the pattern voters say of each text."""
    out = np.zeros((len(texts), len(lexicon) + len(PATTERNS) + 2), np.uint8)
    order = np.argsort(lexicon)
    for s in slices(texts):
        unit, first = units(s.data, s.offsets)
        at = np.minimum(np.searchsorted(lexicon[order], unit), len(lexicon) - 1)
        hit = np.flatnonzero(lexicon[order][at] == unit)
        out[s.first + np.searchsorted(first, hit, "right") - 1, order[at[hit]]] = 1
    if len(texts):
        out[:, len(lexicon) : -2] = np.array(flags.to_pylist(), np.uint8)
    hits = out[:, : len(lexicon)].sum(axis=1)
    out[:, -2], out[:, -1] = hits >= 1, hits >= 3
    return out


def _flags(text: Column) -> Column:
    return F.array(*(text.rlike(p) for p in PATTERNS.values()))


class LabelModel:
    """P(votes | class) with a tree of dependences between voters.

    parent: the voter each depends on, -1 for none. counts: of documents by
    class, voter, whether its parent fires and whether it does.
    """

    def __init__(self, parent: np.ndarray, counts: np.ndarray, prior: float) -> None:
        self.parent, self.prior = parent, prior
        smooth = counts + SMOOTHING
        self.log = np.log(smooth / smooth.sum(axis=3, keepdims=True))

    def above(self, vote: np.ndarray) -> np.ndarray:
        """Whether each voter's parent fires."""
        return np.where(self.parent >= 0, vote[:, np.maximum(self.parent, 0)], 0)

    def posterior(self, vote: np.ndarray) -> np.ndarray:
        """Probability of toxic for each row of votes."""
        at = np.arange(vote.shape[1])
        logit = np.log(self.prior / (1 - self.prior)) + (self.log[1, at, self.above(vote), vote] - self.log[0, at, self.above(vote), vote]).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def count_votes(vote: np.ndarray, parent: np.ndarray, q: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Expected counts of documents (class, voter, parent, vote), q being the probability of toxic."""
    x = vote.astype(float)
    u = np.where(parent >= 0, x[:, np.maximum(parent, 0)], 0.0)
    out = np.zeros((2, vote.shape[1], 2, 2))
    for y, w in enumerate((weight * (1 - q), weight * q)):
        both, up, on = w @ (u * x), w @ u, w @ x
        out[y] = np.stack([np.stack([w.sum() - up - on + both, on - both], 1), np.stack([up - both, both], 1)], 1)
    return out


def dependences(vote: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The parent of each voter: a maximum spanning forest of conditional mutual information given the class, where that is beyond chance."""
    n = vote.shape[1]
    x = vote.astype(float)
    information = np.zeros((n, n))
    for w in (q, 1 - q):
        total = w.sum() + 1e-9
        both, one = (x * w[:, None]).T @ x / total, w @ x / total
        for a, p_a in ((1, one), (0, 1 - one)):
            for b, p_b in ((1, one), (0, 1 - one)):
                joint = (both if a and b else one[:, None] - both if a else one[None, :] - both if b else 1 - one[:, None] - one[None, :] + both).clip(1e-12)
                information += total * joint * np.log(joint / np.outer(p_a, p_b).clip(1e-12))
    parent, best, source = np.full(n, -1), np.full(n, -np.inf), np.full(n, -1)
    left = np.ones(n, bool)
    for _ in range(n):
        v = int(np.argmax(np.where(left, best, -np.inf))) if (best[left] > -np.inf).any() else int(np.flatnonzero(left)[0])
        left[v] = False
        if best[v] >= SURE / 2:
            parent[v] = source[v]
        closer = left & (information[v] > best)
        best[closer], source[closer] = information[v][closer], v
    return parent


def fit_label_model(patterns: DataFrame, vote: np.ndarray, labels: np.ndarray, prior: float) -> LabelModel:
    """The label model from all training documents' patterns (pattern, count) and a sample's votes and labels (-1 where unknown)."""
    known = labels >= 0
    guess = np.where(known, labels, vote[:, -2] * 0.7 + 0.05).astype(float)
    parent = dependences(vote, guess)
    sure = count_votes(vote, parent, guess, np.ones(len(vote)))
    model, voters = LabelModel(parent, sure, prior), vote.shape[1]
    total = patterns.agg(F.sum("count")).first()[0] or 1
    for _ in range(EM_ROUNDS):

        def expected(batches: Iterator[pa.RecordBatch], model: LabelModel = model) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((2, voters, 2, 2))
            for batch in batches:
                for i in range(0, batch.num_rows, 1024):
                    raw = np.frombuffer(b"".join(batch["pattern"].slice(i, 1024).to_pylist()), np.uint8).reshape(min(1024, batch.num_rows - i), -1)
                    held = np.unpackbits(raw, axis=1)[:, :voters]
                    sums += count_votes(held, parent, model.posterior(held), batch["count"].slice(i, 1024).to_numpy().astype(float))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(sums.size)), pa.array(sums.ravel())], ["cell", "n"])

        cells = patterns.mapInArrow(expected, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n")).toArrow().sort_by("cell")  # 8 a voter
        others = cells["n"].to_numpy().reshape(sure.shape) if cells.num_rows else 0.0
        model = LabelModel(parent, sure + others * (len(vote) / total), prior)
    return model


def train(held: list[np.ndarray], target: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights by unit bucket and the bias of a logistic model of the posterior labels, by stochastic gradient descent."""
    unit, statistic, _ = differences(held, target)
    chosen = unit[statistic >= SURE]
    rows = [np.unique(x[np.isin(x, chosen)] >> U(64 - BITS)).astype(np.int64) for x in held]
    rng = np.random.default_rng(SEED)
    weight, bias = np.zeros(1 << BITS), float(np.log(target.mean() / (1 - target.mean())))
    seen = np.zeros(1 << BITS)
    for _ in range(max(EPOCHS, STEPS // len(rows))):
        for i in rng.permutation(len(rows)):
            ids = rows[i]
            error = target[i] - 1 / (1 + np.exp(-np.clip(weight[ids].sum() + bias, -30, 30)))
            g = error - DECAY * weight[ids]
            seen[ids] += g * g
            weight[ids] += RATE * g / np.sqrt(seen[ids] + 1)
            bias += 0.01 * error
    return weight.astype(np.float32), bias


def _score(dense: np.ndarray, bias: float, threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    used = np.flatnonzero(dense)
    values = dense[used]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = np.zeros(1 << BITS, np.float32)
        weight[used] = values
        for batch in batches:
            logit = np.full(batch.num_rows, bias)
            for s in slices(batch["text"]):
                unit, first = units(s.data, s.offsets)
                bucket = (unit >> U(64 - BITS)).astype(np.int64)
                able = np.flatnonzero(weight[bucket])
                key = np.unique((np.searchsorted(first, able, "right") - 1 << BITS) | bucket[able])
                logit[s.first : s.last] += np.bincount(key >> BITS, weights=weight[key & ((1 << BITS) - 1)], minlength=s.last - s.first)
            score = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, training: Column, label: str = "toxic", threshold: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs.

    training: which rows' labels may be learned from, over doc_id.
    """
    found, counts = labelled_sample(docs, labels, label, training, sample)
    rate = min(max(counts.get(1, 0) / max(1, sum(counts.values())), 0.01), 0.99) if counts else 0.1
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    if not counts:
        known = text.where(training).select("doc_id", excerpt(F.col("text")).alias("text"), F.lit(-1).alias("label"))
        found = bounded(known, "label", ["doc_id", "text"], sample, "text").select("text", "label")
    got = found.withColumn("flags", _flags(F.col("text"))).toArrow()  # at most 4 * sample rows of MOST_BYTES
    weight, bias = np.zeros(1 << BITS, np.float32), -30.0
    if got.num_rows:
        texts, y = got["text"].combine_chunks(), got["label"].to_numpy()
        held = bags(texts)
        lexicon = np.array(list(dict.fromkeys([*mine(held, y), *lexicon_units()])), np.uint64)
        vote = votes(texts, got["flags"].combine_chunks(), lexicon)
        patterns = text.where(training).select("text", _flags(F.col("text")).alias("flags")).mapInArrow(_patterns(lexicon), "pattern binary, count long")
        patterns = write_table(patterns.groupBy("pattern").agg(F.sum("count").alias("count")), "patterns")
        q = np.clip(fit_label_model(patterns, vote, y, float(np.clip(y.mean(), 0.01, 0.99)) if counts else rate).posterior(vote), 1e-3, 1 - 1e-3)
        weight, bias = train(held, q)
        bias += float(np.log(rate / (1 - rate)) - np.log(q.mean() / (1 - q.mean())))
    rows = docs.select(row_id(), (~training).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(_score(weight, bias, threshold), SCHEMA)


def _patterns(lexicon: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Which voters fire, a bit each, and how many rows of the batch have it so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = np.packbits(votes(batch["text"], batch["flags"], lexicon), axis=1)
            kinds, count = np.unique(packed, axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in kinds], pa.binary()), pa.array(count.astype(np.int64))], ["pattern", "count"])

    return run
