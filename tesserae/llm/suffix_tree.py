"""Language-model scores from a probabilistic suffix tree over words.

Tokens are words with A-Z lowered, then an end token; before a text stands a
start symbol. A token is predicted from the longest suffix of what comes before
it that is a state of the tree; states are contexts of up to `DEPTH` words. A
context becomes a state if its next-token distribution differs enough from that
of the context one word shorter: their Kullback-Leibler divergence, weighted by
the context's count, must reach `DIVERGENCE` bits. A state's distribution is
smoothed with its parent's; tokens it has not seen share what that leaves in
proportion to the parent's. The root has every training token's share of all of
them, less the share of tokens seen once, which goes to the one unknown token
(Good-Turing). The score is the log10 probability of all tokens of the text.

Counts are exact sums over all training rows, and what is gathered grows with
them, in two tiers:

- Frequent contexts, with at least a share `RARE` of all training tokens, go to
  every task: at most 1 / RARE entries a depth, grown a word at a time. Of their
  next words, those below that share count as unseen there; contexts of fewer
  than DEPTH words below it are no states.
- All other contexts of DEPTH words that come twice or more in training stay
  spread over hash buckets: slices of documents send each occurrence to its
  context's bucket, which has the context's whole distribution, tests and smooths
  it, and sends back what the state changes for each document. As these contexts
  are rare, no bucket is hot. A bitmap of at most 2**MOST_FILTER_BITS bits keeps
  most contexts that come once from being sent at all; it changes no result.

Every word that training has twice or more is told apart, as a next word and in
contexts; one that comes once is the unknown word there, and has its count at the
root. Words too are held in two tiers, which change no result:

- The vocabulary goes to every task: the up to `VOCABULARY` most frequent words,
  and all that can be in a frequent context.
- An exchange before that of the contexts brings each slice the counts of its
  other words. Contexts that have such words, and such words after any context,
  are sent by 64-bit hashes with the probability that the parent gives.

Null texts count as empty: the end token alone. Repeated rows are scored and
counted as often as they come, equal texts get equal scores, a null doc_id counts
as -1. Columns other than text and those that `training` reads are not read. An
empty table gives an empty result. Without training rows N = V = 0, every token
is unknown and certain.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import ASCII_LOWER, ORDER_CODE, U, Slice, mix, prefix_sums, range_hash, row_sums, slices, words
from .sampling import row_id
from .shared import bucket_bits, text_bytes
from .storage import write_table

DEPTH = 2
DIVERGENCE = 20.0
#: Least share of the training tokens of an n-gram that goes to every task, and its least count; fewer than 2**SYMBOL_BITS can have it.
RARE = 1e-6
LEAST = 4
VOCABULARY = 1_000_000
#: Bits of the filter for each context in it, and log2 of the bits it has at most.
FILTER_BITS = 16
MOST_FILTER_BITS = 29
#: What a state changes travels back in steps of this.
STEP = 1 / 1024
#: Counts of the parent's distribution that smooth a state's.
PRIOR = 4.0
SYMBOL_BITS = 21
SLICE_BYTES = 2 << 20
SLICE_TOKENS = 1 << 19
SLICE_ROWS = 60_000
#: Bytes of text for each bucket, at most this many in all, that a task gathers before it sends.
SENT_BYTES, MOST_SENT = 1 << 16, 24 << 20
GRAMS_AT_ONCE = 3_000_000
END_HASH, START_HASH = ORDER_CODE[60], ORDER_CODE[61]
ALPHA = 0.1

WORDS_SCHEMA = "grp long, slice long, head binary, symbols binary, words binary, counts binary"
DEALT_SCHEMA = "grp long, slice long, head binary, contexts binary, wide binary"
BACK_SCHEMA = "slice long, head binary, contexts binary"
SCORE_SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, logs double, score double"
#: A row of a slice: id, fold, number of tokens.
ROW = np.dtype([("doc_id", "<i8"), ("held_out", "?"), ("size", "<i8")])
#: What a task knows of a row: id, fold, tokens, known ones, base and model logarithms so far.
HEAD = np.dtype([("doc_id", "<i8"), ("held_out", "?"), ("n_tokens", "<i8"), ("n_known", "<i8"), ("logs", "<f8"), ("score", "<f8")])
#: An occurrence of a rare context with a word outside the vocabulary in it or after it: the parent's log10 probability of the next word, 0 being an unknown one.
WIDE = np.dtype([("context", "<u8"), ("next", "<u8"), ("parent", "<f4"), ("row", "<u2"), ("training", "?")])
CONTEXT_ADDS = np.dtype([("row", "<u2"), ("steps", "<i2")])
#: Set in hashes, never in symbols and contexts of symbols.
HASHED = U(1 << 63)
SPREAD = 0x9E3779B97F4A7C15


def spread(code: np.ndarray, width: int) -> np.ndarray:
    """Codes of `width` bits one to one, so that their top bits are even."""
    return (code * U(SPREAD)) & U((1 << width) - 1)


def gathered(code: np.ndarray, width: int) -> np.ndarray:
    """The codes back from what spread() gave."""
    return (code * U(pow(SPREAD, -1, 1 << width))) & U((1 << width) - 1)


def squeeze(values: np.ndarray) -> bytes:
    """Numbers, byte by byte of all of them: high bytes that are mostly 0 compress well."""
    size = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return bytes([size]) + values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T.tobytes()


def expand(raw: bytes) -> np.ndarray:
    """What squeeze() had."""
    size = raw[0]
    planes = np.frombuffer(raw, np.uint8, offset=1).reshape(size, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :size] = planes.T
    return out.view("<u8").ravel()


def pack(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpack(raw: bytes) -> bytes:
    return pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), "zstd", asbytes=True)


def squeeze_sorted(values: np.ndarray) -> bytes:
    return squeeze(np.diff(values, prepend=U(0)))


def expand_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(expand(raw), dtype=np.uint64)


def by_bucket(key: np.ndarray, width: int, bits: int) -> tuple[np.ndarray, list[slice], np.ndarray]:
    """Buckets of sorted keys of `width` bits, the run of each, and what the keys have below the bucket."""
    bucket = (key >> U(width - bits)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(key) else np.zeros(0, np.int64)
    return bucket[first], [slice(i, j) for i, j in zip(first, np.append(first[1:], len(key)))], key & U((1 << width - bits) - 1)


def tokens(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's words and its end token, and where each row's begin."""
    low = ASCII_LOWER[s.data]
    w = words(low, s.offsets)
    first = w.first + np.arange(len(w.first))
    out = np.full(first[-1], END_HASH, np.uint64)
    out[np.arange(len(w.start)) + w.row] = range_hash(prefix_sums(low), w.start, w.end)
    return out, first


class Table:
    """A fixed map from 64-bit keys to numbers for vectorised look-up.

    Keys that meet in a place of one level go to the next, smaller one; an empty
    place tells at once that a key is not there. It travels as keys and values
    alone, and is built where it is used.
    """

    def __init__(self, keys: np.ndarray, values: np.ndarray | None = None) -> None:
        """values: by default the places of the keys, from 1."""
        self.sent = (keys, None if values is None else values.astype(np.float32))
        self._build(*self.sent)

    def __getstate__(self) -> tuple[np.ndarray, np.ndarray | None]:
        return self.sent

    def __setstate__(self, sent: tuple[np.ndarray, np.ndarray | None]) -> None:
        self._build(*sent)

    def _build(self, keys: np.ndarray, values: np.ndarray | None) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        values = np.arange(1, len(keys) + 1) if values is None else values
        while len(keys):
            bits = max(4, int(np.ceil(np.log2(4 * len(keys)))))
            place = self._place(keys, bits, len(self.levels))
            first = np.unique(place, return_index=True)[1]
            held, number = np.full(1 << bits, ~U(0)), np.zeros(1 << bits, np.float32)
            held[place[first]], number[place[first]] = keys[first], values[first]
            self.levels.append((held, number, bits))
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, values = keys[rest], values[rest]

    @staticmethod
    def _place(keys: np.ndarray, bits: int, level: int) -> np.ndarray:
        return (((keys + U(level)) * (ORDER_CODE[level % 60])) >> U(64 - bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is there, and its number."""
        found, number = np.zeros(len(keys), bool), np.zeros(len(keys), np.float32)
        left = None
        for level, (held, values, bits) in enumerate(self.levels):
            mine = keys if left is None else keys[left]
            place = self._place(mine, bits, level)
            there = held[place]
            hit = there == mine
            if left is None:
                found, number = hit, np.where(hit, values[place], np.float32(0))
                left = np.flatnonzero(~hit & (there != ~U(0)))
            else:
                found[left[hit]], number[left[hit]] = True, values[place[hit]]
                left = left[~hit & (there != ~U(0))]
            if not len(left):
                break
        return found, number


class Tree:
    """Symbols of frequent words, log10 probabilities of next words at each state, and log10 weights of passing to the parent.

    A code is a context and a next word, SYMBOL_BITS for each, the last lowest.
    """

    def __init__(self, frequent: np.ndarray, count: np.ndarray, total: int, once: int, distinct: int) -> None:
        self.total, self.distinct = total, distinct
        self.unknown = min(0.5, max(once, 1) / (total + 1)) if total else 1.0
        order = np.argsort(frequent)
        self.count = np.concatenate([[0], count[order]])
        self.share = (1 - self.unknown) * self.count / max(1, total)
        self.symbols = Table(frequent[order])
        self.next: list[Table] = []
        self.back: list[Table] = []
        self.grams: list[tuple[np.ndarray, np.ndarray]] = []
        #: A bit for the hash of each rare context that comes twice or more; bits[k] holds eight.
        self.filter, self.filter_bits = np.zeros(1, np.uint8), 3

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("share", "grams", "by_rank", "rank", "word")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.share = (1 - self.unknown) * self.count / max(1, self.total)

    @cached_property
    def by_rank(self) -> np.ndarray:
        """Symbols by falling count, after 0."""
        return np.concatenate([[0], 1 + np.argsort(-self.count[1:], kind="stable")]).astype(np.uint32)

    @cached_property
    def rank(self) -> np.ndarray:
        """The place of each symbol there: small numbers compress well."""
        out = np.empty(len(self.count), np.uint32)
        out[self.by_rank] = np.arange(len(out))
        return out

    @cached_property
    def word(self) -> np.ndarray:
        """Hashes of words by symbol."""
        out = np.zeros(len(self.count), np.uint64)
        for held, number, _ in self.symbols.levels:
            there = number > 0
            out[number[there].astype(np.int64)] = held[there]
        return out

    def symbol(self, token: np.ndarray) -> np.ndarray:
        """Symbols of tokens, 0 for those that are not frequent."""
        return self.symbols.get(token)[1].astype(np.uint64)

    def codes(self, symbol: np.ndarray, first: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Codes with `depth` words of context where all their words are frequent, and which positions those are.

        The start symbol is the context of a row's first token, and of no more than that.
        """
        start = self.symbol(np.array([START_HASH], np.uint64))[0]
        code, ok = symbol.copy(), symbol > 0
        place = np.arange(len(symbol)) - np.repeat(first[:-1], np.diff(first))
        for k in range(1, depth + 1):
            before = np.zeros(len(symbol), np.uint64)
            before[k:] = symbol[:-k] if k <= len(symbol) else 0
            before[place == k - 1] = start
            before[place < k - 1] = 0
            ok &= before > 0
            code |= before << U(SYMBOL_BITS * k)
        return code, ok

    def candidates(self, symbol: np.ndarray, first: np.ndarray, depth: int) -> np.ndarray:
        """Codes of this depth whose context and whose shorter code are both in the tree."""
        code, ok = self.codes(symbol, first, depth)
        code = code[ok]
        if depth == 1:
            return code
        hit = self.held.get(code >> U(SYMBOL_BITS))[0] & self.held.get(code & U((1 << SYMBOL_BITS * depth) - 1))[0]
        return code[hit]

    def grow(self, gram: np.ndarray, count: np.ndarray, keep: bool = True) -> None:
        """Add a depth: test each context's divergence from its parent and smooth those that stay. keep: its codes are contexts of a next depth."""
        depth = len(self.next) + 1
        order = np.argsort(gram)
        gram, count = gram[order], count[order].astype(float)
        if keep:
            self.held = Table(gram, np.zeros(len(gram)))
        self.grams.append((gram, count))
        if not len(gram):
            self.next.append(Table(gram, count))
            self.back.append(Table(gram, count))
            return
        parent = 10 ** self.logs(gram & U((1 << SYMBOL_BITS * depth) - 1), depth - 1)
        context, at = np.unique(gram >> U(SYMBOL_BITS), return_inverse=True)
        seen = self.context_counts(context, depth)
        size = len(context)
        total = np.maximum(seen, np.bincount(at, weights=count, minlength=size))
        rest = np.maximum(total - np.bincount(at, weights=count, minlength=size), 0)
        left = np.maximum(1 - np.bincount(at, weights=parent, minlength=size), 1e-9)
        gain = np.bincount(at, weights=count * np.log2(count / total[at] / parent), minlength=size)
        gain += np.where(rest > 0, rest * np.log2(np.maximum(rest, 1e-9) / total / left), 0)
        state = gain >= DIVERGENCE
        ok = state[at]
        p = (count + PRIOR * parent) / (total[at] + PRIOR)
        weight = np.maximum(1 - np.bincount(at, weights=p, minlength=size), 1e-12) / left
        self.next.append(Table(gram[ok], np.log10(p[ok])))
        self.back.append(Table(context[state], np.log10(weight[state])))

    def context_counts(self, context: np.ndarray, depth: int) -> np.ndarray:
        """How often each context comes; the start symbol comes once a row, as the end does."""
        if depth == 1:
            start, end = self.symbol(np.array([START_HASH, END_HASH], np.uint64)).astype(np.int64)
            return np.where(context == start, self.count[end], self.count[context.astype(np.int64)]).astype(float)
        gram, count = self.grams[depth - 2]
        at = np.minimum(np.searchsorted(gram, context), max(0, len(gram) - 1))
        return np.where(gram[at] == context, count[at], 0.0) if len(gram) else np.zeros(len(context))

    def logs(self, code: np.ndarray, depth: int, root: np.ndarray | None = None) -> np.ndarray:
        """log10 probability of each code's last word after its context of up to `depth` words. root: the root's, where last words may be outside the vocabulary."""
        out, left = np.zeros(len(code)), np.arange(len(code))
        for d in range(depth, 0, -1):
            key = code[left] & U((1 << SYMBOL_BITS * (d + 1)) - 1)
            hit, value = self.next[d - 1].get(key)
            out[left[hit]] += value[hit]
            left, key = left[~hit], key[~hit]
            out[left] += self.back[d - 1].get(key >> U(SYMBOL_BITS))[1]
        if root is not None:
            out[left] += root[left]
            return out
        out[left] += np.log10(np.maximum(self.share[(code[left] & U((1 << SYMBOL_BITS) - 1)).astype(np.int64)], 1e-300))
        return out

    def contexts(self, symbol: np.ndarray, first: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Codes with `depth` words of context, and where all of those are of the vocabulary, whatever the next word is."""
        code, _ = self.codes(symbol, first, depth)
        whole = np.ones(len(code), bool)
        for k in range(1, depth + 1):
            whole &= (code >> U(SYMBOL_BITS * k)) & U((1 << SYMBOL_BITS) - 1) > 0
        return code, whole

    def score(self, token: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each token, the log10 probability or weight from its frequent states, and whether the root's comes on top."""
        return self.score_symbols(self.symbol(token), first)

    def score_symbols(self, symbol: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for tokens by symbol."""
        out, root = np.zeros(len(symbol)), np.ones(len(symbol), bool)
        for d in range(len(self.next), 0, -1):
            code, whole = self.contexts(symbol, first, d)
            left = np.flatnonzero(root & whole)
            hit, value = self.next[d - 1].get(code[left])
            hit &= symbol[left] > 0
            out[left[hit]] += value[hit]
            root[left[hit]] = False
            left = left[~hit]
            out[left] += self.back[d - 1].get(code[left] >> U(SYMBOL_BITS))[1]
        return out, root

    def rare(self, symbol: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions whose context of DEPTH words may be a rare state, and their codes."""
        code, whole = self.contexts(symbol, first, DEPTH)
        at = np.flatnonzero(whole)
        context = code[at] >> U(SYMBOL_BITS)
        place = mix(context) >> U(64 - self.filter_bits)
        able = (self.filter[(place >> U(3)).astype(np.int64)] >> (place & U(7)).astype(np.uint8)) & 1 > 0
        at, context = at[able], context[able]
        at = at[~self.held.get(context)[0]]
        return at, code[at]

    def root(self, count: np.ndarray) -> np.ndarray:
        """log10 probabilities at the root by training count, 0 being unknown."""
        return np.log10(np.where(count > 0, (1 - self.unknown) * count / max(1, self.total), self.unknown))


def _counter(codes_of: Callable[[np.ndarray, np.ndarray], np.ndarray], width: int, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Distinct codes of a task's texts with their counts, a few million at once, in a row a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def give(least: int) -> Iterator[pa.RecordBatch]:
            code, at = np.unique(np.concatenate([g for g, _ in held]), return_inverse=True)
            held[:] = [(code, np.bincount(at, weights=np.concatenate([c for _, c in held])).astype(np.int64))]
            if len(code) > least:
                code, count = held.pop()
                bucket, runs, rest = by_bucket(code, width, bits)
                for i in range(0, len(runs), 4096):
                    rows = [(squeeze_sorted(rest[r]), squeeze(count[r].astype(np.uint64))) for r in runs[i : i + 4096]]
                    yield pa.RecordBatch.from_arrays([pa.array(bucket[i : i + 4096].astype(np.int32)), *(pa.array(x, pa.binary()) for x in zip(*rows))], ["bucket", "codes", "counts"])

        for batch in batches:
            for i in range(0, batch.num_rows, SLICE_ROWS):
                for s in slices(batch["text"].slice(i, SLICE_ROWS), SLICE_BYTES):
                    got = np.sort(spread(codes_of(*tokens(s)), width))
                    new = np.flatnonzero(np.concatenate([[True], got[1:] != got[:-1]])) if len(got) else np.zeros(0, np.int64)
                    held.append((got[new], np.diff(np.append(new, len(got)))))
                    if len(held) > 8:
                        yield from give(GRAMS_AT_ONCE)
        if held:
            yield from give(0)

    return run


def _summed(width: int, bits: int, least: int) -> Callable[[pa.Table], pa.Table]:
    """A bucket's codes with their counts over all tasks, those that come `least` times or more."""

    def run(table: pa.Table) -> pa.Table:
        code, at = np.unique(np.concatenate([expand_sorted(x) for x in table["codes"].to_pylist()]), return_inverse=True)
        n = np.bincount(at, weights=np.concatenate([expand(x) for x in table["counts"].to_pylist()])).astype(np.int64)
        keep = n >= least
        code = gathered(code[keep] | U(table["bucket"][0].as_py() << (width - bits)), width)
        return pa.table({"code": code.view(np.int64), "n": n[keep]})

    return run


def build_tree(docs: DataFrame, training: Column, bits: int = 4) -> Tree:
    """The tree's vocabulary and frequent states, and the filter of its rare contexts, from all training rows of docs. bits: log2 of the number of buckets."""
    rows = docs.where(training).select(F.coalesce("text", F.lit("")).alias("text"))

    def counted(codes_of: Callable[[np.ndarray, np.ndarray], np.ndarray], width: int, least: int) -> DataFrame:
        dealt = rows.mapInArrow(_counter(codes_of, width, bits), "bucket int, codes binary, counts binary")
        return dealt.groupBy("bucket").applyInArrow(_summed(width, bits, least), "code long, n long")

    def held(df: DataFrame, least: float) -> tuple[np.ndarray, np.ndarray]:
        got = df.where(F.col("n") >= F.lit(least)).toArrow()  # at most VOCABULARY, or 1 / RARE, rows
        return got["code"].to_numpy().astype(np.int64).view(np.uint64), got["n"].to_numpy().astype(np.int64)

    single = write_table(counted(lambda token, first: token, 64, 1), "words")
    total, once, distinct = (x or 0 for x in single.agg(F.sum("n"), F.count(F.when(F.col("n") == 1, 1)), F.count("n")).first())
    frequent = max(LEAST, RARE * total)
    word, count = held(single, min(frequent, _vocabulary_least(single)))
    tree = Tree(np.append(word, START_HASH), np.append(count, 0), total, once, distinct)
    for depth in range(1, DEPTH + 1):
        sent = docs.sparkSession.sparkContext.broadcast(tree)
        grams = counted(_candidates(sent, depth), SYMBOL_BITS * (depth + 1), 2)
        if depth == DEPTH - 1:
            grams = write_table(grams, "contexts")
            _fill_filter(tree, grams.where(F.col("n") < F.lit(frequent)))
        tree.grow(*held(grams, frequent), keep=depth == DEPTH - 1)
        sent.destroy()  # its counts are in a table, or here
    return tree


def _vocabulary_least(single: DataFrame) -> float:
    """The least count of a word that goes to every task: two at least, and so that no more than VOCABULARY words have it."""
    grade = F.floor(F.log2("n") * 16).cast("int").alias("grade")
    words, least = 0, None
    for g, n in sorted(single.where("n > 1").groupBy(grade).count().collect(), reverse=True):
        words += n
        if words > VOCABULARY:
            break
        least = g
    return 2.0 ** (least / 16) if least is not None else float("inf")


def _fill_filter(tree: Tree, contexts: DataFrame) -> None:
    """Set the filter's bits of all contexts, in blocks of 65536 bits; at most 2**MOST_FILTER_BITS bits come to the driver."""
    bits = int(min(MOST_FILTER_BITS, max(16, np.ceil(np.log2(max(1, FILTER_BITS * contexts.count()))))))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = (mix(batch["code"].to_numpy().view(np.uint64)) >> U(64 - bits)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((place >> 16).astype(np.int32)), pa.array((place & 0xFFFF).astype(np.int32))], ["block", "place"])

    def block(table: pa.Table) -> pa.Table:
        there = np.zeros(1 << 16, bool)
        there[table["place"].to_numpy()] = True
        return pa.table({"block": table["block"].slice(0, 1), "bits": pa.array([np.packbits(there, bitorder="little").tobytes()], pa.binary())})

    blocks = contexts.mapInArrow(places, "block int, place int").groupBy("block").applyInArrow(block, "block int, bits binary").toArrow()
    tree.filter, tree.filter_bits = np.zeros(1 << bits - 3, np.uint8), bits
    for number, raw in zip(blocks["block"].to_pylist(), blocks["bits"].to_pylist()):
        tree.filter[number << 13 : (number + 1) << 13] = np.frombuffer(raw, np.uint8)


def _candidates(tree: Broadcast[Tree], depth: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    return lambda token, first: tree.value.candidates(tree.value.symbol(token), first, depth)


def _deal(tree: Broadcast[Tree], bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each run of rows, its symbols, and by bucket its words outside the vocabulary with their counts in its training rows."""
    most = min(MOST_SENT, max(SLICE_BYTES, SENT_BYTES << bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, count, size = TaskContext.get().partitionId(), 0, 0, 0
        rows, ranks, others, learns = [], [], [], []

        def give() -> Iterator[pa.RecordBatch]:
            nonlocal made, count, size
            name = (part << 24) | made
            made, count, size = made + 1, 0, 0
            word, at = np.unique(np.concatenate(others), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate(learns), minlength=len(word)).astype(np.uint64)
            yield _rows(WORDS_SCHEMA, [-name - 1], name, [np.concatenate(rows).tobytes()], [pack(squeeze(np.concatenate(ranks)))], [pack(squeeze(at))], [None])
            bucket, runs, rest = by_bucket(word, 64, bits)
            for i in range(0, len(runs), 4096):
                mine, none = runs[i : i + 4096], [None] * len(runs[i : i + 4096])
                yield _rows(WORDS_SCHEMA, bucket[i : i + 4096].tolist(), name, none, none, [squeeze_sorted(rest[r]) for r in mine], [squeeze(n[r]) for r in mine])
            for x in (rows, ranks, others, learns):
                x.clear()

        for batch in batches:
            head = np.zeros(batch.num_rows, ROW)
            head["doc_id"], head["held_out"] = batch["doc_id"].to_numpy(zero_copy_only=False), batch["held_out"].to_numpy(zero_copy_only=False)
            for s in slices(batch["text"], SLICE_BYTES):
                for i in range(0, s.last - s.first, SLICE_ROWS):
                    j = min(i + SLICE_ROWS, s.last - s.first)
                    if count and (count + j - i > SLICE_ROWS or size > most):
                        yield from give()
                    at, mine = s.offsets[i : j + 1], head[s.first + i : s.first + j]
                    token, first = tokens(Slice(0, j - i, s.data[at[0] : at[-1]], at - at[0]))
                    mine["size"] = np.diff(first)
                    symbol = tree.value.symbol(token)
                    other = np.flatnonzero(symbol == 0)
                    rows.append(mine)
                    ranks.append(tree.value.rank[symbol.astype(np.int64)])
                    others.append(token[other])
                    learns.append(~np.repeat(mine["held_out"], mine["size"])[other])
                    count, size = count + j - i, size + int(at[-1] - at[0])
        if count:
            yield from give()

    return run


def _rows(schema: str, grp: list[int], name: int, *values: list) -> pa.RecordBatch:
    columns = [pa.array(grp, pa.int64()), pa.array([name] * len(grp), pa.int64()), *(pa.array(x, pa.binary()) for x in values)]
    return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in schema.split(", ")])


def _counts(table: pa.Table) -> pa.Table:
    """A bucket's words with their counts over all slices, for each slice that has them."""
    if table["grp"][0].as_py() < 0:
        return table
    word = [expand_sorted(x) for x in table["words"].to_pylist()]
    _, at = np.unique(np.concatenate(word), return_inverse=True)
    n = np.bincount(at, weights=np.concatenate([expand(x) for x in table["counts"].to_pylist()])).astype(np.uint64)[at]
    cut = np.cumsum([0, *map(len, word)])
    counts = pa.array([squeeze(n[i:j]) for i, j in zip(cut, cut[1:])], pa.binary())
    return table.set_column(table.schema.get_field_index("counts"), "counts", counts)


def _score(tree: Broadcast[Tree], bits: int) -> Callable[[pa.Table], pa.Table]:
    """A slice with all its words' counts: what is known of its rows, and by bucket their rare contexts."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        name = rows[0]["slice"]
        (whole,) = (r for r in rows if r["grp"] < 0)
        mine = sorted((r for r in rows if r["grp"] >= 0), key=lambda r: r["grp"])
        word = np.concatenate([np.zeros(0, np.uint64), *(expand_sorted(r["words"]) | U(r["grp"] << (64 - bits)) for r in mine)])
        count = np.concatenate([np.zeros(0, np.uint64), *(expand(r["counts"]) for r in mine)]).astype(np.int64)
        row = np.frombuffer(whole["head"], ROW)
        first = np.concatenate([[0], np.cumsum(row["size"])])
        symbol = tree.value.by_rank[expand(unpack(whole["symbols"])).astype(np.int64)]
        of_word = expand(unpack(whole["words"])).astype(np.int64)
        known, done = [], 0
        for i, j in _runs(first, SLICE_TOKENS):
            mine = symbol[first[i] : first[j]].astype(np.uint64)
            other = of_word[done : done + int((mine == 0).sum())]
            done += len(other)
            known.append(_known(tree.value, mine, first[i : j + 1] - first[i], row[i:j], i, word[other], count[other], bits))
        head, key, of, training, wide, wide_bucket = (np.concatenate(x) for x in zip(*known))
        del rows, whole, mine, symbol, of_word, known
        order = np.argsort(key)
        key, of, training = key[order], of[order], training[order]
        bucket, runs, rest = by_bucket(key, SYMBOL_BITS * (DEPTH + 1), bits)
        packed: dict[int, list] = {}
        for k, r in zip(bucket.tolist(), runs):
            parts = [squeeze_sorted(rest[r]), of[r].astype("<u2").tobytes(), np.packbits(training[r]).tobytes()]
            packed[k] = [np.array([len(of[r]), len(parts[0])], "<u4").tobytes() + b"".join(parts), None]
        order = np.argsort(wide_bucket, kind="stable")
        wide, wide_bucket = wide[order], wide_bucket[order]
        first = np.flatnonzero(np.diff(wide_bucket, prepend=-1))
        for i, j in zip(first, np.append(first[1:], len(wide))):
            packed.setdefault(int(wide_bucket[i]), [None, None])[1] = wide[i:j].tobytes()
        some = sorted(packed)
        out = _rows(DEALT_SCHEMA, [-name - 1, *some], name, [head.tobytes(), *[None] * len(some)], *([None, *(packed[k][n] for k in some)] for n in range(2)))
        return pa.Table.from_batches([out])

    return run


def _runs(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most `limit` tokens; a longer row comes alone."""
    i = 0
    while i < len(offsets) - 1:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


def _known(tree: Tree, symbol: np.ndarray, first: np.ndarray, rows: np.ndarray, base: int, word: np.ndarray, counts: np.ndarray, bits: int) -> tuple[np.ndarray, ...]:
    """HEAD of each row by words and frequent states; its rare contexts: spread context and next symbol, row, training; WIDE ones and their buckets.

    word, counts: those outside the vocabulary, in order. base: number of the first row.
    """
    count = tree.count[symbol.astype(np.int64)]
    other = np.flatnonzero(symbol == 0)
    count[other] = counts
    logs, root = tree.score_symbols(symbol, first)
    at_root = tree.root(count)
    logs = logs + np.where(root, at_root, 0.0)
    head = np.zeros(len(rows), HEAD)
    head["doc_id"], head["held_out"], head["n_tokens"] = rows["doc_id"], rows["held_out"], np.diff(first)
    head["n_known"] = row_sums((count > 0).astype(np.int64), first)
    head["logs"] = row_sums(np.log10(count + ALPHA), first)
    head["score"] = row_sums(logs, first)
    row = np.repeat(np.arange(len(rows)), np.diff(first))
    training = ~rows["held_out"][row]
    #: Words outside the vocabulary that are told apart.
    rare = (symbol == 0) & (count > 1)
    at, code = tree.rare(symbol, first)
    wide, bucket = np.zeros(0, WIDE), np.zeros(0, np.int64)
    if rare.any():
        token = tree.word[symbol.astype(np.int64)]
        token[other] = word
        mine = rare[at]
        after, context_after = at[mine], code[mine] >> U(SYMBOL_BITS)
        at, code = at[~mine], code[~mine]
        inside, context_inside = _hashed_contexts(token, first, rare, (symbol > 0) | rare)
        place = np.concatenate([after, inside])
        parent = tree.codes(symbol, first, DEPTH - 1)[0][place]
        wide = np.zeros(len(place), WIDE)
        wide["context"] = np.concatenate([context_after, context_inside | HASHED])
        wide["next"] = np.where(rare[place], token[place] | HASHED, symbol[place])
        wide["parent"] = tree.logs(parent, DEPTH - 1, at_root[place])
        wide["row"], wide["training"] = base + row[place], training[place]
        bucket = np.concatenate([spread(context_after, SYMBOL_BITS * DEPTH) >> U(SYMBOL_BITS * DEPTH - bits), (context_inside & ~HASHED) >> U(63 - bits)]).astype(np.int64)
    key = (spread(code >> U(SYMBOL_BITS), SYMBOL_BITS * DEPTH) << U(SYMBOL_BITS)) | (code & U((1 << SYMBOL_BITS) - 1))
    return head, key, base + row[at], training[at], wide, bucket


def _hashed_contexts(token: np.ndarray, first: np.ndarray, rare: np.ndarray, told: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose context of DEPTH words has a rare word and none that isn't told apart, and hashes of those contexts."""
    place = np.arange(len(token)) - np.repeat(first[:-1], np.diff(first))
    some, whole, context = np.zeros(len(token), bool), place >= DEPTH - 1, np.zeros(len(token), np.uint64)
    for k in range(1, DEPTH + 1):
        at = np.flatnonzero(place >= k)
        before = np.full(len(token), START_HASH, np.uint64)
        before[at] = token[at - k]
        some[at] |= rare[at - k]
        whole[at] &= told[at - k]
        context += before * ORDER_CODE[k]
    at = np.flatnonzero(some & whole)
    return at, mix(context[at])


def _contexts(table: pa.Table, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes of a bucket's rare contexts with their next words, their rows, whether those are training rows, and the table's row each is from."""
    code, row, training, of = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)], [np.zeros(0, np.int64)]
    high = U(table["grp"][0].as_py() << (SYMBOL_BITS * (DEPTH + 1) - bits))
    for k, raw in enumerate(table["contexts"].to_pylist()):
        if raw is None:
            continue
        n, size = np.frombuffer(raw, "<u4", 2).tolist()
        code.append(expand_sorted(raw[8 : 8 + size]) | high)
        row.append(np.frombuffer(raw, "<u2", n, 8 + size).astype(np.int64))
        training.append(np.unpackbits(np.frombuffer(raw, np.uint8, offset=8 + size + 2 * n), count=n).astype(bool))
        of.append(np.full(n, k))
    key = np.concatenate(code)
    context = gathered(key >> U(SYMBOL_BITS), SYMBOL_BITS * DEPTH)
    return (context << U(SYMBOL_BITS)) | (key & U((1 << SYMBOL_BITS) - 1)), np.concatenate(row), np.concatenate(training), np.concatenate(of)


def rare_states(tree: Tree, code: np.ndarray, training: np.ndarray, wide: np.ndarray) -> np.ndarray:
    """What the states among these contexts add to the log10 probability of each occurrence, the wide ones last. All occurrences of a context are here."""
    kind, at = np.unique(np.concatenate([code, mix(mix(wide["context"]) + wide["next"]) | HASHED]), return_inverse=True)
    n = np.bincount(at, weights=np.concatenate([training, wide["training"]]), minlength=len(kind)).astype(float)
    narrow = int(np.searchsorted(kind, HASHED))
    kind, one = kind[:narrow], np.zeros(len(kind) - narrow, np.int64)
    one[at[len(code) :] - narrow] = np.arange(len(wide))
    wide = wide[one]
    known = np.concatenate([kind & U((1 << SYMBOL_BITS) - 1) > 0, wide["next"] > 0])
    log = np.where(known, np.concatenate([tree.logs(kind & U((1 << SYMBOL_BITS * DEPTH) - 1), DEPTH - 1), wide["parent"]]), 0.0)
    parent = 10.0**log
    context, of = np.unique(np.concatenate([kind >> U(SYMBOL_BITS), wide["context"]]), return_inverse=True)
    seen = (n > 0) & known

    def per_context(values: np.ndarray) -> np.ndarray:
        return np.bincount(of, weights=values, minlength=len(context)).astype(float)

    total, of_seen = per_context(n), per_context(np.where(seen, n, 0))
    rest, left = total - of_seen, np.maximum(1 - per_context(np.where(seen, parent, 0)), 1e-9)
    gain = per_context(np.where(seen, n * np.log2(np.maximum(n, 1e-9) / np.maximum(total, 1)[of] / parent), 0))
    gain += np.where(rest > 0, rest * np.log2(np.maximum(rest, 1e-9) / np.maximum(total, 1) / left), 0)
    state = (total > 1) & (gain >= DIVERGENCE)
    p = (n + PRIOR * parent) / (total[of] + PRIOR)
    weight = np.maximum(1 - per_context(np.where(seen, p, 0)), 1e-12) / left
    return np.where(state[of], np.where(seen, np.log10(p) - log, np.log10(weight)[of]), 0.0)[at]


def _total(tree: Broadcast[Tree], bits: int) -> Callable[[pa.Table], pa.Table]:
    """What a bucket's states add to the rows of each slice."""

    def run(table: pa.Table) -> pa.Table:
        if table["grp"][0].as_py() < 0:
            return table.select(["slice", "head", "contexts"])
        code, row, training, of = _contexts(table, bits)
        raw = [x or b"" for x in table["wide"].to_pylist()]
        wide = np.frombuffer(b"".join(raw), WIDE)
        row, of = np.concatenate([row, wide["row"]]), np.concatenate([of, np.repeat(np.arange(len(raw)), [len(x) // WIDE.itemsize for x in raw])])
        steps = np.clip(np.rint(rare_states(tree.value, code, training, wide) / STEP), -32768, 32767)
        change = np.flatnonzero(steps)
        if len(wide):
            change = change[np.argsort(of[change], kind="stable")]
        adds = np.zeros(len(change), CONTEXT_ADDS)
        adds["row"], adds["steps"] = row[change], steps[change]
        cut = np.searchsorted(of[change], np.arange(table.num_rows + 1))
        return pa.table([table["slice"], pa.array([None] * table.num_rows, pa.binary()), pa.array([adds[i:j].tobytes() for i, j in zip(cut, cut[1:])], pa.binary())], names=["slice", "head", "contexts"])

    return run


def _merge(table: pa.Table) -> pa.Table:
    """The rows of a slice with everything added up."""
    head = np.frombuffer(next(x for x in table["head"].to_pylist() if x is not None), HEAD)
    adds = np.frombuffer(b"".join(x or b"" for x in table["contexts"].to_pylist()), CONTEXT_ADDS)
    score = head["score"] + np.bincount(adds["row"], weights=adds["steps"] * STEP, minlength=len(head))
    return pa.table({k: head[k] for k in ("doc_id", "held_out", "n_tokens", "n_known", "logs")} | {"score": score})


def score_texts(docs: DataFrame, training: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs."""
    bits = bucket_bits(text_bytes(docs))
    built = build_tree(docs, training, bits)
    tree = docs.sparkSession.sparkContext.broadcast(built)
    rows = docs.select(row_id(), (~training).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    counted = rows.mapInArrow(_deal(tree, bits), WORDS_SCHEMA).groupBy("grp").applyInArrow(_counts, WORDS_SCHEMA)
    dealt = counted.groupBy("slice").applyInArrow(_score(tree, bits), DEALT_SCHEMA)
    scored = write_table(dealt.groupBy("grp").applyInArrow(_total(tree, bits), BACK_SCHEMA).groupBy("slice").applyInArrow(_merge, SCORE_SCHEMA), "scores")
    base = F.col("logs") - F.col("n_tokens") * F.lit(float(np.log10(built.total + ALPHA * (built.distinct + 1))))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(built.total).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
