"""Best-fit packing of token sequences with exact-complement hashing.

Documents become token ids plus one end id each. Only documents longer than the
context are cut, into context-long pieces of which the first may be shorter.
Packing is planned on the histogram of piece lengths, which has as many entries
as the context is long whatever the corpus: for each length from the longest
on, the gap it leaves is looked up among single lengths, then sums of two, then
sums of three, and a combination is used as often as its pieces are available.
What is left goes to the open sequence with the smallest gap that holds it.
The plan gives each length ranges of ranks; a piece's rank among the pieces of
its length then tells its sequence and offset, so no task sees all pieces of a
length.

Null texts count as empty: one piece, the end id. Repeated rows are packed like
any others. An empty table gives an empty result.
"""

from __future__ import annotations

import os
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernels import Slice, prefix_sums, range_hash, row_sums, slices
from .sampling import row_id
from .storage import write_table

CONTEXT = 2048
END_ID = 0
#: Pieces of one length that one task ranks, on average.
RANK_ROWS = 250_000
#: Distinct words a worker remembers the ids of, about 20 bytes each.
CACHE_WORDS = 800_000
SLICE_BYTES = 1 << 20
#: Texts that the tokenizer gets at once: what it returns is many times their size.
ENCODE_AT_ONCE = 1024
SLICE_ROWS = 4096

PIECES_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED_SCHEMA = PIECES_SCHEMA + ", sequence_id long, offset long"

#: Byte classes of plain text: 0 not plain, 1 letters (and the bytes of \xc0-\xff), 2 digits, 3 other marks, 4 white space.
CLASS = np.zeros(256, np.uint8)
CLASS[0x21:0x7F] = 3
CLASS[0x30:0x3A] = 2
CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0xC0), 0xC3]] = 1
CLASS[[0x09, 0x0A, 0x20]] = 4
CLASS[0x27] = 0


def _ends(size: np.ndarray | list[int]) -> np.ndarray:
    out = np.zeros(len(size) + 1, np.int32)
    np.cumsum(size, out=out[1:])
    return out


class Ids:
    """Token ids of texts, from the tokenizer.

    The vocabulary's pattern cuts plain Latin text (no apostrophes, no runs of
    white space) where the class of characters changes, a space going with what
    follows it. Such texts are cut so, and each distinct word is encoded once;
    words are told apart by 64 bits of hash. Other texts, and those that hold the
    string of a special token, are encoded whole. Both give the ids of the whole
    text.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        #: Sorted hashes, and where their ids begin and end, in an old and a new part.
        self.parts = [self._part() for _ in range(2)]

    def _part(self, *columns: np.ndarray) -> list[np.ndarray]:
        return list(columns) or [np.zeros(0, np.uint64), np.zeros(1, np.int32), np.zeros(0, self.dtype)]

    def _encode(self, texts: list[str]) -> list[list[int]]:
        out: list[list[int]] = []
        for i in range(0, len(texts), ENCODE_AT_ONCE):
            out += [x.ids for x in self.tokenizer.encode_batch_fast(texts[i : i + ENCODE_AT_ONCE], add_special_tokens=False)]
        return out

    @staticmethod
    def _gather(part: list[np.ndarray], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of the words at these places, end to end, and their numbers."""
        size = part[1][at + 1] - part[1][at]
        begin = np.cumsum(size, dtype=np.int32) - size
        return part[2][np.repeat(part[1][at] - begin, size) + np.arange(int(size.sum()), dtype=np.int32)], size

    def _merge(self, x: list[np.ndarray], y: list[np.ndarray]) -> list[np.ndarray]:
        order = np.argsort(np.concatenate([x[0], y[0]]))
        both = self._part(np.concatenate([x[0], y[0]]), np.concatenate([x[1], x[1][-1] + y[1][1:]]), np.concatenate([x[2], y[2]]))
        flat, size = self._gather(both, order)
        return self._part(both[0][order], _ends(size), flat)

    def _words(self, word: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        """A part that holds just these (sorted, distinct) words."""
        held, found = np.full(len(word), -1), []
        for k, part in enumerate(self.parts):
            if len(part[0]):
                at = np.minimum(np.searchsorted(part[0], word), len(part[0]) - 1)
                hit = part[0][at] == word
                held[hit] = k
                flat, size = self._gather(part, at[hit])
                found.append(self._part(word[hit], _ends(size), flat))
        new = np.flatnonzero(held < 0)
        if len(new):
            raw = data.tobytes()
            ids = self._encode([raw[i:j].decode() for i, j in zip(start[new].tolist(), end[new].tolist())])
            fresh = self._part(word[new], _ends([len(x) for x in ids]), np.array([y for x in ids for y in x], self.dtype))
            found.append(fresh)
            if len(self.parts[0][0]) + len(self.parts[1][0]) < CACHE_WORDS:
                self.parts[1] = self._merge(self.parts[1], fresh)
                if len(self.parts[1][0]) * 4 > len(self.parts[0][0]):
                    self.parts = [self._merge(*self.parts), self._part()]
        out = found[0]
        for x in found[1:]:
            out = self._merge(out, x)
        return out

    def __call__(self, s: Slice) -> list[np.ndarray]:
        """Ids of each row of a slice."""
        m, data = s.last - s.first, s.data
        if not len(data):
            return [np.zeros(0, self.dtype)] * m
        kind = CLASS[data]
        border = np.zeros(len(data) + 1, bool)
        border[s.offsets] = True
        before = np.concatenate([[0], kind[:-1]])
        before[border[:-1]] = 0
        last = np.concatenate([[0], data[:-1]])
        odd = (kind == 0) | ((kind == 4) & (before == 4)) | ((data >= 0x80) & (data < 0xC0) & (last != 0xC3)) | ((last == 0xC3) & ((data == 0x97) | (data == 0xB7)))
        plain = row_sums(odd.astype(np.int64), s.offsets) == 0
        whole_text = data.tobytes()
        for word in self.special:
            at = whole_text.find(word)
            while at >= 0:
                plain[np.searchsorted(s.offsets, at, "right") - 1] = False
                at = whole_text.find(word, at + 1)
        first = border[:-1] | (kind == 4) | ((kind != before) & (last != 0x20))
        start = np.flatnonzero(first)
        end = np.append(start[1:], len(data))
        row = np.searchsorted(s.offsets, start, "right") - 1
        keep = plain[row]
        start, end, row = start[keep], end[keep], row[keep]
        out: list[np.ndarray] = [np.zeros(0, self.dtype)] * m
        if len(start):
            word, at, back = np.unique(range_hash(prefix_sums(data), start, end), return_index=True, return_inverse=True)
            flat, size = self._gather(self._words(word, data, start[at], end[at]), back)
            cut = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(row, np.arange(m + 1))]
            out = [flat[i:j] for i, j in zip(cut, cut[1:])]
        whole = np.flatnonzero(~plain)
        raw = [data[s.offsets[r] : s.offsets[r + 1]].tobytes().decode() for r in whole]
        for r, text in zip(whole, raw):
            out[r] = np.array(self._encode([text])[0], self.dtype)
        return out


_IDS: dict[str, Ids] = {}


def pieces(docs: DataFrame, tokenizer: str, context: int = CONTEXT) -> DataFrame:
    """doc_id, piece, start, length and the CRC-32 of its ids for each piece."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = _IDS.get(tokenizer) or Ids(tokenizer)
        _IDS[tokenizer] = ids_of
        for batch in batches:
            docs_of = batch["doc_id"].to_pylist()
            for i in range(0, batch.num_rows, SLICE_ROWS):
                for s in slices(batch["text"].slice(i, SLICE_ROWS), SLICE_BYTES):
                    out: list[list[int]] = [[], [], [], [], []]
                    for doc, ids in zip(docs_of[i + s.first : i + s.last], ids_of(s)):
                        raw = np.append(ids, END_ID).astype("<u4").tobytes()
                        n = len(raw) // 4
                        start, k = 0, 0
                        while start < n:
                            length = (n - start) % context or min(context, n - start)
                            for column, value in zip(out, (doc, k, start, length, zlib.crc32(memoryview(raw)[4 * start : 4 * (start + length)]))):
                                column.append(value)
                            start, k = start + length, k + 1
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(row_id(), "text").mapInArrow(cut, PIECES_SCHEMA)


class Complements:
    """Counts of available pieces by length, and an index of the exact sums of one, two and three of them.

    Sums of two are listed by sum, each as its longer length, the longest
    first; sums of three are a length and a listed sum of two. Pieces only ever
    get fewer, so entries that are used up go from the lists for good.
    """

    def __init__(self, counts: dict[int, int], context: int) -> None:
        self.n = np.zeros(context + 1, np.int64)
        for length, count in counts.items():
            self.n[length] = count
        have = np.flatnonzero(self.n)[::-1]
        self.longest = have.tolist()
        long, short = (x.ravel() for x in np.meshgrid(have, have, indexing="ij"))
        fits = (long >= short) & (long + short <= context)
        long, total = long[fits], (long + short)[fits]
        order = np.argsort(total, kind="stable")
        self.pairs = dict(enumerate(np.split(long[order], np.searchsorted(total[order], np.arange(1, context + 1)))))
        self.at_triple: dict[int, int] = defaultdict(int)

    def _live(self, total: int, *taken: int) -> np.ndarray:
        """Longer lengths of the listed pairs of a sum that are there beside the pieces taken."""
        held = self.pairs[total]
        if not len(held):
            return held
        rest = total - held
        there = (self.n[held] > 0) & (self.n[rest] > (held == rest))
        if not there.all():
            held = self.pairs[total] = held[there]
            rest = rest[there]
        spare_long, spare_short = self.n[held] - (held == rest), self.n[rest] - (held == rest)
        for x in taken:
            spare_long, spare_short = spare_long - (held == x), spare_short - (rest == x)
        return held[(spare_long > 0) & (spare_short > 0)]

    def single(self, total: int, taken: int) -> tuple[int, ...] | None:
        return (total,) if total and self.n[total] > (total == taken) else None

    def pair(self, total: int, *taken: int) -> tuple[int, ...] | None:
        """The pair with the longest first member that sums to total."""
        live = self._live(total, *taken)
        return (int(live[0]), total - int(live[0])) if len(live) else None

    def triple(self, total: int, taken: int) -> tuple[int, ...] | None:
        """A length, the longest that has one, and a pair of what it leaves. Lengths that have none are passed once a sum."""
        while (k := self.at_triple[total]) < len(self.longest):
            a = self.longest[k]
            if a < total and self.n[a] > (a == taken):
                rest = self.pair(total - a, a, taken)
                if rest:
                    return (a, *rest)
            self.at_triple[total] = k + 1
        return None

    def fill(self, length: int) -> tuple[int, ...] | None:
        """Pieces that fill the gap beside one of this length."""
        gap = len(self.n) - 1 - length
        return self.single(gap, length) or self.pair(gap, length) or self.triple(gap, length)


def plan(counts: dict[int, int], context: int = CONTEXT) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how many sequences follow each; every piece is in one."""
    free = Complements(counts, context)
    made: list[tuple[tuple[int, ...], int]] = []

    def use(pattern: tuple[int, ...]) -> None:
        times = min(int(free.n[x]) // pattern.count(x) for x in pattern)
        for x in pattern:
            free.n[x] -= times
        made.append((pattern, times))

    if free.n[context]:
        use((context,))
    for length in range(context - 1, 0, -1):
        while free.n[length]:
            rest = free.fill(length)
            if rest is None:
                break
            use((length, *rest))
    return made + best_fit(free, context)


def best_fit(free: Complements, context: int) -> list[tuple[tuple[int, ...], int]]:
    """Longest pieces first, each to the open sequence with the smallest gap that holds it; equal pieces go together."""
    gaps: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for length in range(context, 0, -1):
        left = int(free.n[length])
        free.n[length] = 0
        while left:
            gap = next((g for g in range(length, context + 1) if gaps.get(g)), None)
            if gap is None:
                each = context // length
                full, rest = divmod(left, each)
                if full:
                    gaps[context - each * length].append(((length,) * each, full))
                if rest:
                    gaps[context - rest * length].append(((length,) * rest, 1))
                break
            pattern, times = gaps[gap].pop()
            used = min(left, times)
            if used < times:
                gaps[gap].append((pattern, times - used))
            gaps[gap - length].append((pattern + (length,), used))
            left -= used
    return [x for same in gaps.values() for x in same]


def slots(made: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: first rank of each range, the sequence of that rank, and the offset of the range's pieces."""
    ranges: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    taken: dict[int, int] = defaultdict(int)
    sequence = 0
    for pattern, times in made:
        offset = 0
        for length in pattern:
            ranges[length].append((taken[length], sequence, offset))
            taken[length] += times
            offset += length
        sequence += times
    return {k: tuple(np.array(c, np.int64) for c in zip(*v)) for k, v in ranges.items()}


def pack(cut: DataFrame, context: int = CONTEXT) -> DataFrame:
    """Each piece with its sequence_id and offset. `cut` is read several times: a written table.

    Pieces of a length are ranked in salted groups, so a length that much of the
    corpus has is ranked by many tasks. The histogram, at most `context` rows, and
    the plan made from it are all that the driver holds.
    """
    salts = max(8, -(-cut.count() // RANK_ROWS))
    salt = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int").alias("salt")
    sizes = cut.groupBy("length", salt).count()
    before = F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count")
    base = write_table(sizes.select("length", "salt", "count", before.alias("base")), "ranks")
    counts = {r[0]: r[1] for r in base.groupBy("length").agg(F.sum("count")).collect()}
    where = slots(plan(counts, context))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for x in np.unique(length):
                mine = np.flatnonzero(length == x)
                first, seq, off = where[int(x)]
                at = np.searchsorted(first, rank[mine], "right") - 1
                sequence[mine], offset[mine] = seq[at] + rank[mine] - first[at], off[at]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    row = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32", "start"))
    ranked = cut.withColumn("salt", salt).withColumn("row", row).join(base.select("length", "salt", "base"), ["length", "salt"])
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("row") - 1).cast("long").alias("rank")).mapInArrow(place, PACKED_SCHEMA)


def best_fit_packing(docs: DataFrame, tokenizer: str, context: int = CONTEXT) -> DataFrame:
    """Pieces of all documents, placed in sequences of at most `context` tokens. tokenizer: a file for `tokenizers`."""
    return pack(write_table(pieces(docs, tokenizer, context), "pieces"), context)
