"""Vectorised byte-level text kernels shared by the operators of this subpackage.

Everything works on the UTF-8 buffers of Arrow string columns, a bounded number
of bytes at a time, so memory follows the slice size and not the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SLICE_BYTES = 1 << 20
_RNG = np.random.default_rng(20240229)
BYTE_CODE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
ORDER_CODE = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * U(2) + U(1)
BASE = U(0x9E3779B97F4A7C15)
BASE_INV = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32
#: Everything but \x20 and \x09-\x0D.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False

_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i (mod 2**64) for i < n, kept between calls."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, SLICE_BYTES + 1)
        for name, base in (("up", BASE), ("down", BASE_INV)):
            a = np.full(size, base, dtype=np.uint64)
            a[0] = U(1)
            np.multiply.accumulate(a, out=a)
            _POWERS[name] = a
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    n = len(column)
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return raw, offsets - offsets[0]


class Slice(NamedTuple):
    """Rows first..last-1 of a batch: their bytes and offsets into them."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Runs of whole rows of at most `limit` bytes; a longer row comes alone."""
    raw, offsets = buffers(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield Slice(i, j, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j


def prefix_sums(lowered: np.ndarray) -> np.ndarray:
    """P[i] = sum of code(b[j]) * BASE**j for j < i: hashes of any range in O(1)."""
    up, _ = powers(len(lowered) + 1)
    out = np.empty(len(lowered) + 1, np.uint64)
    out[0] = 0
    np.cumsum(BYTE_CODE[lowered] * up[: len(lowered)], out=out[1:])
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of bytes start..end-1, whatever their place."""
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * ORDER_CODE[63])


class Words(NamedTuple):
    """Words of a slice in order: first byte, byte after the last, row, first word of each row."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = NOT_SPACE) -> Words:
    """Maximal runs of word bytes; runs never cross rows."""
    n = len(data)
    if not n:
        return Words(*(np.zeros(0, np.int64),) * 3, np.zeros(len(offsets), np.int64))
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = is_word[data]
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | border[:-1]))
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | border[1:])) + 1
    first = np.searchsorted(start, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(start, end, row, first)


def row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[i]:first[i+1]]; empty runs give 0."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else values.dtype)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def shingles(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every run of `width` words; a row with fewer words, but not none, gives its whole sequence."""
    n, count = len(hashes), np.diff(first)
    rows, out = [], []
    if n >= width:
        total = hashes[: n - width + 1] * ORDER_CODE[0]
        for k in range(1, width):
            total = total + hashes[k : n - width + 1 + k] * ORDER_CODE[k]
        row = np.repeat(np.arange(len(count)), count)
        ok = row[: n - width + 1] == row[width - 1 :]
        rows.append(row[: n - width + 1][ok])
        out.append(mix(total[ok]))
    short = np.flatnonzero((count > 0) & (count < width))
    for r in short:
        run = hashes[first[r] : first[r + 1]]
        rows.append(np.array([r]))
        out.append(mix((run * ORDER_CODE[: len(run)]).sum(keepdims=True) + np.array([len(run)], np.uint64) * ORDER_CODE[62]))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(rows), np.concatenate(out)


GRAM_BITS = 16


def padded(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Bytes with every white space a blank and one around each row, two after the last, at least four, A-Z lowered if asked; where each row's begin."""
    m = len(offsets) - 1
    out = np.full(max(4, len(data) + m + 2), 0x20, np.uint8)
    row = np.repeat(np.arange(m), np.diff(offsets))
    out[np.arange(len(data)) + row + 1] = np.where(NOT_SPACE[data], ASCII_LOWER[data] if lower else data, 0x20)
    return out, offsets + np.arange(m + 1)


def grams(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the 3- and the 4-gram at each byte (the last three have none of their own)."""
    b = text.astype(np.uint32)
    three = (b[:-3] << np.uint32(16)) | (b[1:-2] << np.uint32(8)) | b[2:-1]
    four = (three << np.uint32(8)) | b[3:]
    shift = np.uint32(32 - GRAM_BITS)
    return (three * np.uint32(0x9E3779B1)) >> shift, (four * np.uint32(0x85EBCA6B)) >> shift


def word_spans(text: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word of a padded text, and the first word of each row."""
    inside = text != 0x20
    start = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    end = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    return start, end, np.searchsorted(start, begin)
