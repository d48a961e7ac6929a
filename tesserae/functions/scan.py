"""A structural scan of many bencoded documents at once, on the buffers of an Arrow batch.

All documents are read in step, a token of each a time, so a step is a few numpy
operations over the batch. What comes out are marks: each token's span, kind,
depth, parent and place among its siblings. Only canonical documents have marks:
keys sorted and once each, numbers and lengths without leading zeros, up to 18
digits, DEPTH levels. Others, and the long rest of a batch that only FEW documents
still have, are left to a reader that goes through them one by one.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

TEXT, NUMBER, LIST, DICT, END = range(5)
DEPTH, DIGITS = 12, 18
#: After so many steps documents that only so few are left of are given up.
STEPS, FEW = 64, 8


class Marks(NamedTuple):
    """Tokens in order: whole span, payload or value, document, kind, parent (-1: none), place and next sibling (-1: none)."""

    start: np.ndarray
    end: np.ndarray
    low: np.ndarray
    high: np.ndarray
    doc: np.ndarray
    kind: np.ndarray
    parent: np.ndarray
    place: np.ndarray
    next: np.ndarray
    children: np.ndarray


def _following(data: np.ndarray, byte: int) -> np.ndarray:
    """For each place the next one that has the byte, or the end."""
    at = np.where(data == byte, np.arange(len(data)), len(data))
    return np.append(np.minimum.accumulate(at[::-1])[::-1], len(data))


def _number(data: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of digits low..high, and whether they are canonical."""
    size = high - low
    value, good = np.zeros(len(low), np.int64), (size >= 1) & (size <= DIGITS)
    good[good] &= (data[low[good]] != 48) | (size[good] == 1)
    for k in range(int(size[good].max(initial=0))):
        on = np.flatnonzero(good & (size > k))
        digit = data[low[on] + k].astype(np.int64) - 48
        value[on] = value[on] * 10 + digit
        good[on[(digit < 0) | (digit > 9)]] = False
    return value, good


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """start, end, low, high, doc, kind and depth of all tokens in order, and which documents were read to their end."""
    n, found = len(offsets) - 1, []
    at, stop, depth = offsets[:-1].copy(), offsets[1:], np.zeros(n, np.int64)
    whole, colon, mark = np.zeros(n, bool), _following(data, ord(":")), _following(data, ord("e"))
    live, step = np.arange(n), 0
    while len(live) and not (step > STEPS and len(live) <= FEW):
        step += 1
        live = live[at[live] < stop[live]]
        p = at[live]
        byte = data[p]
        kind = np.full(len(live), -1)
        for code, lead in ((NUMBER, "i"), (LIST, "l"), (DICT, "d"), (END, "e")):
            kind[byte == ord(lead)] = code
        kind[(byte >= 48) & (byte <= 57)] = TEXT
        low, high, to = p.copy(), p.copy(), p + 1
        text = np.flatnonzero(kind == TEXT)
        size, good = _number(data, p[text], colon[p[text]])
        low[text] = colon[p[text]] + 1
        high[text] = to[text] = low[text] + size
        kind[text[~good]] = -1
        whole_number = np.flatnonzero(kind == NUMBER)
        close = mark[p[whole_number]]
        minus = np.append(data, 0)[p[whole_number] + 1] == ord("-")
        value, good = _number(data, p[whole_number] + 1 + minus, close)
        good &= ~(minus & (value == 0))
        low[whole_number], to[whole_number] = np.where(minus, -value, value), close + 1
        kind[whole_number[~good]] = -1
        opens, ends = (kind == LIST) | (kind == DICT), kind == END
        level = depth[live] - ends
        fine = (kind >= 0) & (to <= stop[live]) & (level >= 0) & (level < DEPTH)
        live, p, to, low, high, kind, level, opens = (x[fine] for x in (live, p, to, low, high, kind, level, opens))
        found.append((p, to, low, high, live, kind, level))
        at[live], depth[live] = to, level + opens
        done = depth[live] == 0
        whole[live[done]] = to[done] == stop[live[done]]
        live = live[~done]
    columns = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, np.int64)] * 7
    order = np.argsort(columns[0], kind="stable")
    return [c[order] for c in columns], whole


def scan(data: np.ndarray, offsets: np.ndarray) -> tuple[Marks, np.ndarray]:
    """Marks of all canonical documents, and which those are."""
    columns, whole = _tokens(data, offsets)
    kept = whole[columns[4]]
    start, end, low, high, doc, kind, depth = (c[kept] for c in columns)
    n = len(start)
    parent, place, follow, children = np.full(n, -1), np.zeros(n, np.int64), np.full(n, -1), np.zeros(n, np.int64)
    for level in range(DEPTH):
        openers = np.flatnonzero((depth == level) & ((kind == LIST) | (kind == DICT)))
        closed = np.flatnonzero((depth == level) & (kind == END))
        end[openers] = end[closed]  # they alternate, in order
        inner = np.flatnonzero((depth == level + 1) & (kind != END))
        if not len(inner):
            continue
        up = openers[np.searchsorted(openers, inner) - 1]
        parent[inner] = up
        first = np.concatenate([[True], up[1:] != up[:-1]])
        begin = np.flatnonzero(first)
        place[inner] = np.arange(len(inner)) - begin[np.cumsum(first) - 1]
        follow[inner[:-1]] = np.where(first[1:], -1, inner[1:])
        children[up[begin]] = np.diff(np.append(begin, len(inner)))
    marks = Marks(start, end, low, high, doc, kind, parent, place, follow, children)
    odd = np.zeros(len(whole), bool)
    odd[doc[(kind == DICT) & (children % 2 == 1)]] = True
    keys = np.flatnonzero((parent >= 0) & (kind != END) & (kind[parent] == DICT) & (place % 2 == 0))
    odd[doc[keys[kind[keys] != TEXT]]] = True
    keys = keys[kind[keys] == TEXT]
    for level in range(1, DEPTH):  # of one depth, the keys of a dictionary follow each other
        here = keys[depth[keys] == level]
        if len(here) > 1:
            names = spans(data, low[here], high[here])
            rises = pc.less(names.slice(0, len(here) - 1), names.slice(1)).to_numpy(zero_copy_only=False)
            odd[doc[here[1:][(parent[here[1:]] == parent[here[:-1]]) & ~rises]]] = True
    return marks, whole & ~odd


def spans(data: np.ndarray, low: np.ndarray, high: np.ndarray, missing: np.ndarray | None = None) -> pa.BinaryArray:
    """The bytes low..high of each, null where missing."""
    size = high - low if missing is None else np.where(missing, 0, high - low)
    offsets = np.concatenate([[0], np.cumsum(size)])
    taken = data[np.repeat(low - offsets[:-1], size) + np.arange(offsets[-1])]
    valid = None if missing is None else pa.py_buffer(np.packbits(~missing, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.binary(), len(low), [valid, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(taken).tobytes())])
