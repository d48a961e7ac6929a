"""SimHash near-duplicates: fingerprints of word shingles, linked through BK-trees.

A fingerprint has 64 bits; each is set where over half of the shingles' hashes
have it set. Texts with one fingerprint meet first, so what follows works on
distinct fingerprints. Two of them at a distance of at most RADIUS bits are equal
in at least one of RADIUS + 1 runs of bits. A shard is one value of one run: the
runs make at most 40,960 shards, whatever the corpus, and only fingerprints of a
shard need to be compared.

Each shard has its BK-tree: a node's children are keyed by their distance to it,
and a search follows only edges whose keys are within the radius of the searched
fingerprint's distance. A tree goes to the tasks that search it, not to all: the
trees of a corpus grow with it, so there is no bound for a broadcast. A shard of
more than TREE_NODES fingerprints is dealt to parts with a tree each; every two parts meet
once, and one part's fingerprints search the other's tree there. Trees and searches are vectorised: a level of
all trees of a task at once.

Near copies of one text can have many fingerprints, all within the radius of each
other. A task knows which fingerprints its links have joined so far, searches in
rounds, and leaves out a subtree whose fingerprints are all joined with the
searched one already. It gives a spanning forest of its links, never all pairs,
and components are found from those.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .kernels import ASCII_LOWER, U, slices, words
from .sampling import row_id
from .storage import write_table

RADIUS = 4
WIDTH = 4
#: The runs of bits that are compared for equality, as (first bit, bits), and the hash's seed.
RUNS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
SEED = 42
TREE_NODES = 1 << 15
#: Rows of trees and searches that a task takes at once, about.
TASK_ROWS = 1 << 17
#: Shingles whose bits are counted at once, and searches of a round: it doubles from the first.
CHUNK = 1 << 15
FIRST_ROUND = 1 << 10

_P1, _P2, _P3, _P4, _P5 = (U(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << U(by)) | (x >> U(64 - by))


def xxh64(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of data[start[i]:end[i]]; all strings at once, lane by lane."""
    raw = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(raw) - 7,), "<u8", raw, 0, (1,))
    four = np.ndarray((len(raw) - 3,), "<u4", raw, 0, (1,))
    size, at = end - start, start.copy()
    s = U(seed)
    with np.errstate(over="ignore"):
        h = np.full(len(start), s + _P5)
        big = np.flatnonzero(size >= 32)
        if len(big):
            lanes = [np.full(len(big), x) for x in (s + _P1 + _P2, s + _P2, s, s - _P1)]
            todo, where = np.arange(len(big)), at[big]
            stripes = size[big] // 32
            for k in range(int(stripes.max())):
                todo = todo[stripes[todo] > k]
                for j in range(4):
                    lanes[j][todo] = _turn(lanes[j][todo] + eight[where[todo] + (32 * k + 8 * j)] * _P2, 31) * _P1
            v = sum((_turn(x, by) for x, by in zip(lanes[1:], (7, 12, 18))), _turn(lanes[0], 1))
            for x in lanes:
                v = (v ^ (_turn(x * _P2, 31) * _P1)) * _P1 + _P4
            h[big] = v
            at[big] += stripes * 32
        h += size.astype(np.uint64)
        for _ in range(3):
            todo = np.flatnonzero(end - at >= 8)
            h[todo] = _turn(h[todo] ^ (_turn(eight[at[todo]] * _P2, 31) * _P1), 27) * _P1 + _P4
            at[todo] += 8
        todo = np.flatnonzero(end - at >= 4)
        h[todo] = _turn(h[todo] ^ (four[at[todo]].astype(np.uint64) * _P1), 23) * _P2 + _P3
        at[todo] += 4
        for _ in range(3):
            todo = np.flatnonzero(end > at)
            h[todo] = _turn(h[todo] ^ (raw[at[todo]].astype(np.uint64) * _P5), 11) * _P1
            at[todo] += 1
        h = (h ^ (h >> U(33))) * _P2
        h = (h ^ (h >> U(29))) * _P3
        return h ^ (h >> U(32))


def fingerprints_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The fingerprint of each row of a slice."""
    w = words(data, offsets)
    count = np.diff(w.first)
    size = w.end - w.start
    begin = np.cumsum(size + 1) - (size + 1)  # of each word, when words stand one blank apart
    joined = np.full(int((size + 1).sum()), 0x20, np.uint8)
    joined[np.repeat(begin - w.start, size) + np.flatnonzero(_inside(w.start, w.end, len(data)))] = ASCII_LOWER[data[_inside(w.start, w.end, len(data))]]
    shingles = np.where(count >= WIDTH, count - WIDTH + 1, np.minimum(count, 1))
    row = np.repeat(np.arange(len(count)), shingles)
    at = w.first[:-1][row] + np.arange(len(row)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    last = at + np.minimum(count, WIDTH)[row] - 1
    votes = np.zeros((len(count), 64), np.int64)
    for i in range(0, len(row), CHUNK):
        h = xxh64(joined, begin[at[i : i + CHUNK]], begin[last[i : i + CHUNK]] + size[last[i : i + CHUNK]])
        of = row[i : i + CHUNK]
        cut = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        votes[of[cut]] += np.add.reduceat(np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), cut, axis=0, dtype=np.int64)
    return np.packbits(2 * votes > shingles[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def _inside(start: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Which bytes belong to a word."""
    step = np.zeros(n + 1, np.int8)
    step[start] += 1
    step[end] -= 1
    return np.cumsum(step[:-1], dtype=np.int8).astype(bool)


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [fingerprints_of(s.data, s.offsets) for s in slices(batch["text"])]
        found = np.concatenate(out or [np.zeros(0, np.uint64)]).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found)], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp, the fingerprint as a long, of every row."""
    return docs.select(row_id(), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(_fingerprint, "doc_id long, fp long")


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


class Trees:
    """BK-trees of many shards, level by level. Node i holds fp[i]; its children stand together, ordered by edge."""

    def __init__(self, tree: np.ndarray, fp: np.ndarray) -> None:
        self.fp = fp
        n = len(fp)
        self.parent, self.edge, self.levels = np.full(n, -1), np.zeros(n, np.int64), []
        of, key = np.arange(n), tree * 65
        up, edge = np.full(n, -1), np.zeros(n, np.int64)
        while len(of):
            _, first, group = np.unique(key, return_index=True, return_inverse=True)
            node = of[first]
            self.levels.append(node)
            self.parent[node], self.edge[node] = up[first], edge[first]
            rest = np.ones(len(of), bool)
            rest[first] = False
            of, up = of[rest], node[group[rest]]
            edge = distance(fp[of], fp[up])
            key = up * 65 + edge
        self.roots = self.levels[0] if n else np.zeros(0, np.int64)
        self.root_of = dict(zip(tree[self.roots].tolist(), self.roots.tolist()))
        child = np.flatnonzero(self.parent >= 0)
        self.children = child[np.lexsort((self.edge[child], self.parent[child]))]
        self.child_key = self.parent[self.children] * 65 + self.edge[self.children]

    def uniform(self, joined: np.ndarray) -> np.ndarray:
        """For each node what all of its subtree is joined with, -1 where that differs."""
        out = joined.copy()
        for level in reversed(self.levels[1:]):
            up = self.parent[level]
            out[up[out[level] != joined[up]]] = -1
        return out

    def search(self, fp: np.ndarray, root: np.ndarray, mine: np.ndarray, joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(search, node) of every hit, without subtrees that are joined with the search already. mine: what each search is joined with, or -1."""
        same = self.uniform(joined)
        ask, node, hits = np.arange(len(fp)), root, []
        while len(ask):
            go = (same[node] < 0) | (same[node] != mine[ask])
            ask, node = ask[go], node[go]
            d = distance(fp[ask], self.fp[node])
            near = d <= RADIUS
            hits.append((ask[near], node[near]))
            first = np.searchsorted(self.child_key, node * 65 + np.maximum(d - RADIUS, 0))
            n = np.searchsorted(self.child_key, node * 65 + np.minimum(d + RADIUS, 64), "right") - first
            ask = np.repeat(ask, n)
            node = self.children[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        return np.concatenate([x[0] for x in hits]), np.concatenate([x[1] for x in hits])


def spanning(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """New labels (the least of each component) once a[i] and b[i] are joined, and which of those pairs are a spanning forest of what they join."""
    taken = []
    label = label.copy()
    live = np.arange(len(a))
    while len(live):
        x, y = label[a[live]], label[b[live]]
        apart = x != y
        live, x, y = live[apart], x[apart], y[apart]
        if not len(live):
            break
        low, high = np.minimum(x, y), np.maximum(x, y)
        top, first = np.unique(high, return_index=True)  # each label hangs itself below one smaller label: no cycle
        taken.append(live[first])
        to = np.arange(len(label))
        to[top] = low[first]
        while True:
            further = to[to]
            if (further == to).all():
                break
            to = further
        label = to[label]
    return label, np.concatenate(taken) if taken else np.zeros(0, np.int64)


def links_of(tree: np.ndarray, fp: np.ndarray, member: np.ndarray, asks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between searches and trees: rows of tree and fingerprint, those with `member` are in the tree, those with `asks` search it."""
    names, number = np.unique(fp, return_inverse=True)
    nodes = np.flatnonzero(member)
    trees = Trees(tree[nodes], fp[nodes])
    label, left, right = np.arange(len(names)), [], []
    ask = np.flatnonzero(asks & np.isin(tree, tree[nodes]))
    roots = np.array([trees.root_of[t] for t in tree[ask].tolist()], np.int64)
    at, size = 0, FIRST_ROUND
    while at < len(ask):
        part, root = ask[at : at + size], roots[at : at + size]
        found, node = trees.search(fp[part], root, label[number[part]], label[number[nodes]])
        a, b = number[part[found]], number[nodes[node]]
        label, kept = spanning(label, a, b)
        left.append(names[a[kept]])
        right.append(names[b[kept]])
        at, size = at + size, min(size * 2, CHUNK)
    empty = np.zeros(0, np.uint64)
    return np.concatenate(left or [empty]), np.concatenate(right or [empty])


def _link(table: pa.Table) -> pa.Table:
    tree, fp, member, asks = (table[c].to_numpy() for c in ("tree", "fp", "member", "asks"))
    a, b = links_of(tree, np.ascontiguousarray(fp).view(np.uint64), member, asks)
    return pa.table([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])


def shards(distinct: DataFrame) -> DataFrame:
    """tree, fp, member and asks, for every tree that a fingerprint is in (member) or searches (asks).

    The sizes of shards are at most 40,960 rows, so they are broadcast.
    """
    runs = [F.struct((F.lit(i << 13) + F.shiftrightunsigned("fp", at).bitwiseAND((1 << bits) - 1)).alias("shard")) for i, (at, bits) in enumerate(RUNS)]
    dealt = distinct.select("fp", F.inline(F.array(*runs)))
    parts = F.ceil(F.count("*") / TREE_NODES).cast("int").alias("parts")
    sized = dealt.join(F.broadcast(dealt.groupBy("shard").agg(parts)), "shard")
    own = F.pmod(F.xxhash64("fp", "shard"), F.col("parts")).cast("int")
    each = sized.select("fp", "shard", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    tree = F.shiftleft(F.col("shard").cast("long"), 44) + F.shiftleft(low.cast("long"), 22) + high
    return each.select(tree.alias("tree"), "fp", (F.col("own") == low).alias("member"), (F.col("own") == high).alias("asks"))


def simhash_components(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint in hex, component_id: the smallest doc_id reachable by links, itself included.

    Only doc_id and text are read. A null text is empty; texts without words have
    fingerprint zero and link like any other. Rows with one doc_id, as all null
    ones (-1), keep their own fingerprints and give a row each. An empty table
    gives no rows.
    """
    printed = write_table(fingerprints(docs), "fingerprints")
    distinct = write_table(printed.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    dealt = write_table(shards(distinct.select("fp")), "shards")
    tasks = max(1, -(-dealt.count() // TASK_ROWS))
    near = dealt.withColumn("task", F.pmod(F.xxhash64("tree"), F.lit(max(tasks, 24)))).groupBy("task").applyInArrow(_link, "a long, b long")
    joined = components(near)
    named = distinct.join(joined, distinct["fp"] == joined["id"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    reached = named.join(named.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("fp", "component_id")
    return printed.join(reached, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
