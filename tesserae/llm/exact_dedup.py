"""Exact dedup against a minimal perfect hash over historical distinct digests.

The history's distinct digests are dealt into buckets by digest. Each bucket
becomes one index row: a minimal perfect hash (levelled bit arrays with ranks)
whose slots hold the whole 32-byte digest, the winner's doc_id and the group's
size. A document is routed to its digest's bucket, hashed to a slot, and counts
as a repeat only if all 32 digest bytes in the slot agree. Documents that are
not in the history are grouped among themselves. A table that is its own history
has in the index the digests that several of its rows share.

Texts are equal when they agree after `[\\x20\\x09-\\x0D]` is deleted; null
counts as empty. Of equal texts the row with most code points in its original
text stays, then the smallest doc_id. Repeated rows with one doc_id are rows of
their own in group_size; kept is true for each of them if their doc_id is the
winner. Other columns are ignored, whatever their names. An empty table gives
an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import U, mix
from .sampling import row_id
from .storage import write_table

#: Digests a bucket holds on average; rows that one lookup group gets at most on average.
BUCKET_KEYS = 8192
HOT_ROWS = 4 * BUCKET_KEYS
SPACE = r"[\x20\x09-\x0D]+"

INDEX_SCHEMA = "bucket long, levels array<int>, bits binary, digests binary, winners binary, sizes binary"
FOUND_SCHEMA = "doc_id long, digest binary, n_chars long, member boolean, keep_id long, group_size long"


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the text without white space, code points of the text, and a number that tells rows apart once this is written."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        row_id(),
        F.unhex(F.sha2(F.regexp_replace(text, SPACE, ""), 256)).alias("digest"),
        F.char_length(text).cast("long").alias("n_chars"),
        F.monotonically_increasing_id().alias("salt"),
    )


def winners(marked: DataFrame) -> DataFrame:
    """One row a digest: who stays and how many rows share it. Partial aggregates leave each map task once a digest."""
    best = F.min(F.struct((-F.col("n_chars")).alias("n"), "doc_id"))
    return marked.groupBy("digest").agg(best.alias("best"), F.count("*").alias("group_size")).select("digest", F.col("best.doc_id").alias("keep_id"), "group_size")


def _level_hash(words: np.ndarray, level: int, size: int) -> np.ndarray:
    return mix(words[:, 0] ^ mix(words[:, 1] + U((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))) % U(size)


def build_mphf(words: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Level sizes, their bit arrays end to end, and the slot of each key (0..n-1, each once).

    A key takes the first level at which no other remaining key has its
    position. `words` are distinct digests as rows of four 64-bit words.
    """
    sizes: list[int] = []
    bits: list[np.ndarray] = []
    place = np.full(len(words), -1, np.int64)
    left, base = np.arange(len(words)), 0
    while len(left):
        size = 2 * len(left) + 1
        at = _level_hash(words[left], len(sizes), size).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        place[left[alone[at]]] = base + at[alone[at]]
        left = left[~alone[at]]
        sizes.append(size)
        bits.append(alone)
        base += size
    flat = np.concatenate(bits) if bits else np.zeros(0, bool)
    return sizes, flat, (np.cumsum(flat) - 1)[place] if len(words) else place


def probe_mphf(sizes: list[int], flat: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The slot each key hashes to, -1 where it falls through all levels. Only a compare of digests tells membership."""
    rank, slot = np.cumsum(flat) - 1, np.full(len(words), -1, np.int64)
    left, base = np.arange(len(words)), 0
    for level, size in enumerate(sizes):
        at = base + _level_hash(words[left], level, size).astype(np.int64)
        hit = flat[at]
        slot[left[hit]] = rank[at[hit]]
        left = left[~hit]
        base += size
    return slot


def _words(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, 4)


def _build(table: pa.Table) -> pa.Table:
    words = _words(table["digest"])
    sizes, flat, slot = build_mphf(words)
    order = np.argsort(slot)
    fields = (words[order], table["keep_id"].to_numpy()[order], table["group_size"].to_numpy()[order])
    return pa.table({
        "bucket": pa.array([table["bucket"][0].as_py()], pa.int64()), "levels": pa.array([sizes], pa.list_(pa.int32())), "bits": pa.array([np.packbits(flat).tobytes()], pa.binary()),
        **{k: pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for k, v in zip(("digests", "winners", "sizes"), fields)},
    })


def _lookup(docs: pa.Table, index: pa.Table) -> pa.Table:
    n = docs.num_rows
    member, keep, size = np.zeros(n, bool), np.full(n, -1, np.int64), np.zeros(n, np.int64)
    if n and index.num_rows:
        row = index.slice(0, 1).to_pylist()[0]
        words, held = _words(docs["digest"]), np.frombuffer(row["digests"], np.uint64).reshape(-1, 4)
        flat = np.unpackbits(np.frombuffer(row["bits"], np.uint8))[: sum(row["levels"])].astype(bool)
        slot = probe_mphf(row["levels"], flat, words)
        member = (slot >= 0) & (held[slot] == words).all(axis=1)
        keep = np.where(member, np.frombuffer(row["winners"], np.int64)[slot], -1)
        size = np.where(member, np.frombuffer(row["sizes"], np.int64)[slot], 0)
    return pa.table({"doc_id": docs["doc_id"], "digest": docs["digest"].cast(pa.binary()), "n_chars": docs["n_chars"], "member": member, "keep_id": keep, "group_size": size})


def build_index(best: DataFrame, n_buckets: int) -> DataFrame:
    """One row a bucket from a table of winners (one row a digest, so no bucket is hot)."""
    bucket = F.pmod(F.xxhash64("digest"), F.lit(n_buckets)).alias("bucket")
    return best.select(bucket, "digest", "keep_id", "group_size").groupBy("bucket").applyInArrow(_build, INDEX_SCHEMA)


def lookup(marked: DataFrame, index: DataFrame, n_buckets: int) -> DataFrame:
    """Each row of `marked` with member, keep_id and group_size from the index.

    A bucket with many rows (a digest that much of the table shares) is split
    over several copies of its index row, as many as its rows ask for. Rows are
    dealt by their written salt, so a task that runs again deals them alike.
    """
    bucket = F.pmod(F.xxhash64("digest"), F.lit(n_buckets)).alias("bucket")
    rows = marked.select(bucket, "doc_id", "digest", "n_chars", "salt")
    hot = rows.groupBy("bucket").count().where(F.col("count") > HOT_ROWS).select("bucket", F.ceil(F.col("count") / BUCKET_KEYS).cast("int").alias("copies"))
    copies = F.coalesce("copies", F.lit(1))
    left = rows.join(hot, "bucket", "left").withColumn("copy", F.pmod(F.xxhash64("salt"), copies).cast("int")).drop("copies", "salt")
    right = index.join(hot, "bucket", "left").withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1))).drop("copies")
    return left.groupBy("bucket", "copy").cogroup(right.groupBy("bucket", "copy")).applyInArrow(_lookup, FOUND_SCHEMA)


def exact_dedup(docs: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs.

    history: documents seen before, with doc_id and text; rows that it holds are
    repeats (kept false, keep_id and group_size from it). Without one, docs is
    its own history, and of the rows that share a digest the winner is kept.
    """
    marked = write_table(digests(docs), "digests")
    past = marked if history is None else write_table(digests(history), "history")
    n_buckets = max(1, -(-past.count() // BUCKET_KEYS))
    best = winners(past) if history is not None else winners(past).where("group_size > 1")
    found = write_table(lookup(marked, build_index(best, n_buckets), n_buckets), "found")
    stays = F.lit(False) if history is not None else F.col("doc_id") == F.col("keep_id")
    repeats = found.where("member").select("doc_id", "digest", "keep_id", "group_size", stays.alias("kept"))
    fresh = found.where(~F.col("member")).select("doc_id", "digest", "n_chars")
    own = fresh.join(winners(fresh), "digest").select("doc_id", "digest", "keep_id", "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"))
    return repeats.unionByName(own).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
