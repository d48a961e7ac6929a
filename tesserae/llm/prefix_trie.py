"""The trie of shared conversation prefixes, from fingerprints that compose.

A rebuilt conversation is the head of its base followed by its own turns after
their head. Its texts are never put together. A run of turns has as fingerprint
the sum of turn * BASE**place, modulo a prime, and its length; two runs make one
by shifting the second sum by the first length, so the prefix sums of stored
conversations give every prefix of every rebuilt one: the base's sum, plus the
difference of two own sums, shifted. This also makes prefix sums of one very long
conversation: turns are range-partitioned, each task sums its part, and parts are
composed from a row each.

Prefixes with one depth and fingerprint are a node. That they are equal is
verified: every row refers to its stored last turn by the SHA-256 of its role and
text, and in each node all references and all parents' fingerprints must be the
same; then by induction all turns are. Should a group fail, everything is done
again with the next base.

A node's smallest member owns it, so each conversation owns a chain of nodes that
ends where it ends. Sums over a subtree need no walk: they are sums over a node's
members of what each owns, less what the node's owner owns above it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kernels import U, mix
from .storage import write_table

PRIME = (1 << 61) - 1
#: Bases of the fingerprints, tried in this order.
BASES = (1144066129832467843, 1902348712034985671, 873459801237465013, 2046781234098761357)
#: Ids of a node's ends that are joined in one row.
SEGMENT = 1 << 16
REFERENCE = ("r0", "r1", "r2", "r3")
PREFIXES = "c long, pid int, at long, s long, before long, chars long, r0 long, r1 long, r2 long, r3 long"


def mulmod(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2**61 - 1, of numbers below it."""
    low31, low30 = U((1 << 31) - 1), U((1 << 30) - 1)
    ah, al, bh, bl = a >> U(31), a & low31, b >> U(31), b & low31
    mid, low = ah * bl + al * bh, al * bl
    return reduced(((ah * bh) << U(1)) + (mid >> U(30)) + ((mid & low30) << U(31)) + (low & U(PRIME)) + (low >> U(61)))


def reduced(x: np.ndarray) -> np.ndarray:
    x = (x & U(PRIME)) + (x >> U(61))
    return np.where(x >= U(PRIME), x - U(PRIME), x)


def _powers(base: int, n: int) -> np.ndarray:
    """BASE**i for i < n, by doubling."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, mulmod(out, np.full(len(out), pow(base, len(out), PRIME), np.uint64))])
    return out[:n]


def _sums(term: np.ndarray) -> np.ndarray:
    """0 and the running sums of term, modulo the prime."""
    high, low = (np.concatenate([[U(0)], np.cumsum(x, dtype=np.uint64)]) for x in (term >> U(31), term & U((1 << 31) - 1)))
    return reduced(mulmod(reduced(high), np.full(len(high), 1 << 31, np.uint64)) + reduced(low))


def _prefix_sums(base: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, now, done, carried = TaskContext.get().partitionId(), None, 0, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            c = batch["c"].to_numpy()
            digest = np.frombuffer(b"".join(batch["digest"].to_pylist()), np.uint64).reshape(n, 4)
            start = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
            size = np.diff(np.append(start, n))
            same = bool(c[0] == now)
            at = np.arange(n) - np.repeat(start, size) + 1
            power = _powers(base, int(size.max()) + 1)[at]
            if same:
                at[: size[0]] += done
                power[: size[0]] = mulmod(power[: size[0]], np.full(size[0], pow(base, done, PRIME), np.uint64))
            total = _sums(mulmod(reduced(mix(digest[:, 0] ^ U(base)) & U(PRIME)), power))
            less = np.repeat(total[start], size)
            more = np.zeros(n, np.uint64)
            if same:
                more[: size[0]] = carried
            s, before = (reduced(x + U(PRIME) - less + more) for x in (total[1:], total[:-1]))
            now, done, carried = int(c[-1]), int(at[-1]), int(s[-1])
            columns = [batch["c"], pa.array(np.full(n, pid, np.int32)), *(pa.array(x.astype(np.int64)) for x in (at, s, before)), batch["chars"], *(pa.array(digest[:, i].view(np.int64)) for i in range(4))]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in PREFIXES.split(", ")])

    return run


def _carries(base: int):
    """For conversations of several tasks: what stands before each task's part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, int, int, int]] = []
            for row in batch.to_pylist():
                length = total = 0
                for part in row["parts"]:
                    power = pow(base, length, PRIME)
                    out.append((row["c"], part["pid"], length, total, power))
                    length, total = length + part["n"], (total + power * part["s"]) % PRIME
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 5, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["c", "pid", "length", "total", "power"])

    return run


def _plus_times(a: Column, b: Column, c: Column) -> Column:
    """a + b * c modulo the prime."""
    whole = "decimal(19,0)"
    return ((a.cast(whole) + b.cast(whole) * c.cast(whole)) % F.lit(PRIME).cast(whole)).cast("long")


def _ordered(turns: DataFrame) -> DataFrame:
    """c, digest and length of every turn, in order within and across partitions."""
    zero = F.lit("")
    rows = turns.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(-1)).alias("c"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), zero).alias("role"),
        F.coalesce(F.col("text").cast("string"), zero).alias("text"), F.monotonically_increasing_id().alias("row"),
    )
    order = [F.col("c"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("row")]
    content = F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select("c", F.unhex(F.sha2(content.cast("binary"), 256)).alias("digest"), F.char_length("text").cast("long").alias("chars"))


def _positions(turns: DataFrame, base: int) -> DataFrame:
    """Every turn of every stored conversation with its place and the sums up to and before it."""
    prefixes = write_table(_ordered(turns).mapInArrow(_prefix_sums(base), PREFIXES), "prefixes")
    parts = prefixes.groupBy("c", "pid").agg(F.max("at").alias("n"), F.max_by("s", "at").alias("s"))
    several = parts.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("pid", "n", "s"))).alias("parts")).where(F.size("parts") > 1)  # a row a task at most
    carries = several.mapInArrow(_carries(base), "c long, pid int, length long, total long, power long")
    both = prefixes.join(F.broadcast(carries), ["c", "pid"], "left")  # at most two rows a task
    whole = [F.when(F.col("power").isNull(), F.col(x)).otherwise(_plus_times(F.col("total"), F.col("power"), F.col(x))).alias(x) for x in ("s", "before")]
    return both.select("c", (F.col("at") + F.coalesce("length", F.lit(0))).alias("at"), *whole, "chars", *REFERENCE)


def _paths(turns: DataFrame, base: int, block: int, most: int) -> DataFrame:
    """A row for each prefix of each rebuilt conversation: c, depth, fp, parent's pfp, chars and reference of its last turn, whether it is the whole."""
    held = _positions(turns, base)
    early = F.when(F.col("at") < most, F.struct("at", "s", "before", "chars", *REFERENCE))
    heads = write_table(held.groupBy("c").agg(F.max("at").alias("n"), F.sort_array(F.collect_list(early)).alias("head")), "heads")  # below `most` turns of each
    bases = heads.select(F.col("c").alias("base"), F.col("n").alias("base_n"), F.col("head").alias("base_head"))
    h = (F.crc32(F.col("c").cast("string").cast("binary")) % most).cast("int")
    sum_at = lambda head, k: F.coalesce(F.get(F.col(head), k - 1)["s"], F.lit(0))
    shifts = F.array(*(F.lit(pow(base, -k, PRIME)) for k in range(most)))
    both = heads.withColumns({"h": h, "base": F.col("c") - F.col("c") % block}).join(bases, "base", "left")
    m = F.least("h", F.coalesce("base_n", F.lit(0))).cast("int")
    convs = both.select("c", "h", m.alias("m"), "n", "head", "base_head").select(
        "c", "h", "m", (F.col("m") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("total"), sum_at("base_head", F.col("m")).alias("start"),
        sum_at("head", F.least("h", "n").cast("int")).alias("skipped"), F.get(shifts, F.col("h") - F.col("m")).alias("shift"), F.slice(F.coalesce("base_head", F.array()), 1, F.col("m")).alias("base_head"),
    )
    convs = write_table(convs, "rebuilt")
    placed = lambda x: _plus_times(F.col("start"), F.col("shift"), F.pmod(F.col(x) - F.col("skipped"), F.lit(PRIME)))
    own = held.join(convs.drop("base_head"), "c").where("at > h")
    own = own.select("c", (F.col("m") + F.col("at") - F.col("h")).alias("depth"), placed("s").alias("fp"), placed("before").alias("pfp"), "chars", *REFERENCE, "total")
    head = convs.select("c", "total", F.inline("base_head")).select("c", F.col("at").alias("depth"), F.col("s").alias("fp"), F.col("before").alias("pfp"), "chars", *REFERENCE, "total")
    none = F.lit(None).cast("long")
    root = convs.select("c", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("fp"), none.alias("pfp"), F.lit(0).cast("long").alias("chars"), *(none.alias(r) for r in REFERENCE), "total")
    return own.unionByName(head).unionByName(root).withColumn("whole", F.col("depth") == F.col("total")).drop("total")


def _nodes(paths: DataFrame) -> DataFrame:
    """A row a node; `differ` where its members' last turns or parents aren't the same."""
    same = ("pfp", *REFERENCE)
    grouped = paths.groupBy("depth", "fp").agg(F.min("c").alias("conv_id"), F.count("*").alias("n"), F.max("chars").alias("chars"), *(f(x).alias(f"{p}_{x}") for x in same for p, f in (("min", F.min), ("max", F.max))))
    differ = F.lit(False)
    for x in same:
        differ = differ | F.coalesce(F.col(f"min_{x}") != F.col(f"max_{x}"), F.lit(False))
    return grouped.select("depth", "fp", F.col("min_pfp").alias("pfp"), "conv_id", "n", ((F.col("n") - 1) * F.col("chars")).alias("saved"), differ.alias("differ"))


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of a node's ends, joined: rows of a run within a batch make one text."""
    pid, made = TaskContext.get().partitionId(), 0
    for batch in batches:
        for i in range(0, batch.num_rows, SEGMENT):
            part = batch.slice(i, SEGMENT)
            depth, fp = part["depth"].to_numpy(), part["fp"].to_numpy()
            start = np.flatnonzero(np.concatenate([[True], (depth[1:] != depth[:-1]) | (fp[1:] != fp[:-1])]))
            ids = pa.ListArray.from_arrays(pa.array(np.append(start, len(fp)).astype(np.int32)), pc.cast(part["c"], pa.string()))
            place = (pid << 40) + made + np.arange(len(start))
            made += len(start)
            yield pa.RecordBatch.from_arrays([pa.array(depth[start]), pa.array(fp[start]), pa.array(place), pc.binary_join(ids, ",")], ["depth", "fp", "place", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's segments in turn; one state is held at a time."""
    now, state = None, None
    for batch in batches:
        out = []
        for depth, fp, ids in zip(*(batch[x].to_pylist() for x in ("depth", "fp", "ids"))):
            if (depth, fp) == now:
                state.update(b",")
            else:
                if now:
                    out.append((*now, state.hexdigest()))
                now, state = (depth, fp), hashlib.sha256()
            state.update(ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["depth", "fp", "ends_sha256"])
    if now:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, state.hexdigest())], ["depth", "fp", "ends_sha256"])


def _ends(paths: DataFrame) -> DataFrame:
    """The digest of every node's ends. A digest is sequential, so a node's ids pass one task, in segments and without being held."""
    ends = paths.where("whole").select("depth", "fp", "c").repartitionByRange("depth", "fp", "c").sortWithinPartitions("depth", "fp", "c")
    segments = ends.mapInArrow(_segments, "depth long, fp long, place long, ids string")
    return segments.repartition("depth", "fp").sortWithinPartitions("depth", "fp", "place").mapInArrow(_digests, "depth long, fp long, ends_sha256 string")


def _above(nodes: DataFrame) -> DataFrame:
    """For nodes of several members, what their owner's nodes above them save: running sums by depth, in two levels, as a chain may be long."""
    chain = nodes.where("n > 1").select("depth", "fp", "conv_id", "saved").repartitionByRange("conv_id", "depth").withColumn("pid", F.spark_partition_id())
    chain = write_table(chain, "chains")
    ahead = Window.unboundedPreceding, -1
    zero = F.lit(0)
    inside = F.sum("saved").over(Window.partitionBy("conv_id", "pid").orderBy("depth").rowsBetween(*ahead))
    parts = chain.groupBy("conv_id", "pid").agg(F.sum("saved").alias("part"))
    carried = parts.select("conv_id", "pid", F.sum("part").over(Window.partitionBy("conv_id").orderBy("pid").rowsBetween(*ahead)).alias("carried"))
    return chain.withColumn("inside", inside).join(carried, ["conv_id", "pid"]).select("depth", "fp", (F.coalesce("inside", zero) + F.coalesce("carried", zero)).alias("above"))


def prefix_trie(turns: DataFrame, block: int = 100, most: int = 6) -> DataFrame:
    """A row for each distinct prefix of the rebuilt conversations.

    A conversation c is rebuilt from the first h turns of conversation
    c - c % block and its own turns after its first h, where h is the CRC-32 of c
    modulo `most`. conv_id: the smallest member. saved_tokens: what keeping each
    turn of the subtree once saves, in code points.

    Turns go by turn, null first, then by role and text; rows that repeat are
    turns of their own. Null role and text are empty, a null conv_id counts as
    -1, texts may be of any length. Only conv_id, turn, role and text are read.
    An empty table has no conversations, and gives no rows.
    """
    for base in BASES:
        paths = write_table(_paths(turns, base, block, most), "paths")
        nodes = write_table(_nodes(paths), "nodes")
        if not nodes.where("differ").limit(1).count():
            break
    else:
        raise ValueError("prefixes that differ have one fingerprint with every base")
    zero = F.lit(0).cast("long")
    node = ["depth", "fp"]
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pfp").alias("fp")).agg(F.count("*").alias("n_children"))
    nodes = write_table(nodes.join(children, node, "left").withColumn("n_children", F.coalesce("n_children", zero)), "nodes")
    owned = nodes.groupBy(F.col("conv_id").alias("c")).agg(F.max((F.col("n_children") == 0).cast("long")).alias("leaf"), F.sum("saved").alias("owned"))
    subtree = paths.select("c", *node).join(owned, "c").groupBy(*node).agg(F.sum("leaf").alias("n_leaves"), F.sum("owned").alias("owned"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("fp").alias("pfp"), F.col("conv_id").alias("parent_conv_id"))
    full = nodes.join(subtree, node).join(_above(nodes), node, "left").join(_ends(paths), node, "left").join(parents, ["depth", "pfp"], "left")
    saved = F.when(F.col("n") > 1, F.col("owned") - F.coalesce("above", zero)).otherwise(zero)
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return full.select("conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", "n_leaves", saved.alias("saved_tokens"), F.coalesce("ends_sha256", nothing).alias("ends_sha256"))
