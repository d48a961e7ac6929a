"""N-gram Jaccard self-join with token-combination prefixes.

Sets are the distinct 5-word shingles of a text. Two sets x, y with Jaccard at
least 4/5 share at least o(x) = ceil(4/5 |x|) tokens.

1. Tokens that no second document has are found (`shared`). They come first in
   the global order, so they use up prefixes: a document with fewer than o(x)
   shared tokens links to nothing and goes no further. This is exact.
2. Equal sets become one representative.
3. Representatives with an equal minhash are compared with a few pivots of
   their group. That only finds most links early: large groups of near copies
   become one component without all their pairs.
4. Of the rest, only links between different components matter. A token counts
   as rare for them if all its documents are in one component. The prefix of
   a document is extended until the classes in it guarantee a common signature:
   with n_k tokens of class k in it, sum over k of max(0, n_k - k + 1) must reach
   |x| - o(x) + 1. Rare tokens are class 1 and are indexed singly, frequent ones
   are class 2 or 3 and are indexed by all their combinations of 2 or 3, which
   few documents share.
5. Documents that share a signature are gone through by size, so that only sizes
   and numbers of tokens from there on that allow a link ever meet; a sketch of
   their tokens (parities of 128 classes) must allow it too. What is left is
   verified on the shared tokens, and all links form the components. A signature
   with more than `GROUP_ROWS` documents is dealt to many tasks in blocks.

Why a common signature is sure: take the document whose prefix ends first in
the global order, x. All tokens of its prefix that y has are in y's prefix. If
they shared no signature they would share at most k - 1 of the n_k, so y would
lack |x| - o(x) + 1 of x's tokens, too many to be linked. (Sets of up to 3 tokens
link only with equal sets.)

Null and wordless texts have no shingles and are their own components. A text
of 1 to 4 words has one shingle, all of it. Links are between sets, whatever the
doc_ids of their rows: null ones count as -1 and repeated ones may have several
texts. Rows come once each. Tokens are compared by the 48 bits of hash, and the
bucket's beside them, that `shared` gives back. Columns other than doc_id and text
are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .kernels import ASCII_LOWER, ORDER_CODE, U, Slice, mix, prefix_sums, range_hash, row_sums, shingles, words
from .shared import bucket_bits, shared_tokens, text_bytes
from .storage import write_table

WIDTH = 5
#: Link when 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Documents a token may be in to be indexed singly, and by pairs.
SINGLE_DF, PAIR_DF = 2048, 65_536
MINHASHES = 3
#: Rows of one minhash group that one task compares; larger groups are salted.
GROUP_ROWS = 4096
PIVOTS = 8
#: Tasks over which a group's rows are spread while they learn its size.
LANES = 16


def needed(n: np.ndarray | int, percent: int = PERCENT):
    """Least number of common tokens of a set of n and any set it links with."""
    return -(-n * percent // 100)


def shingle_sets(width: int) -> Callable[[Slice], tuple[np.ndarray, ...]]:
    def extract(s: Slice) -> tuple[np.ndarray, ...]:
        low = ASCII_LOWER[s.data]
        w = words(low, s.offsets)
        row, token = shingles(range_hash(prefix_sums(low), w.start, w.end), w.first, width)
        order = np.lexsort((token, row))
        row, token = row[order], token[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (row[1:] != row[:-1])
        row, token = row[new], token[new]
        m = s.last - s.first
        first = np.searchsorted(row, np.arange(m + 1))
        return row, token, np.diff(first), row_sums(mix(token ^ ORDER_CODE[20]), first), row_sums(mix(token ^ ORDER_CODE[21]), first)

    return extract


def linked(common: int, n: int, m: int, percent: int = PERCENT) -> bool:
    return 100 * common >= percent * (n + m - common)


def _minhashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch["tokens"]
        offsets = lists.offsets.to_numpy()
        token = lists.values.to_numpy()[offsets[0] : offsets[-1]].view(np.uint64)
        keys = [np.minimum.reduceat(mix(token ^ ORDER_CODE[30 + k]), offsets[:-1] - offsets[0]).view(np.int64) for k in range(MINHASHES)] if len(lists) else []
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*keys, np.zeros(0, np.int64)])), pa.array(np.tile(batch["id"].to_numpy(), MINHASHES))], ["key", "id"])


def _stars(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows come sorted by group, those with fewest tokens of their own (the least edited) first; each is compared with the group's pivots, or becomes one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, pivots = None, []
        for batch in batches:
            a, b = [], []
            lists = batch["tokens"]
            offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            for i, (key, salt, n, who) in enumerate(zip(*(batch[c].to_pylist() for c in ("key", "salt", "n", "id")))):
                own = flat[offsets[i] : offsets[i + 1]]
                if (key, salt) != group:
                    group, pivots = (key, salt), []
                for other, m, theirs in pivots:
                    if min(n, m) * 100 >= percent * max(n, m) and linked(len(np.intersect1d(own, theirs, assume_unique=True)), n, m, percent):
                        a.append(who)
                        b.append(other)
                        break
                else:
                    if len(pivots) < PIVOTS:
                        pivots.append((who, n, own.copy()))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def early_links(reps: DataFrame, percent: int = PERCENT) -> DataFrame:
    """a, b: verified links between representatives and pivots of their minhash groups."""
    keys = reps.select("id", "tokens").mapInArrow(_minhashes, "key long, id long")
    groups = keys.groupBy("key").count().where("count > 1").select("key", F.ceil(F.col("count") / GROUP_ROWS).alias("salts"))
    groups = groups.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(LANES - 1))))
    dealt = keys.withColumn("lane", F.pmod(F.xxhash64("id", F.lit("lane")), F.lit(LANES)).cast("int")).join(groups, ["key", "lane"]).select("key", F.pmod(F.xxhash64("id"), F.col("salts")).alias("salt"), "id")
    rows = reps.join(dealt, "id").select("key", "salt", "n", "id", (F.col("n") - F.size("tokens")).alias("own"), "tokens")
    return rows.repartition("key", "salt").sortWithinPartitions("key", "salt", "own", "n", "id").mapInArrow(_stars(percent), "a long, b long")


def signatures(token: np.ndarray, df: np.ndarray, n: int, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of a set of n tokens, and the most it can share with a set that it first meets there.

    `token` are those that can link, rarest first; the others come before them.
    Tokens ahead of the first common one are not shared, but for one of class 2
    ahead of class 3.
    """
    goal, spent, m = n - needed(n, percent) + 1 - (n - len(token)), 0, len(token)
    classes = np.where(df <= SINGLE_DF, 1, np.where(df <= PAIR_DF, 2, 3))
    own: dict[int, list[tuple[int, int]]] = {1: [], 2: [], 3: []}
    for place, (t, k) in enumerate(zip(token.tolist(), classes.tolist())):
        if spent >= goal:
            break
        own[k].append((t, m - place + (k == 3)))
        spent += len(own[k]) >= k
    made, most = [np.array([t for t, _ in own[1]], np.int64)], [np.array([x for _, x in own[1]], np.int64)]
    for k in (2, 3):
        if len(own[k]) >= k:
            picks = np.array(list(combinations(range(len(own[k])), k)))
            values = np.sort(np.array([t for t, _ in own[k]], np.int64)[picks], axis=1).view(np.uint64)
            made.append(mix((values * ORDER_CODE[40 : 40 + k]).sum(axis=1) + ORDER_CODE[50 + k : 51 + k]).view(np.int64))
            most.append(np.array([x for _, x in own[k]], np.int64)[picks[:, 0]])
    return np.concatenate(made), np.concatenate(most)


def sketch(token: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each run of tokens, the parity of how many are in each of 128 classes."""
    word = mix(token.astype(np.int64).view(np.uint64) ^ ORDER_CODE[55])
    bit = U(1) << (word & U(63))
    low = word & U(64) > 0
    out = []
    for mask in (low, ~low):
        sums = np.zeros(len(token) + 1, np.uint64)
        np.bitwise_xor.accumulate(np.where(mask, bit, U(0)), out=sums[1:])
        out.append((sums[first[1:]] ^ sums[first[:-1]]).view(np.int64))
    return out[0], out[1]


def _index(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["ranked"]
            first = lists.offsets.to_numpy()
            token, df = (pc.struct_field(lists.values, k).to_numpy() for k in ("t", "df"))
            who, n, comp = (batch[c].to_numpy() for c in ("id", "n", "comp"))
            s0, s1 = sketch(token[first[0] : first[-1]], first - first[0])
            made = [signatures(token[i:j], df[i:j], m, percent) for i, j, m in zip(first, first[1:], n.tolist())]
            size = [len(sig) for sig, _ in made]
            if not sum(size):
                continue
            columns = [np.concatenate([sig for sig, _ in made]), np.repeat(who, size), np.repeat(n, size), np.repeat(comp, size), np.concatenate([most for _, most in made])]
            columns += [np.repeat(x, size) for x in (np.diff(first).astype(np.int64), s0, s1)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["sig", "id", "n", "comp", "most", "k", "s0", "s1"])

    return run


INDEX_SCHEMA = "sig long, id long, n long, comp long, most long, k long, s0 long, s1 long"


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of some thousand rows that end with a group's last row."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch[k].to_numpy() for k in keys]
        new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0))
        cut = int(new[-1]) + 1 if len(new) else 0
        if not cut and kept and any(kept[-1][k][kept[-1].num_rows - 1].as_py() != batch[k][0].as_py() for k in keys):
            yield pa.Table.from_batches(kept)
            kept = []
        if cut:
            yield pa.Table.from_batches([*kept, batch.slice(0, cut)])
            kept = []
        kept.append(batch.slice(cut))
    if kept:
        yield pa.Table.from_batches(kept)


def _meet(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Candidates among rows that come sorted by group (sig, i, j) and then by n: each with those after it as long as sizes allow."""
    whole = 100 + percent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, ["sig", "i", "j"]):
            sig, i, j, side, who, n, comp, most, k = (table[c].to_numpy() for c in ("sig", "i", "j", "side", "id", "n", "comp", "most", "k"))
            s0, s1 = (table[c].to_numpy().view(np.uint64) for c in ("s0", "s1"))
            x, step, a, b = np.arange(len(n)), 0, [], []
            while len(x):
                step += 1
                x = x[x + step < len(n)]
                y = x + step
                on = (sig[x] == sig[y]) & (i[x] == i[y]) & (j[x] == j[y]) & (n[y] * percent <= n[x] * 100) & ((n[x] + n[y]) * percent <= most[x] * whole)
                x, y = x[on], y[on]
                need = -(-(n[x] + n[y]) * percent // whole)
                able = (comp[x] != comp[y]) & ((side[x] != side[y]) | (i[x] == j[x])) & (np.minimum(most[x], most[y]) >= need)
                p, q, need = x[able], y[able], need[able]
                near = np.bitwise_count(s0[p] ^ s0[q]).astype(np.int64) + np.bitwise_count(s1[p] ^ s1[q]) <= k[p] + k[q] - 2 * need
                a.append(np.minimum(who[p], who[q])[near])
                b.append(np.maximum(who[p], who[q])[near])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b)], ["a", "b"])

    return run


def candidates(index: DataFrame, percent: int = PERCENT) -> DataFrame:
    """a, b: documents of different components that share a signature, where sizes, places and sketches allow a link; each once."""
    sized = index.groupBy("sig").agg(F.count("*").alias("rows"), F.min("n").alias("least"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    crossing = sized.where("rows > 1 and lo < hi").select("sig", "least", F.ceil(F.col("rows") / GROUP_ROWS).cast("int").alias("blocks"))
    rows = index.join(crossing, "sig").where(F.col("most") * (100 + percent) >= (F.col("n") + F.col("least")) * percent)
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    dealt = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(*index.columns, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    return dealt.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j", "n", "id").mapInArrow(_meet(percent), "a long, b long").distinct()


def cross_links(reps: DataFrame, comp: DataFrame, percent: int = PERCENT) -> DataFrame:
    """a, b: every link between representatives of different components."""
    held = reps.join(comp, "id", "left").select("id", "n", "tokens", F.coalesce("component", "id").alias("comp"))
    each = held.select("id", "n", "comp", F.explode("tokens").alias("t"))
    crossing = each.groupBy("t").agg(F.count("*").alias("df"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("t", "df")
    ranked = each.join(crossing, "t").groupBy("id", "n", "comp").agg(F.sort_array(F.collect_list(F.struct("df", "t"))).alias("ranked"))
    able = ranked.where((F.col("n") > 3) & (F.size("ranked") * 100 >= F.col("n") * percent))
    index = write_table(able.mapInArrow(_index(percent), INDEX_SCHEMA), "signatures")
    pairs = write_table(candidates(index, percent), "candidates")
    a = reps.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    b = reps.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    both = pairs.join(a, "a").join(b, "b").withColumn("common", F.size(F.array_intersect("ta", "tb")))
    return both.where(F.col("common") * 100 >= percent * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b")


def jaccard_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs."""
    def able(n: np.ndarray, shared: np.ndarray) -> np.ndarray:
        return (n > 0) & (shared >= needed(n, percent))

    sets = write_table(shared_tokens(docs, shingle_sets(width), able, bucket_bits(text_bytes(docs))).withColumn("row", F.monotonically_increasing_id()), "sets")
    linkable = sets.where("tokens is not null")
    alike = linkable.groupBy("n", "d0", "d1").agg(F.min("doc_id").alias("least"), F.min("row").alias("id"))
    alike = write_table(alike, "alike")
    reps = write_table(linkable.join(alike.select("id"), linkable["row"] == alike["id"]).select("id", "n", "tokens"), "representatives")
    early = write_table(early_links(reps, percent), "early-links")
    late = cross_links(reps, components(early), percent)
    comp = components(early.unionByName(late))
    named = alike.join(comp, "id", "left").select("n", "d0", "d1", "least", F.coalesce("component", "id").alias("component"))
    first = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(first, "component").select("n", "d0", "d1", "component_id")
    out = sets.select("doc_id", "n", "d0", "d1").join(named, ["n", "d0", "d1"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
