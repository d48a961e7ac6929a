"""Hard negatives by Fagin's threshold algorithm over blocks of vectors.

Vectors become integers, so scores (inner products) are exact. Rows are dealt
to blocks by a hash of their key. In a block every dimension has its rows
sorted by value. An anchor goes down all lists at once, from the large end
where its own component is positive and from the small end where it is
negative; each row that it meets is scored in full. No row not met yet can
score more than the threshold: the anchor times the values that the lists
stand at. A window of scores is done when the threshold is strictly below its
k-th best score, as ties go to the smaller id, or below the window itself.

The algorithm runs twice: for each anchor's positives, with one open window over
rows of its own label, and for the negatives, with a window for each positive
over rows of other labels. Anchors come in blocks too, so a task holds one block
of each. Each gives at most k rows a window; Spark ranks those, with a group
limit ahead of the shuffle. More blocks change the work, never the result.

Rows without a label, a vector, or with a null or non-finite component take no
part. A null id counts as -1; rows with one id are rows of their own, and any of
them that is not the anchor's own row is an "other" row. Missing components of a
shorter vector count as 0; an empty vector scores 0. Components beyond 2**24
after scaling count as that, so sums of up to 16,384 products fit a long. Other columns are ignored; an empty table, or one
without anchors, gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import write_table

BLOCK_ROWS, BLOCK_ANCHORS = 4096, 512
#: The first step goes down this share of each list; each later one twice as far as the last.
FIRST_SHARE = 1 / 32
CLAMP = 1 << 24
FOUND = "akey long, anchor_id long, p int, positive_id long, positive_score long, negative_id long, negative_score long"


def vectors(rows: DataFrame, vec_id: str, vector: str, label: Column, anchor: Column, scale: int) -> DataFrame:
    """key, vec_id, label, anchor and the vector in integers, for rows that take part; written, so that keys stay."""
    kept = rows.select(F.coalesce(F.col(vec_id), F.lit(-1)).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    most = float(CLAMP)
    whole = F.transform("v", lambda x: F.floor(F.greatest(F.lit(-most), F.least(F.lit(most), x * scale))).cast("int"))
    return write_table(kept.where(F.col("label").isNotNull() & F.col("v").isNotNull() & finite).select(F.monotonically_increasing_id().alias("key"), "vec_id", "label", "anchor", whole.alias("v")), "vectors")


def matrix(column: pa.ChunkedArray, width: int = 0) -> np.ndarray:
    """The vectors as rows, filled up with 0 to the longest, or to width."""
    column = column.combine_chunks()
    flat, size = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)
    width = max(width, int(size.max(initial=0)))
    if len(size) and (size == width).all():
        return flat.reshape(len(size), width).astype(np.int64)
    out = np.zeros((len(size), width), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def exact_type(most: int, other: int, width: int) -> type:
    """The fastest type in which sums of `width` products are exact."""
    bound = most * other * max(1, width)
    return np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64


class Lists:
    """A block: its rows by id, and for each dimension the rows from its largest value to its smallest."""

    def __init__(self, values: np.ndarray, most: int) -> None:
        self.kind = exact_type(int(np.abs(values).max(initial=0)), most, values.shape[1])
        self.values = values.astype(self.kind)
        self.order = np.argsort(-values, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.values, self.order, axis=0)

    def best(self, anchor: np.ndarray, allowed: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window low..high the rows and scores of the k best allowed ones, best first."""
        m = len(self.values)
        a = anchor.astype(self.kind)
        up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        met, score = np.zeros(m, bool), np.zeros(m, np.int64)
        at, step, left = 0, max(8, int(m * FIRST_SHARE)), [w for w in range(len(low)) if low[w] <= high[w]]
        found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(low)
        while left:
            to = min(m, at + step)
            new = np.zeros(m, bool)
            new[self.order[at:to, up]] = True
            new[self.order[m - to : m - at, down]] = True
            new = np.flatnonzero(new & ~met)
            met[new] = True
            score[new] = self.values[new] @ a
            at, step = to, step * 2
            over = at >= m or met.all()
            if over and not met.all():  # an anchor of zeros has no list to go down; all rows score 0
                met[:] = True
            threshold = None if over else int(self.sorted[at - 1, up] @ a[up]) + int(self.sorted[m - at, down] @ a[down])
            rows = np.flatnonzero(met & allowed)
            of = score[rows]
            for w in list(left):
                inside = (of >= low[w]) & (of <= high[w])
                if not over and threshold >= low[w] and np.count_nonzero(inside) < k:
                    continue
                at_rows, at_score = rows[inside], of[inside]
                if len(at_rows) > k:
                    last = np.partition(at_score, len(at_score) - k)[len(at_score) - k]
                    above, ties = np.flatnonzero(at_score > last), np.flatnonzero(at_score == last)
                    picked = np.concatenate([above, ties[: k - len(above)]])  # rows are in order of id: the smaller of equals is ahead
                    at_rows, at_score = at_rows[picked], at_score[picked]
                if over or threshold < low[w] or threshold < at_score.min():
                    by = np.lexsort((at_rows, -at_score))
                    found[w] = (at_rows[by], at_score[by])
                    left.remove(w)
        return found


def _search(k: int, same_label: bool, shares: tuple[int, int]) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """Of a block of rows and one of anchors: each anchor's k best in every window."""

    def run(key: tuple, block: pa.Table, anchors: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if block.num_rows and anchors.num_rows:
            block = block.sort_by([("vec_id", "ascending"), ("key", "ascending")])
            asked = matrix(anchors["asked"])
            held = matrix(block["v"], asked.shape[1])
            asked = np.pad(asked, ((0, 0), (0, held.shape[1] - asked.shape[1])))
            lists = Lists(held, int(np.abs(asked).max(initial=0)))
            keys, ids, labels = (block[c].to_numpy() for c in ("key", "vec_id", "label"))
            for a, row in zip(asked, anchors.drop_columns("asked").to_pylist()):
                if same_label:
                    allowed = (labels == row["own_label"]) & (keys != row["akey"])
                    windows = [(0, None, None)]
                    low, high = np.array([np.iinfo(np.int64).min]), np.array([np.iinfo(np.int64).max])
                else:
                    allowed = labels != row["own_label"]
                    windows = [(w["p"], w["positive_id"], w["positive_score"]) for w in row["windows"]]
                    low, high = (np.array([f(w[2]) for w in windows], np.int64) for f in (lambda s: -(-s * shares[0] // 100), lambda s: s * shares[1] // 100))
                for (p, pid, ps), (rows, score) in zip(windows, lists.best(a, allowed, low, high, k)):
                    out += [(row["akey"], row["anchor_id"], p, pid, ps, i, s) for i, s in zip(ids[rows].tolist(), score.tolist())]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        columns = list(zip(*out)) or [[]] * 7
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names=[x.split()[0] for x in FOUND.split(", ")])

    return run


def _blocks(count: int, size: int) -> int:
    return max(1, -(-count // size))


def _ranked(found: DataFrame, k: int, *key: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("negative_score"), "negative_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, label: Column, anchor: Column, vec_id: str = "vec_id", vector: str = "embedding", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    An anchor's positives are the best `positives` other rows of its label. For
    each, the best `negatives` rows of other labels that score from `low` to
    `high` percent of it. scale: components become floor(scale * x).
    """
    held = vectors(rows, vec_id, vector, label, anchor, scale)
    count, asked = held.agg(F.count("*"), F.count_if("anchor")).first()
    b, a = _blocks(count, BLOCK_ROWS), _blocks(asked, BLOCK_ANCHORS)
    block = F.pmod(F.xxhash64("key"), F.lit(b)).alias("b")
    each_block, each_anchors = F.explode(F.sequence(F.lit(0), F.lit(b - 1))).alias("to_b"), F.explode(F.sequence(F.lit(0), F.lit(a - 1))).alias("a")
    dealt = held.select("key", "vec_id", "label", "v", block.cast("int").alias("b"), each_anchors)
    part = F.pmod(F.xxhash64("key", F.lit("anchor")), F.lit(a)).cast("int").alias("of_a")
    anchors = held.where("anchor").select(F.col("key").alias("akey"), F.col("vec_id").alias("anchor_id"), F.col("label").alias("own_label"), F.col("v").alias("asked"), part)

    def search(asked: DataFrame, k: int, same_label: bool) -> DataFrame:
        return dealt.groupBy("a", "b").cogroup(asked.select("*", each_block).groupBy("of_a", "to_b")).applyInArrow(_search(k, same_label, (low, high)), FOUND)

    best = _ranked(search(anchors, positives, True), positives, "akey")
    window = F.struct(F.col("rank").alias("p"), F.col("negative_id").alias("positive_id"), F.col("negative_score").alias("positive_score"))
    windows = write_table(best.groupBy("akey").agg(F.collect_list(window).alias("windows")), "windows")  # at most `positives` an anchor
    found = search(anchors.join(windows, "akey"), negatives, False)
    return _ranked(found, negatives, "akey", "p").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
