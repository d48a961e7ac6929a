"""Removal of long repeated byte strings with a range-partitioned, locally sorted suffix array.

A byte goes if a string of `LENGTH` bytes that covers it also starts anywhere
else, in the same document or another, on the input as it is. Strings never
cross documents.

1. Of every window of LENGTH bytes one token of `TOKEN` bytes, the one with the
   least hash, is its leading token; equal windows have equal leading tokens at
   equal places. Windows next to each other mostly share theirs, so about one
   byte in 75 starts one. Leading tokens that occur once (`shared`) cannot lead a
   repeated window, and go.
2. Each that stays brings its segment: the bytes of all windows it leads, at
   most 2 * LENGTH - TOKEN. Of equal whole texts one brings segments; their
   copies are known to be repeats.
3. Spark's sampled splitters range-partition the segments by leading token and
   each partition is sorted by it. Runs of whole tokens are taken together:
   the suffixes of their segments that start a window are sorted by multikey
   quicksort, 8 bytes a round, dropping what has become unique; those that stay
   equal for LENGTH bytes are repeats. As equal leading tokens are in one
   partition, and a run is only cut between tokens, no comparison is missed at
   a boundary.

The segments of one leading token meet in one task. A token with more than
`HOT_SEGMENTS` of them (a passage that much of the table has) is left out of
that: its windows are counted by digest instead, which partial counts reduce
before any shuffle, and the repeated digests' windows are found by a join whose
large side can be split.

Texts are written once with a key of each row, which all steps read. Null texts
are empty; texts under LENGTH bytes keep everything. Repeated rows are copies of
each other, whatever their doc_id; a null one counts as -1. Columns other than
doc_id and text are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import Slice, U, prefix_sums, range_hash, slices
from .sampling import row_id
from .shared import bucket_bits, shared_tokens, text_bytes
from .storage import write_table

LENGTH = 200
TOKEN = 50
SPREAD = LENGTH - TOKEN + 1
#: Segments whose suffixes are sorted together.
RUN_SEGMENTS = 8192
#: Segments of one leading token that one task compares.
HOT_SEGMENTS = 50_000
PLACE_BITS = 24
#: Text for each partition of segments.
PART_BYTES = 16 << 20

SEGMENT_SCHEMA = "rid long, token binary, at int, n int, segment binary"
WINDOW_SCHEMA = "rid long, begin int, digest binary"
SPAN_SCHEMA = "rid long, begin int, stop int"
RESULT_SCHEMA = "rid long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def leading(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Leading tokens: row, place, and the first and last window each leads.

    Places are packed in PLACE_BITS, so a longer text is read in chunks; they
    overlap by LENGTH - 1 bytes, so each window is whole in one of them.
    """
    size = 1 << PLACE_BITS
    if len(data) <= size:
        return _leading(data, offsets)
    begins = range(0, len(data) - LENGTH + 1, size - LENGTH + 1)
    found = [(i, _leading(data[i : i + size], np.clip(offsets - i, 0, min(size, len(data) - i)))) for i in begins]
    row = np.concatenate([x[0] for _, x in found])
    place, first, last = (np.concatenate([x[k] + i for i, x in found]) for k in (1, 2, 3))
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (row[1:] != row[:-1])]))[: len(row)]
    return row[new], place[new], first[new], last[np.append(new[1:], len(row))[: len(new)] - 1]


def _leading(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    none = (np.zeros(0, np.int64),) * 4
    n = len(data) - TOKEN + 1
    if n < SPREAD:
        return none
    sums, at = prefix_sums(data), np.arange(n)
    mask = U((1 << PLACE_BITS) - 1)
    value = (range_hash(sums, at, at + TOKEN) & ~mask) | at.astype(np.uint64)
    blocks = -(-n // SPREAD) * SPREAD
    full = np.full(blocks, ~U(0))
    full[:n] = value
    grid = full.reshape(-1, SPREAD)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: n - SPREAD + 1], ahead[SPREAD - 1 : n])
    start = np.arange(n - SPREAD + 1)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(start)]
    inside = start + LENGTH <= offsets[row + 1]
    start, row, place = start[inside], row[inside], (least[inside] & mask).astype(np.int64)
    if not len(start):
        return none
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (row[1:] != row[:-1])]))
    return row[new], place[new], start[new], start[np.append(new[1:], len(start)) - 1]


def _hashes(data: np.ndarray, place: np.ndarray) -> np.ndarray:
    return range_hash(prefix_sums(data), place, place + TOKEN)


def _extract(s: Slice) -> tuple[np.ndarray, ...]:
    row, place, _, _ = leading(s.data, s.offsets)
    digest = np.frombuffer(b"".join(hashlib.blake2b(s.data[i:j], digest_size=16).digest() for i, j in zip(s.offsets, s.offsets[1:])), np.uint64).reshape(-1, 2)
    return row, _hashes(s.data, place), np.diff(s.offsets), digest[:, 0].copy(), digest[:, 1].copy()


def _led(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[tuple[Slice, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each slice of texts its rids, and row, place, first and last window of the leading tokens that are among the row's `tokens`."""
    lost = U(max(0, 16 - bits))  # low bits of a hash that `shared` does not give back
    for batch in batches:
        rid, lists = batch["rid"].to_numpy(), batch["tokens"]
        offsets = lists.offsets.to_numpy()
        shared = lists.values.to_numpy().view(np.uint64)
        for s in slices(batch["text"]):
            row, place, first, last = leading(s.data, s.offsets)
            token = _hashes(s.data, place) >> lost << lost
            cut = np.searchsorted(row, np.arange(s.last - s.first + 1))
            keep = np.zeros(len(row), bool)
            for r in range(s.last - s.first):
                i, j = cut[r], cut[r + 1]
                keep[i:j] = np.isin(token[i:j], shared[offsets[s.first + r] : offsets[s.first + r + 1]])
            yield s, rid[s.first : s.last], row[keep], place[keep], first[keep], last[keep]


def _segments(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Segments; of equal ones in a slice one, and for all of them rows without a segment, a row for each run of windows that are known to repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, rid, row, place, first, last in _led(batches, bits):
            raw = s.data.tobytes()
            segment = [raw[i : j + LENGTH] for i, j in zip(first.tolist(), last.tolist())]
            seen: dict[tuple[int, bytes], int] = {}
            lead = np.array([seen.setdefault(key, k) for k, key in enumerate(zip((place - first).tolist(), segment))], np.int64)
            many = np.bincount(lead, minlength=len(lead))[lead] > 1 if len(lead) else np.zeros(0, bool)
            known = np.flatnonzero(many)
            new = np.concatenate([[True], (row[known][1:] != row[known][:-1]) | (first[known][1:] > last[known][:-1] + LENGTH)])[: len(known)]
            begin = known[new]
            until = known[np.append(np.flatnonzero(new)[1:], len(known))[: len(begin)] - 1]
            sent = np.flatnonzero(lead == np.arange(len(lead)))
            at = np.concatenate([first[sent], first[begin]]) - s.offsets[np.concatenate([row[sent], row[begin]])]
            n = np.concatenate([last[sent] - first[sent], last[until] - first[begin]]) + 1
            token = [raw[p : p + TOKEN] for p in np.concatenate([place[sent], place[begin]]).tolist()]
            yield pa.RecordBatch.from_arrays([
                pa.array(rid[np.concatenate([row[sent], row[begin]])]), pa.array(token, pa.binary()), pa.array(at.astype(np.int32)),
                pa.array(n.astype(np.int32)), pa.array([segment[k] for k in sent] + [None] * len(begin), pa.binary()),
            ], ["rid", "token", "at", "n", "segment"])

    return run


def _windows(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each window that the tokens lead, by digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, rid, row, _, first, last in _led(batches, bits):
            raw, n = s.data.tobytes(), last - first + 1
            start = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            of = np.repeat(row, n)
            digest = [hashlib.blake2b(raw[i : i + LENGTH], digest_size=16).digest() for i in start.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(rid[of]), pa.array((start - s.offsets[of]).astype(np.int32)), pa.array(digest, pa.binary())], ["rid", "begin", "digest"])

    return run


def repeated(data: np.ndarray, start: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which suffixes equal another for `length` bytes: multikey quicksort by 8-byte symbols.

    All suffixes of a group agree so far. A round looks at the next 8 bytes:
    groups that differ there are sorted and split, suffixes left alone drop out.
    """
    data = np.concatenate([data, np.zeros(8, np.uint8)])
    symbol = np.ndarray((len(data) - 7,), ">u8", data.tobytes(), strides=(1,))
    out = np.zeros(len(start), bool)
    if len(start) < 2:
        return out
    live, group = np.arange(len(start)), np.zeros(len(start), np.int64)
    for depth in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        now = symbol[start[live] + depth].astype(np.uint64)
        same_group = group[1:] == group[:-1]
        if (same_group & (now[1:] != now[:-1])).any():
            mixed = np.zeros(group[-1] + 1, bool)
            mixed[group[1:][same_group & (now[1:] != now[:-1])]] = True
            part = np.flatnonzero(mixed[group])
            order = part[np.lexsort((now[part], group[part]))] if depth else np.argsort(now)
            live[part], now[part] = live[order], now[order]
            split = np.concatenate([[True], (group[1:] != group[:-1]) | (now[1:] != now[:-1])])
            alone = split & np.append(split[1:], True)
            live, split = live[~alone], split[~alone]
            if not len(live):
                return out
            group = np.cumsum(split) - 1
    out[live] = True
    return out


def _spans(rid: np.ndarray, at: np.ndarray, n: np.ndarray, segment: list[bytes]) -> pa.RecordBatch:
    """Bytes of each text that the repeated windows of these segments cover."""
    size = np.array([len(x) for x in segment])
    base = np.cumsum(size) - size
    of = np.repeat(np.arange(len(n)), n)
    inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    hit = np.flatnonzero(repeated(np.frombuffer(b"".join(segment), np.uint8), base[of] + inside))
    of, inside = of[hit], inside[hit]
    new = np.concatenate([[True], (of[1:] != of[:-1]) | (inside[1:] - inside[:-1] > LENGTH)]) if len(of) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(of))[: len(first)] - 1
    begin = at[of[first]] + inside[first]
    return pa.RecordBatch.from_arrays([pa.array(rid[of[first]]), pa.array(begin.astype(np.int32)), pa.array((at[of[first]] + inside[last] + LENGTH).astype(np.int32))], ["rid", "begin", "stop"])


def _sorted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Takes rows in order of their tokens; whole tokens only go into a run."""
    kept: list[pa.RecordBatch] = []
    rows = 0

    def run(table: pa.Table) -> Iterator[pa.RecordBatch]:
        known = table.filter(pc.is_null(table["segment"]))
        begin = known["at"].to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(known["rid"].to_numpy()), pa.array(begin), pa.array(begin + known["n"].to_numpy() - 1 + np.int32(LENGTH))], ["rid", "begin", "stop"])
        table = table.filter(pc.is_valid(table["segment"]))
        if table.num_rows:
            yield _spans(table["rid"].to_numpy(), table["at"].to_numpy().astype(np.int64), table["n"].to_numpy().astype(np.int64), table["segment"].to_pylist())

    for batch in batches:
        for i in range(0, batch.num_rows, RUN_SEGMENTS):
            kept.append(batch.slice(i, RUN_SEGMENTS))
            rows += kept[-1].num_rows
            if rows < RUN_SEGMENTS:
                continue
            table = pa.Table.from_batches(kept)
            token = table["token"].to_pylist()
            cut = next((k for k in range(rows - 1, 0, -1) if token[k] != token[k - 1]), 0)
            if cut:
                yield from run(table.slice(0, cut))
                kept = table.slice(cut).to_batches()
                rows -= cut
    if rows:
        yield from run(pa.Table.from_batches(kept))


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each text without its spans."""
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for text, spans in zip(batch["text"], batch["spans"]):
            raw, kept, end, runs = text.as_py().encode(), [], -1, 0
            for begin, stop in sorted((x["begin"], len(raw) if x["stop"] < 0 else x["stop"]) for x in spans.as_py()):
                if begin > end:
                    kept.append(raw[max(end, 0) : begin])
                    runs += 1
                end = max(end, stop)
            kept.append(raw[max(end, 0) :])
            left = b"".join(kept)
            for column, value in zip(out, (len(raw) - len(left), runs, hashlib.sha256(left).hexdigest(), left)):
                column.append(value)
        yield pa.RecordBatch.from_arrays([batch["rid"], *(pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.binary())))], ["rid", "n_removed", "n_spans", "kept_sha256", "kept"])


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes left, null where all are) for every row of docs."""
    rows = write_table(docs.select(F.monotonically_increasing_id().alias("rid"), row_id(), F.coalesce("text", F.lit("")).alias("text")), "rows")
    size = text_bytes(rows)
    bits = max(4, bucket_bits(size) - 3)
    named = rows.select(F.col("rid").alias("doc_id"), "text")
    sets = write_table(shared_tokens(named, _extract, lambda n, shared: shared > 0, bits), "leading").withColumnRenamed("doc_id", "rid")
    held = sets.where("tokens is not null")
    groups = held.groupBy("n", "d0", "d1").agg(F.min("rid").alias("rep"), F.count("*").alias("copies")).where("copies > 1")
    copies = write_table(held.select("rid", "n", "d0", "d1").join(groups, ["n", "d0", "d1"]).select("rid", "rep"), "copies")
    bring = held.select("rid", "tokens").join(copies.where("rid <> rep").select("rid"), "rid", "left_anti")
    each = bring.select("rid", F.explode(F.array_distinct("tokens")).alias("token"))
    hot = write_table(each.groupBy("token").count().where(F.col("count") > HOT_SEGMENTS).select("token"), "hot")
    texts, found = rows.select("rid", "text"), []
    if hot.limit(1).count():
        apart = each.join(hot.withColumn("hot", F.lit(True)), "token", "left").groupBy("rid")
        sides = apart.agg(F.collect_list(F.when(F.col("hot").isNull(), F.col("token"))).alias("tokens"), F.collect_list(F.when(F.col("hot"), F.col("token"))).alias("hot"))
        sides = write_table(sides, "sides")
        bring = sides.where(F.size("tokens") > 0).select("rid", "tokens")
        windows = write_table(texts.join(sides.where(F.size("hot") > 0).select("rid", F.col("hot").alias("tokens")), "rid").mapInArrow(_windows(bits), WINDOW_SCHEMA), "windows")
        again = windows.groupBy("digest").count().where("count > 1").select("digest")
        found.append(windows.join(again, "digest", "left_semi").select("rid", "begin", (F.col("begin") + LENGTH).alias("stop")))
    segments = texts.join(bring, "rid").mapInArrow(_segments(bits), SEGMENT_SCHEMA)
    parts = max(8, -(-size // PART_BYTES))
    spans = segments.repartitionByRange(parts, "token").sortWithinPartitions("token").mapInArrow(_sorted_runs, SPAN_SCHEMA)
    for more in [copies.select("rid", F.lit(0).alias("begin"), F.lit(-1).alias("stop")), *found]:
        spans = spans.unionByName(more)
    spans = write_table(spans, "spans")
    per = spans.groupBy("rid").agg(F.collect_list(F.struct("begin", "stop")).alias("spans"))
    changed = rows.select("rid", "text").join(per, "rid").mapInArrow(_apply, RESULT_SCHEMA)
    base = rows.select("rid", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    none = F.lit(0).cast("long")
    return base.join(changed, "rid", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"), "kept"
    )
