"""Which tokens of each document occur anywhere else: the common first step of the operators on repeats.

Most tokens (shingles, substrings) of a corpus occur once and can link nothing.
This finds the others without a row a token. Each slice of documents sorts its
token hashes and sends, for each hash bucket, one packed row of 64-bit entries:
up to 48 hash bits beside the bucket's, and the document's place in the slice. The
more buckets, the more text a slice has, so a row holds many tokens. A token
that a slice holds twice is known to be shared there and then: the slice keeps
its entries and sends one marker, so a token that a third of all documents have
costs its bucket one entry a slice. A bucket sends back which of a slice's
entries it saw twice, and the slice's rows are put together again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import Slice, U, slices
from .sampling import row_id

#: Text that is read at once; and for each bucket, at most this many in all, what a slice has. Rows of a slice.
READ_BYTES = 2 << 20
SENT_BYTES, MOST_SENT = 1 << 16, 24 << 20
SLICE_ROWS = 60_000
BUCKET_BYTES = 8 << 20
MARKER = 0xFFFF

DEALT_SCHEMA = "grp long, slice long, bucket int, payload binary"
BACK_SCHEMA = "slice long, bucket int, payload binary"
SHARED_SCHEMA = "doc_id long, n long, d0 long, d1 long, tokens array<long>"

#: Of a slice: row and hash of each token, and for each row its number of tokens and a 128-bit digest.
Extract = Callable[[Slice], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def bucket_bits(size: int) -> int:
    """log2 of the number of buckets for so many bytes of text: about one for each 8 MB, 16 at least."""
    return max(4, int(np.ceil(np.log2(max(1, size / BUCKET_BYTES)))))


def token_id(bucket: np.ndarray | int, entries: np.ndarray, bits: int) -> np.ndarray:
    """The token's hash back from its bucket and its entry."""
    return (np.asarray(bucket).astype(np.uint64) << U(64 - bits)) | ((entries & ~U(MARKER)) >> U(bits))


def _pack(row: np.ndarray, token: np.ndarray, bits: int) -> tuple[list[tuple[int, bytes]], list[tuple[int, bytes]]]:
    """(bucket, entries) to send, and those known to be shared within the slice."""
    order = np.argsort(token)
    token, row = token[order], row[order].astype(np.uint64)
    same = token[1:] == token[:-1]
    again = np.zeros(len(token), bool)
    again[1:] |= same
    again[:-1] |= same
    leads = again.copy()
    leads[1:] &= ~same
    entries = ((token << U(bits)) & ~U(MARKER)) | np.where(leads, U(MARKER), row)
    sent = ~again | leads

    def split(mask: np.ndarray, values: np.ndarray) -> list[tuple[int, bytes]]:
        bucket, values = (token[mask] >> U(64 - bits)).astype(np.int64), values[mask]
        first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
        return [(b, values[i:j].tobytes()) for b, i, j in zip(bucket[first].tolist(), first, np.append(first[1:], len(bucket)))]

    return split(sent, entries), split(again, ((token << U(bits)) & ~U(MARKER)) | row)


def _deal(extract: Extract, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    most = min(MOST_SENT, max(READ_BYTES, SENT_BYTES << bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, rows, size = TaskContext.get().partitionId(), 0, 0, 0
        heads, row_of, token_of = [], [], []

        def give() -> Iterator[pa.RecordBatch]:
            nonlocal made, rows, size
            name = (part << 24) | made
            made, rows, size = made + 1, 0, 0
            sent, local = _pack(np.concatenate(row_of), np.concatenate(token_of), bits)
            out = [(-name - 1, -1, np.concatenate(heads, axis=1).tobytes()), *((-name - 1, b, p) for b, p in local), *((b, b, p) for b, p in sent)]
            for x in (heads, row_of, token_of):
                x.clear()
            for i in range(0, len(out), 4096):
                grp, bucket, payload = zip(*out[i : i + 4096])
                yield pa.RecordBatch.from_arrays([pa.array(grp, pa.int64()), pa.array([name] * len(grp), pa.int64()), pa.array(bucket, pa.int32()), pa.array(payload, pa.binary())], ["grp", "slice", "bucket", "payload"])

        for batch in batches:
            ids = batch["doc_id"].to_numpy(zero_copy_only=False)
            for i in range(0, batch.num_rows, SLICE_ROWS):
                for s in slices(batch["text"].slice(i, SLICE_ROWS), READ_BYTES):
                    if rows and (rows + s.last - s.first > SLICE_ROWS or size > most):
                        yield from give()
                    row, token, n, d0, d1 = extract(s)
                    heads.append(np.stack([np.ascontiguousarray(x).astype(np.int64) for x in (ids[i + s.first : i + s.last], n, d0.view(np.int64), d1.view(np.int64))]))
                    row_of.append(row + rows)
                    token_of.append(token)
                    rows, size = rows + s.last - s.first, size + len(s.data)
        if rows:
            yield from give()

    return run


def _match(table: pa.Table) -> pa.Table:
    if table["grp"][0].as_py() < 0:
        return table.select(["slice", "bucket", "payload"])
    payload = table["payload"].to_pylist()
    entries = np.frombuffer(b"".join(payload), np.uint64)
    token, place = entries >> U(16), entries & U(MARKER)
    ordered = np.sort(token)
    shared = np.unique(np.concatenate([ordered[1:][ordered[1:] == ordered[:-1]], token[place == MARKER]]))
    if not len(shared):
        return table.select(["slice", "bucket", "payload"]).slice(0, 0)
    at = np.minimum(np.searchsorted(shared, token), len(shared) - 1)
    keep = (shared[at] == token) & (place != MARKER)
    cut = np.concatenate([[0], np.cumsum([len(p) // 8 for p in payload])])
    out = [entries[i:j][keep[i:j]].tobytes() for i, j in zip(cut, cut[1:])]
    return table.select(["slice", "bucket"]).append_column("payload", pa.array(out, pa.binary()))


def _merge(bits: int, keep: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        bucket, payload = table["bucket"].to_numpy(), table["payload"].to_pylist()
        head = np.frombuffer(payload[int(np.flatnonzero(bucket == -1)[0])], np.int64).reshape(4, -1)
        parts = [(b, np.frombuffer(p, np.uint64)) for b, p in zip(bucket, payload) if b >= 0 and p]
        place = np.concatenate([(e & U(MARKER)).astype(np.int64) for _, e in parts] or [np.zeros(0, np.int64)])
        token = np.concatenate([token_id(int(b), e, bits) for b, e in parts] or [np.zeros(0, np.uint64)])
        order = np.lexsort((token, place))
        place, token = place[order], token[order].view(np.int64)
        m = head.shape[1]
        count = np.bincount(place, minlength=m)
        kept = keep(head[1], count)
        held = kept[place]
        offsets = np.concatenate([[0], np.cumsum(np.where(kept, count, 0))]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(token[held], pa.int64()), mask=pa.array(~kept))
        return pa.table([pa.array(x) for x in head] + [lists], names=["doc_id", "n", "d0", "d1", "tokens"])

    return run


def shared_tokens(docs: DataFrame, extract: Extract, keep: Callable[[np.ndarray, np.ndarray], np.ndarray], bits: int) -> DataFrame:
    """One row a document: doc_id, n, its digest, and its tokens that occur more than once in the table.

    keep(n, shared): the rows whose tokens are wanted; for others they are null.
    A token that a document holds twice is given twice, in order.
    """
    dealt = docs.select(row_id(), "text").mapInArrow(_deal(extract, bits), DEALT_SCHEMA)
    back = dealt.groupBy("grp").applyInArrow(_match, BACK_SCHEMA)
    return back.groupBy("slice").applyInArrow(_merge(bits, keep), SHARED_SCHEMA)
