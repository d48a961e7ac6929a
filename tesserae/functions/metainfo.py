"""Metainfo documents: a bencode codec, info hashes, and their column functions.

The format is a byte grammar that built-in functions can't parse, so decoding
and encoding run as Arrow UDFs, a batch at a time. Canonical documents are decoded
from the marks of a scan of the whole batch; bad ones, and those in another order or
notation, one by one. All else on decoded documents is column expressions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BinaryType

from ..schemas import DECODED
from .scan import DICT, END, LIST, NUMBER, TEXT, Marks, scan, spans

PIECE_HASH = 20
#: Document keys by field, where they differ.
DOCUMENT_KEYS = {"announce_list": "announce-list", "creation_date": "creation date", "created_by": "created by"}
INFO_KEYS = {"piece_length": "piece length", "root_hash": "root hash"}
DOCUMENT_FIELDS = ("announce", "nodes", "encoding", "httpseeds", "announce_list", "creation_date", "comment", "created_by")
INFO_FIELDS = ("name", "pieces", "piece_length", "md5sum", "length", "files", "private", "path", "root_hash", "source")


class MetainfoError(ValueError):
    """A document that is not valid metainfo."""


def bencode(value: Any) -> bytes:
    """Canonical bytes of ints, bytes, text, lists and dicts; null members are left out and keys sorted as bytes."""
    if isinstance(value, bool):
        value = int(value)
    if isinstance(value, int):
        return b"i%de" % value
    if isinstance(value, str):
        value = value.encode()
    if isinstance(value, (bytes, bytearray)):
        return b"%d:%b" % (len(value), value)
    if isinstance(value, dict):
        pairs = sorted((k.encode() if isinstance(k, str) else k, v) for k, v in value.items() if v is not None)
        return b"d%be" % b"".join(bencode(k) + bencode(v) for k, v in pairs)
    if isinstance(value, (list, tuple)):
        return b"l%be" % b"".join(map(bencode, value))
    raise MetainfoError(f"can't encode {type(value).__name__}")


def bdecode(data: bytes) -> Any:
    """The one value that data holds; keys and strings stay bytes. Iterative, so nesting can't exhaust the stack."""
    open_values: list[list[Any]] = []  # containers being read: [is_dict, items]
    at, n = 0, len(data)
    while True:
        if at >= n:
            raise MetainfoError("ends early")
        lead = data[at : at + 1]
        if lead in b"dl":
            open_values.append([lead == b"d", []])
            at += 1
            continue
        if lead == b"e":
            if not open_values:
                raise MetainfoError("unexpected end mark")
            is_dict, items = open_values.pop()
            at += 1
            if is_dict:
                if len(items) % 2 or not all(isinstance(k, bytes) for k in items[::2]):
                    raise MetainfoError("bad dictionary")
                value: Any = dict(zip(items[::2], items[1::2]))
            else:
                value = items
        elif lead == b"i":
            stop = data.find(b"e", at)
            digits = data[at + 1 : stop] if stop > 0 else b""
            if not digits.removeprefix(b"-").isdigit():
                raise MetainfoError("bad integer")
            value, at = int(digits), stop + 1
        else:
            stop = data.find(b":", at, at + 20)
            if stop < 0 or not data[at:stop].isdigit():
                raise MetainfoError("bad string length")
            size = int(data[at:stop])
            value, at = data[stop + 1 : stop + 1 + size], stop + 1 + size
            if at > n:
                raise MetainfoError("string ends early")
        if not open_values:
            if at != n:
                raise MetainfoError("data after the end")
            return value
        open_values[-1][1].append(value)


def _text(value: Any) -> str | None:
    return None if value is None else value.decode("utf-8") if isinstance(value, bytes) else _bad("text")


def _number(value: Any, bits: int = 64) -> int | None:
    """A number that fits its column."""
    return value if value is None or isinstance(value, int) and -1 << bits - 1 <= value < 1 << bits - 1 else _bad(f"a number of {bits} bits")


def _texts(value: Any) -> list[str] | None:
    return None if value is None else [_text(x) for x in value] if isinstance(value, list) else _bad("a list")


def _bad(what: str) -> Any:
    raise MetainfoError(f"{what} expected")


def _info(raw: dict[bytes, Any]) -> dict[str, Any]:
    get = lambda field: raw.get(INFO_KEYS.get(field, field).encode())
    files = get("files")
    info = {
        "name": _text(get("name")), "pieces": get("pieces"), "piece_length": _number(get("piece_length")), "md5sum": _text(get("md5sum")), "length": _number(get("length")),
        "files": None if files is None else [{"path": _texts(f.get(b"path")), "length": _number(f.get(b"length")), "md5sum": _text(f.get(b"md5sum"))} for f in files],
        "private": _number(get("private"), 16), "path": _texts(get("path")), "root_hash": _text(get("root_hash")), "source": _text(get("source")),
    }
    if info["name"] is None or info["piece_length"] is None:
        raise MetainfoError("name and piece length are needed")
    if info["pieces"] is not None and len(info["pieces"]) % PIECE_HASH:
        raise MetainfoError("pieces is no list of 20-byte hashes")
    return info


def info_dict(info: dict[str, Any]) -> dict[str, Any]:
    """The info dictionary of known fields, under the document's keys."""
    out = {INFO_KEYS.get(f, f): info.get(f) for f in INFO_FIELDS}
    if out["files"] is not None:
        out["files"] = [{"path": list(f["path"]), "length": f["length"], "md5sum": f["md5sum"]} for f in out["files"]]
    return out


def decode(data: bytes) -> dict[str, Any]:
    """A document as DECODED: its fields, the hash of its known info fields and that of its whole info value."""
    out = {"error": None, "info_hash": None, "original_info_hash": None, "torrent": None}
    try:
        raw = bdecode(bytes(data))
        if not isinstance(raw, dict) or not isinstance(raw.get(b"info"), dict):
            raise MetainfoError("no info dictionary")
        get = lambda field: raw.get(DOCUMENT_KEYS.get(field, field).encode())
        nodes, tiers, info = get("nodes"), get("announce_list"), _info(raw[b"info"])
        torrent = {
            "announce": _text(get("announce")), "nodes": None if nodes is None else [{"ip": _text(a), "port": _number(b)} for a, b in nodes], "encoding": _text(get("encoding")),
            "httpseeds": _texts(get("httpseeds")), "announce_list": None if tiers is None else [_texts(t) for t in tiers], "creation_date": _number(get("creation_date")),
            "comment": _text(get("comment")), "created_by": _text(get("created_by")), "info": info,
        }
        out |= {"torrent": torrent, "info_hash": hashlib.sha1(bencode(info_dict(info))).hexdigest(), "original_info_hash": hashlib.sha1(bencode(raw[b"info"])).hexdigest()}
    except (MetainfoError, ValueError, TypeError, AttributeError) as e:
        out["error"] = str(e)
    return out


def encode(torrent: dict[str, Any]) -> bytes:
    """The bytes of a document of METAINFO's fields."""
    out = {DOCUMENT_KEYS.get(f, f): torrent.get(f) for f in DOCUMENT_FIELDS}
    if out["nodes"] is not None:
        out["nodes"] = [[n["ip"], n["port"]] for n in out["nodes"]]
    return bencode(out | {"info": info_dict(torrent["info"])})


def synthetic(uuid: str) -> dict[str, Any]:
    """A small one-file document made from a UUID: content is the UUID and a newline."""
    content = f"{uuid}\n".encode()
    info = dict.fromkeys(INFO_FIELDS) | {"name": f"file-{uuid}.txt", "length": len(content), "piece_length": 16384, "pieces": hashlib.sha1(content).digest()}
    return dict.fromkeys(DOCUMENT_FIELDS) | {"info": info}


class _Batch:
    """Fields of canonical documents as Arrow arrays, from their marks. What has a wrong type is noted in `odd`."""

    def __init__(self, data: np.ndarray, marks: Marks, taken: np.ndarray) -> None:
        self.data, self.m, self.odd = data, marks, np.zeros(len(taken), bool)
        roots = np.flatnonzero((marks.parent < 0) & taken[marks.doc] & (marks.kind != END))
        self.docs = np.full(len(taken), -1)
        self.docs[marks.doc[roots]] = roots
        self.odd[marks.doc[roots[marks.kind[roots] != DICT]]] = True

    def of_kind(self, tokens: np.ndarray, kind: int) -> np.ndarray:
        """The tokens; those of another kind make their documents odd and count as missing."""
        wrong = (tokens >= 0) & (self.m.kind[tokens] != kind)
        self.odd[self.m.doc[tokens[wrong]]] = True
        return np.where(wrong, -1, tokens)

    def members(self, dicts: np.ndarray, names: tuple[str, ...]) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """For each name the value that each dictionary has (-1: none), and the keys that have no such name."""
        row = np.full(len(self.m.start) + 1, -1)
        row[dicts[dicts >= 0]] = np.flatnonzero(dicts >= 0)
        keys = np.flatnonzero((self.m.parent >= 0) & (self.m.place % 2 == 0) & (row[self.m.parent] >= 0) & (self.m.kind != END))
        code = pc.index_in(spans(self.data, self.m.low[keys], self.m.high[keys]), pa.array([n.encode() for n in names], pa.binary())).fill_null(-1).to_numpy(zero_copy_only=False)
        out = {}
        for i, name in enumerate(names):
            out[name] = np.full(len(dicts), -1)
            mine = keys[code == i]
            out[name][row[self.m.parent[mine]]] = self.m.next[mine]
        return out, keys[code < 0]

    def bytes(self, tokens: np.ndarray) -> pa.Array:
        tokens = self.of_kind(tokens, TEXT)
        return spans(self.data, self.m.low[tokens], self.m.high[tokens], tokens < 0) if len(self.m.low) else pa.nulls(len(tokens), pa.binary())

    def text(self, tokens: np.ndarray) -> pa.Array:
        raw = self.bytes(tokens)
        try:
            return raw.cast(pa.string())
        except pa.ArrowInvalid:
            for i, value in enumerate(raw.to_pylist()):
                try:
                    (value or b"").decode()
                except UnicodeDecodeError:
                    self.odd[self.m.doc[tokens[i]]] = True
            return pa.nulls(len(tokens), pa.string())

    def number(self, tokens: np.ndarray, kind: pa.DataType = pa.int64()) -> pa.Array:
        tokens = self.of_kind(tokens, NUMBER)
        value, none = (self.m.low[tokens] if len(self.m.low) else np.zeros(len(tokens), np.int64)), tokens < 0
        if kind == pa.int16():
            wide = ~none & (np.abs(value) >= 1 << 15)
            self.odd[self.m.doc[tokens[wide]]] = True
            value = np.where(wide, 0, value)
        return pa.array(value, mask=none).cast(kind)

    def items(self, lists: np.ndarray, make: Callable[[np.ndarray], pa.Array]) -> pa.Array:
        """A list array: make gives the array of all items."""
        lists = self.of_kind(lists, LIST)
        inside = np.zeros(len(self.m.start) + 1, bool)
        inside[lists[lists >= 0]] = True
        tokens = np.flatnonzero((self.m.parent >= 0) & inside[self.m.parent] & (self.m.kind != END))
        size = np.where(lists >= 0, self.m.children[lists], 0) if len(self.m.start) else np.zeros(len(lists), np.int64)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), make(tokens), mask=pa.array(lists < 0))

    def texts(self, lists: np.ndarray) -> pa.Array:
        return self.items(lists, self.text)

    def pairs(self, lists: np.ndarray) -> pa.Array:
        """Lists of a text and a number, as structs."""
        lists = self.of_kind(lists, LIST)
        self.odd[self.m.doc[lists[(lists >= 0) & (self.m.children[lists] != 2)]]] = True
        first = np.full(len(self.m.start) + 1, -1)
        heads = np.flatnonzero((self.m.parent >= 0) & (self.m.place == 0) & (self.m.kind != END))
        first[self.m.parent[heads]] = heads
        ip = np.where(lists >= 0, first[lists], -1)
        return pa.StructArray.from_arrays([self.text(ip), self.number(np.where(ip >= 0, self.m.next[ip], -1))], ["ip", "port"])

    def files(self, dicts: np.ndarray) -> pa.Array:
        fields, unknown = self.members(self.of_kind(dicts, DICT), ("path", "length", "md5sum"))
        self.unknown.append(unknown)
        return pa.StructArray.from_arrays([self.texts(fields["path"]), self.number(fields["length"]), self.text(fields["md5sum"])], ["path", "length", "md5sum"])

    def decoded(self) -> pa.Array:
        """DECODED of every document; only those that are taken and not odd count."""
        self.unknown: list[np.ndarray] = []
        f, _ = self.members(self.docs, (*(DOCUMENT_KEYS.get(x, x) for x in DOCUMENT_FIELDS), "info"))
        infos = self.of_kind(f["info"], DICT)
        g, unknown = self.members(infos, tuple(INFO_KEYS.get(x, x) for x in INFO_FIELDS))
        self.unknown.append(unknown)
        needed = (self.docs >= 0) & ((infos < 0) | (g["name"] < 0) | (g["piece length"] < 0))
        self.odd |= needed
        pieces = g["pieces"]
        size = self.m.high[pieces] - self.m.low[pieces] if len(self.m.low) else np.zeros(len(pieces), np.int64)
        self.odd |= (pieces >= 0) & (size % PIECE_HASH != 0)
        torrent = to_arrow_type(DECODED).field("torrent").type
        lone = pa.StructArray.from_arrays([
            self.text(g["name"]), self.bytes(pieces), self.number(g["piece length"]), self.text(g["md5sum"]), self.number(g["length"]), self.items(g["files"], self.files),
            self.number(g["private"], pa.int16()), self.texts(g["path"]), self.text(g["root hash"]), self.text(g["source"]),
        ], INFO_FIELDS).cast(torrent.field("info").type)
        whole = pa.StructArray.from_arrays([
            self.text(f["announce"]), self.items(f["nodes"], self.pairs), self.text(f["encoding"]), self.texts(f["httpseeds"]), self.items(f["announce-list"], self.texts),
            self.number(f["creation date"]), self.text(f["comment"]), self.text(f["created by"]), lone,
        ], [*DOCUMENT_FIELDS, "info"]).cast(torrent)
        known, original = self.hashes(infos)
        return pa.StructArray.from_arrays([pa.nulls(len(self.docs), pa.string()), known, original, whole], fields=list(to_arrow_type(DECODED)))

    def hashes(self, infos: np.ndarray) -> tuple[pa.Array, pa.Array]:
        """Of the span of each info value: without its unknown members, and whole. Canonical bytes stay so when members are left out."""
        raw, cuts = memoryview(self.data), {}
        for key in np.sort(np.concatenate(self.unknown)).tolist():
            cuts.setdefault(int(self.m.doc[key]), []).append((int(self.m.start[key]), int(self.m.end[self.m.next[key]])))
        known, original = [], []
        for doc, token in enumerate(infos.tolist()):
            if token < 0:
                known.append(None)
                original.append(None)
                continue
            at, end = int(self.m.start[token]), int(self.m.end[token])
            original.append(hashlib.sha1(raw[at:end]).hexdigest())
            if doc in cuts:
                state = hashlib.sha1()
                for low, high in cuts[doc]:
                    state.update(raw[at:low])
                    at = high
                state.update(raw[at:end])
            known.append(state.hexdigest() if doc in cuts else original[-1])
        return pa.array(known, pa.string()), pa.array(original, pa.string())


def decode_all(data: pa.Array) -> pa.Array:
    """DECODED of each document: the scan's for canonical ones of the right types, decode()'s for all others."""
    if isinstance(data, pa.ChunkedArray):
        data = data.combine_chunks()
    data = data.cast(pa.binary()).fill_null(b"")
    offsets = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1].astype(np.int64) if len(data) else np.zeros(1, np.int64)
    buffer = np.frombuffer(data.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(data) else np.zeros(0, np.uint8)
    marks, taken = scan(buffer, offsets - offsets[0])
    fast = None
    while fast is None and taken.any():
        batch = _Batch(buffer, marks, taken)
        fast = batch.decoded()
        if batch.odd.any():
            taken, fast = taken & ~batch.odd, None
    kind = to_arrow_type(DECODED)
    slow = np.flatnonzero(~taken)
    rest = pa.array([decode(data[i].as_py()) for i in slow.tolist()], kind)
    if fast is None:
        return rest
    if not len(slow):
        return fast
    where = np.arange(len(taken))
    where[slow] = len(taken) + np.arange(len(slow))
    return pa.concat_arrays([fast, rest]).take(pa.array(where))


@F.arrow_udf(DECODED)
def decode_metainfo(data: pa.Array) -> pa.Array:
    return decode_all(data)


@F.arrow_udf(BinaryType())
def encode_metainfo(torrent: pa.Array) -> pa.Array:
    return pa.array([None if x is None else encode(x) for x in torrent.to_pylist()], pa.binary())


def total_size(info: Column) -> Column:
    """Length of a single file, or the sum of its files."""
    return F.coalesce(info["length"], F.aggregate(info["files"], F.lit(0).cast("long"), lambda a, f: a + f["length"]))


def flat_trackers(torrent: Column) -> Column:
    """All announce URLs: those of the tiers, or else the single one."""
    return F.coalesce(F.flatten(torrent["announce_list"]), F.array(torrent["announce"]))


def public_tiers(torrent: Column) -> Column:
    """The tiers; none for a private torrent."""
    return F.when(F.coalesce(torrent["info"]["private"], F.lit(0)) != 1, torrent["announce_list"])
