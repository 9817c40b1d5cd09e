"""SentencePiece encoding and decoding with the original byte span of every piece.

Texts are normalised here, by longest prefixes of the model's compiled character map, so that each normalised byte
knows the source bytes that it came from. The library then splits normalised text with its own normaliser switched
off, and pieces are projected back through the alignment.
"""

from __future__ import annotations

import hashlib
import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, id_type, slices

BLANK = "▁"
_BLANK = BLANK.encode()
#: Entries of a worker's memo of encoded segments, emptied when full, and the longest segment that it holds.
MEMO_ENTRIES, MEMO_CHARS = 200_000, 48
_SEGMENT = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")

_loaded: dict[str, "PieceEncoder"] = {}


def _fields(blob: bytes) -> Iterator[tuple[int, int | bytes, bytes]]:
    """(field number, value, raw bytes) of a protocol-buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            byte = blob[i]
            i += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while i < len(blob):
        start, key = i, varint()
        value: int | bytes
        if key & 7 == 0:
            value = varint()
        else:
            n = {1: 8, 5: 4}.get(key & 7) or varint()
            value = blob[i : i + n]
            i += n
        yield key >> 3, value, blob[start:i]


def _packed(field: int, payload: bytes) -> bytes:
    def varint(n: int) -> bytes:
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])

    return varint(field << 3 | 2) + varint(len(payload)) + payload


class CharacterMap:
    """A compiled map: a double-array trie over source bytes whose leaves point into a table of replacements."""

    def __init__(self, blob: bytes):
        n = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{n // 4}I", blob, 4) if blob else ()
        self.table = blob[4 + n :]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """(source bytes taken, replacement) of the longest entry that starts at `at`."""
        if not self.units:
            return None
        units, found = self.units, None
        step = lambda u: (u >> 10) << ((u & 512) >> 6)
        node = step(units[0])
        for i in range(at, len(text)):
            node ^= text[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != text[i]:
                break
            node ^= step(unit)
            if unit >> 8 & 1:
                found = (i + 1 - at, units[node] & 0x7FFFFFFF)
        if not found:
            return None
        return found[0], self.table[found[1] : self.table.index(0, found[1])]


class Normalizer:
    def __init__(self, spec: dict[int, int | bytes], blank_after: bool = False):
        self.map = CharacterMap(bytes(spec.get(2, b"")))
        self.prefix, self.squeeze, self.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
        self.blank_after = blank_after
        #: Only blanks change: normalised text then follows by replacement, without the walk.
        self.plain = not self.map.units and not self.squeeze and self.escape and self.prefix and not blank_after

    def __call__(self, text: str) -> tuple[bytes, np.ndarray]:
        """Normalised UTF-8 and, for each of its bytes and the end, the source byte offset it starts at."""
        source, blank = text.encode("utf-8", "surrogatepass"), _BLANK if self.escape else b" "
        out, align, at = bytearray(), [], 0

        def one(at: int) -> tuple[int, bytes]:
            if hit := self.map.longest(source, at):
                return hit
            lead = source[at]
            n = 1 if lead < 128 else 2 if lead < 224 else 3 if lead < 240 else 4
            return n, source[at : at + n]

        def put(piece: bytes, where: int) -> None:
            out.extend(piece)
            align.extend([where] * len(piece))

        if self.squeeze:
            while at < len(source) and (hit := one(at))[1] == b" ":
                at += hit[0]
        if at == len(source):
            return b"", np.array([at], np.int64)
        if self.prefix and not self.blank_after:
            put(blank, at)
        after_blank = self.squeeze
        while at < len(source):
            n, new = one(at)
            while after_blank and new.startswith(b" "):
                new = new[1:]
            if new == source[at : at + n] != b" ":
                out.extend(new)
                align.extend(range(at, at + n))
                after_blank = False
            elif new:
                put(new.replace(b" ", blank), at)
                after_blank = new.endswith(b" ")
            if not self.squeeze:
                after_blank = False
            at += n
        if self.squeeze:
            while out.endswith(blank):
                del out[-len(blank) :]
                at = align[-len(blank)]
                del align[-len(blank) :]
        if self.prefix and self.blank_after:
            put(blank, at)
        return bytes(out), np.array([*align, at], np.int64)


class PieceEncoder:
    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as f:
            model = f.read()
        parts = list(_fields(model))
        trainer = {f: v for x, y, _ in parts if x == 2 for f, v, _ in _fields(y)}
        spec = {f: v for x, y, _ in parts if x == 3 for f, v, _ in _fields(y)}
        self.normalize = Normalizer(spec, bool(trainer.get(24, 0)))
        silent = _packed(3, _packed(1, b"identity") + b"\x18\x00\x20\x00\x28\x00")
        self.core = sentencepiece.SentencePieceProcessor(model_proto=b"".join(raw for f, _, raw in parts if f != 3) + silent)
        self.lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        kinds, sizes = [], []
        inner = False
        for f, v, _ in parts:
            if f == 1:
                piece = {a: b for a, b, _ in _fields(v)}
                kind, name = piece.get(3, 1), bytes(piece.get(1, b"")).decode("utf-8")
                kinds.append(kind)
                sizes.append((1 if kind == 6 else len(name.encode()), 1 if kind == 6 else len(name.replace(BLANK, " ").encode())))
                inner |= kind == 1 and BLANK in name.lstrip(BLANK)
        self.unknown = kinds.index(2) if 2 in kinds else -1
        #: Bytes of each piece in normalised text, and in source text where only blanks were changed.
        self.wide, self.narrow = (np.array([s[k] for s in sizes], np.int64) for k in (0, 1))
        #: Pieces never run past a word's last character: segments can be encoded apart and memoised.
        self.by_segment = trainer.get(3, 1) == 2 and not inner and 4 not in kinds and 6 in kinds and not self.normalize.blank_after
        self.memo: dict[str, tuple[str, bytes]] = {}

    def _segments(self, normal: list[str]) -> list[list[tuple[str, bytes]]]:
        """For each normalised text, the (decimal ids, ids as int32) of its segments."""
        memo = self.memo
        if len(memo) > MEMO_ENTRIES:
            memo.clear()
        cut = [_SEGMENT.findall(t) if self.by_segment else [t] * bool(t) for t in normal]
        fresh = list({s for segs in cut for s in segs if s not in memo})
        late = {}
        for s, ids in zip(fresh, self.core.encode(fresh, num_threads=1) if fresh else [], strict=True):
            (memo if len(s) <= MEMO_CHARS else late)[s] = (",".join(map(str, ids)), array("i", ids).tobytes())
        if late:
            return [[memo[s] if s in memo else late[s] for s in segs] for segs in cut]
        return [[memo[s] for s in segs] for segs in cut]

    def encode(self, texts: list[str]) -> list[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
        """For each text: decimal ids joined by commas, ids, and the first and last byte offsets of each piece."""
        plain = [self.normalize.plain and BLANK not in t for t in texts]
        walked = {i: self.normalize(t) for i, t in enumerate(texts) if not plain[i]}
        normal = [(BLANK + t.replace(" ", BLANK) if t else "") if plain[i] else walked[i][0].decode("utf-8", "surrogatepass") for i, t in enumerate(texts)]
        out = []
        for i, segs in enumerate(self._segments(normal)):
            ids = np.frombuffer(b"".join([s[1] for s in segs]), np.int32)
            if plain[i]:
                ends = np.cumsum(self.narrow[ids]) - 1
                starts = np.maximum(ends - self.narrow[ids], 0)
            elif (ids == self.unknown).any():
                pieces = self.core.encode(normal[i], out_type="immutable_proto").pieces
                at = np.cumsum([0, *(len(p.surface.encode()) for p in pieces)])
                starts, ends = walked[i][1][at[:-1]], walked[i][1][at[1:]]
            else:
                at = np.cumsum(np.r_[0, self.wide[ids]])
                starts, ends = walked[i][1][at[:-1]], walked[i][1][at[1:]]
            out.append((",".join([s[0] for s in segs]), ids, starts, ends))
        return out

    def decode(self, ids: list[int]) -> str:
        return self.lib.decode(ids)


def encoder(path: str) -> PieceEncoder:
    if path not in _loaded:
        _loaded[path] = PieceEncoder(path)
    return _loaded[path]


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, ids array<int>, starts and ends array<int> (byte offsets in the source text).

    ids equal the library's, without begin or end marks. A prefix blank that the model adds has an empty span; pieces
    for single bytes have a byte each. Null and empty texts have no pieces; ids, ties and repeated rows pass through;
    other columns are ignored. No shuffle: every row is encoded where it is read, whole.
    """
    kind = id_type(docs, id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib, ints = encoder(model_path), pa.list_(pa.int32())
        for b in slices(batches):
            got = lib.encode(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array([g[k].astype(np.int32) for g in got], ints) for k in (1, 2, 3))], [id_col, "ids", "starts", "ends"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, starts array<int>, ends array<int>")


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row: id, text as the library's decode(ids) gives it; null ids count as none."""
    kind = id_type(encoded, id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib = encoder(model_path)
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([lib.decode(x or []) for x in b.column("ids").to_pylist()], pa.string())], [id_col, "text"])

    return encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"`{id_col}` {kind}, text string")


def round_trip(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode() and decode() of every row in one pass, as digests: id, n_tokens, ids_sha256 (decimal ids joined by
    commas), decoded_sha256 (UTF-8), spans_sha256 (start:end pairs as int32). Cases are those of encode()."""
    kind = id_type(docs, id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib, sha = encoder(model_path), lambda b: hashlib.sha256(b).hexdigest()
        for b in slices(batches):
            rows = [
                (len(ids), sha(shown.encode()), sha(lib.decode(ids.tolist()).encode()), sha(np.stack([starts, ends], 1).astype("<i4").tobytes()))
                for shown, ids, starts, ends in lib.encode(b.column("text").to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array([r[k] for r in rows], pa.string() if k else pa.int64()) for k in range(4))], [id_col, "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string")
