"""SentencePiece encoding that keeps offsets, and decoding.

The normaliser is our own: it walks the model's compiled character map (a double-array trie of source strings and a pool of
replacements), always takes the longest source prefix, and records for every normalised byte the source byte it came from.
The library's segmentation then runs on the normalised text, with a copy of the model whose own normaliser is switched off,
and each piece is projected through the recorded alignment to its span in the original bytes.

Defined cases: a null text is the empty text and has no ids; other columns of the input are ignored by
:func:`encode_documents`, which returns one row per input row, repeated rows included; a very long text is encoded
whole; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import struct
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from psephos.llm.common import arrow_map, batch_of, small_batches, texts_of

SPACE = "▁"


class CharMap:
    """The compiled character map: size of the trie, trie units, then null-terminated replacements."""

    def __init__(self, blob: bytes) -> None:
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, dtype="<u4", count=size // 4, offset=4).tolist() if blob else []
        self.pool = blob[4 + size :]

    def __bool__(self) -> bool:
        return bool(self.units)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Bytes taken and replacement of the longest source string that starts at ``at``."""
        units = self.units
        if not units:
            return None
        node, found, k = 0, None, at
        unit = units[0]
        node ^= (unit >> 10) << ((unit & 0x200) >> 6)
        while k < len(data):
            node ^= data[k]
            unit = units[node]
            if unit & 0x800000FF != data[k]:
                break
            k += 1
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit & 0x100:
                found = (k - at, units[node] & 0x7FFFFFFF)
        if found is None:
            return None
        taken, start = found
        return taken, self.pool[start : self.pool.index(b"\0", start)]

    def first_bytes(self) -> set[int]:
        """Bytes with which a source string may start."""
        if not self.units:
            return set()
        root = (self.units[0] >> 10) << ((self.units[0] & 0x200) >> 6)
        return {b for b in range(1, 256) if (root ^ b) < len(self.units) and self.units[root ^ b] & 0x800000FF == b}


@dataclass
class Encoded:
    """Ids of a text and the span of each piece in the text's UTF-8 bytes."""

    ids: np.ndarray
    begins: np.ndarray
    ends: np.ndarray


class Codec:
    """A SentencePiece model that knows where its pieces come from."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        spec = proto.normalizer_spec
        self.map = CharMap(spec.precompiled_charsmap)
        self.dummy, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.suffix = proto.trainer_spec.treat_whitespace_as_suffix
        own = sorted((p.piece.encode() for p in proto.pieces if p.type == p.USER_DEFINED), key=len, reverse=True)
        self.own = re.compile(b"|".join(map(re.escape, own))) if own else None
        self.unknown = next((i for i, p in enumerate(proto.pieces) if p.type == p.UNKNOWN), -1)
        self.sizes = np.array([1 if p.type == p.BYTE else len(p.piece.encode()) for p in proto.pieces], dtype=np.int64)
        first = self.map.first_bytes()
        self.touched = re.compile(b"[" + b"".join(re.escape(bytes([b])) for b in sorted(first)) + b"]") if first else None
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces = b"", False, False
        spec.name = "identity"
        self.segmenter = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())

    def normalize(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text and, for each of its bytes and its end, the byte offset in the source."""
        data = text.encode()
        raw = np.frombuffer(data, dtype=np.uint8)
        source = np.arange(len(raw) + 1, dtype=np.int64)
        if self.map or self.own:
            raw, source = self._mapped(data)
        if self.squeeze and len(raw):
            raw, source = self._squeezed(raw, source)
        if not len(raw):
            return "", source[-1:]
        space = SPACE if self.escape else " "
        wide = len(space.encode())
        counts = np.where(raw == 32, wide, 1)
        out = raw.tobytes().decode().replace(" ", space)
        align = np.concatenate([np.repeat(source[:-1], counts), source[-1:]])
        if self.dummy:
            if self.suffix:
                out, align = out + space, np.concatenate([align, np.full(wide, source[-1])])
            else:
                out, align = space + out, np.concatenate([np.full(wide, align[0]), align])
        return out, align

    def _mapped(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        out, source, at = bytearray(), [], 0
        end = len(data)
        while at < end:
            if self.own and (m := self.own.match(data, at)):
                out += m[0]
                source += range(at, m.end())
                at = m.end()
            elif found := self.map.longest(data, at):
                out += found[1]
                source += [at] * len(found[1])
                at += found[0]
            else:
                lead = data[at]
                size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                out += data[at : at + size]
                source += range(at, at + size)
                at += size
                if self.own is None and self.touched and (m := self.touched.search(data, at)) and m.start() > at:
                    # what cannot start a source string is passed on as it is, whole characters only
                    stop = m.start()
                    while stop > at and data[stop] & 0xC0 == 0x80:
                        stop -= 1
                    out += data[at:stop]
                    source += range(at, stop)
                    at = stop
        return np.frombuffer(bytes(out), dtype=np.uint8), np.array([*source, end], dtype=np.int64)

    @staticmethod
    def _squeezed(raw: np.ndarray, source: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Without spaces at either end, and with one for each run of them."""
        blank = raw == 32
        keep = ~(blank & np.concatenate([[True], blank[:-1]]))
        if keep.any() and blank[np.flatnonzero(keep)[-1]]:
            keep[np.flatnonzero(keep)[-1]] = False
        kept = np.flatnonzero(keep)
        last = source[kept[-1] + 1] if len(kept) else source[-1]
        return raw[kept], np.concatenate([source[:-1][kept], [last]])

    def encode(self, text: str) -> Encoded:
        normal, align = self.normalize(text)
        ids = np.array(self.segmenter.encode(normal), dtype=np.int64)
        sizes = self.sizes[ids] if len(ids) else np.zeros(0, np.int64)
        if self.unknown >= 0 and len(ids) and (ids == self.unknown).any():
            proto = self.segmenter.encode(normal, out_type="immutable_proto")
            sizes = np.array([len(p.surface.encode()) for p in proto.pieces], dtype=np.int64)
        ends = np.cumsum(sizes)
        return Encoded(ids, align[ends - sizes], align[ends])

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec for a worker process; ``path`` is a model file that every node has."""
    with open(path, "rb") as f:
        return Codec(f.read())


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, ``ids``, and ``begins`` and ``ends`` of each piece in the bytes of the original text."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        got = [codec(model).encode(t) for t in texts_of(b)]
        lists = [pa.array([getattr(g, k).astype(np.int32) for g in got], pa.list_(pa.int32())) for k in ("ids", "begins", "ends")]
        return pa.RecordBatch.from_arrays([b.column("id"), *lists], names=["id", "ids", "begins", "ends"])

    out = arrow_map(docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text"), fn, f"id {kind}, ids array<int>, begins array<int>, ends array<int>")
    return out.withColumnRenamed("id", id_col)


def codec_report(docs: DataFrame, model: str) -> DataFrame:
    """Counts and digests of each document's encoding and of what it decodes to, made in the worker beside the encoding;
    ``n_bytes_covered`` sums the pieces' spans in the original bytes.

    """
    small_batches(docs.sparkSession)
    types = {"doc_id": pa.int64(), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string(), "n_bytes_covered": pa.int64()}

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(model)
        decimal = [str(i) for i in range(len(c.sizes))]
        out: dict[str, list] = {k: [] for k in types}
        out["doc_id"] = b.column("doc_id")
        for t in texts_of(b):
            e = c.encode(t)
            ids = e.ids.tolist()
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
            out["n_bytes_covered"].append(int((e.ends - e.begins).sum()))
        return batch_of(out, types)

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, n_bytes_covered bigint"
    return arrow_map(docs.selectExpr("CAST(doc_id AS bigint) AS doc_id", "text"), fn, schema)


def encode_and_decode(docs: DataFrame, model: str) -> DataFrame:
    """Per row: doc_id, n_tokens, the ids, and the digest of what they decode to."""
    small_batches(docs.sparkSession)
    types = {"doc_id": pa.int64(), "n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "decoded_sha256": pa.string()}

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(model)
        got = [c.encode(t).ids for t in texts_of(b)]
        decoded = [hashlib.sha256(c.decode(g.tolist()).encode()).hexdigest() for g in got]
        return batch_of({"doc_id": b.column("doc_id"), "n_tokens": [len(g) for g in got], "ids": [g.astype(np.int32) for g in got], "decoded_sha256": decoded}, types)

    rows = docs.selectExpr("CAST(doc_id AS bigint) AS doc_id", "text")
    return arrow_map(rows, fn, "doc_id bigint, n_tokens bigint, ids array<int>, decoded_sha256 string")
