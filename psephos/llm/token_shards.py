"""Token-id shards: independent zstandard frames, one per document, with a trailing seek table.

A shard file is a run of zstandard frames (the ids of one document each), then two skippable frames: an index with the width
of an id, the document ids and a bit for each that is not null, and a seek table in the layout of the public seekable format (for each frame: compressed
size, size, low 32 bits of the XXH64 of the content; then the number of frames, a descriptor byte and a magic number). Any
zstandard tool can read the file as a whole; :class:`ShardReader` reads the table from the end and decompresses only the
documents that are asked for, checking each frame's checksum.

A task writes under a name of its own and renames the file when it is whole; the manifest, written to the shared folder after
that, names the files that count. So a task that is run again after a lost executor leaves no trace in the result.

The files are read back by as many tasks as there are files.

Defined cases: a null text is the empty text (its ids are the end id alone); documents with a null id come first, and have a
null id in what is read back; documents of one id are ordered by their text; a text of any length is one frame, encoded slice
by slice; an empty table gives no shard; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from psephos.llm.common import batch_of, saved, small_batches, texts_of, workspace
from psephos.llm.encoding import word_bpe

#: Fixed values of the public zstandard seekable format.
SKIPPABLE_TABLE = 0x184D2A5E
SKIPPABLE_INDEX = 0x184D2A50
SEEKABLE_MAGIC = 0x8F92EAB1
HAS_CHECKSUMS = 0x80

#: A shard is closed when its frames reach this size.
SHARD_BYTES = 64 << 20


class ShardWriter:
    """Appends documents to one shard file."""

    def __init__(self, folder: str, width: int) -> None:
        self.fs, base = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(base, recursive=True)
        self.name = f"{uuid.uuid4().hex}.ids.zst"
        self.temporary, self.final = f"{base}/.{self.name}.part", f"{base}/{self.name}"
        self.out = self.fs.open_output_stream(self.temporary)
        self.width = width
        self.zstd = zstandard.ZstdCompressor(level=3, write_checksum=True)
        self.doc_ids: list[int | None] = []
        self.table: list[tuple[int, int, int]] = []
        self.bytes = self.tokens = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        raw = ids.astype(f"<u{self.width}").tobytes()
        frame = self.zstd.compress(raw)
        self.out.write(frame)
        self.doc_ids.append(doc_id)
        self.table.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.bytes += len(frame)
        self.tokens += len(ids)

    def close(self) -> None:
        known = np.packbits(np.array([d is not None for d in self.doc_ids], dtype=bool)).tobytes()
        index = struct.pack("<B", self.width) + np.array([d or 0 for d in self.doc_ids], dtype="<i8").tobytes() + known
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        table = np.array(self.table, dtype="<u4").tobytes() + struct.pack("<IBI", len(self.table), HAS_CHECKSUMS, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_TABLE, len(table)) + table)
        self.out.close()
        self.fs.move(self.temporary, self.final)


class ShardReader:
    """Random access to the documents of a shard."""

    def __init__(self, folder: str, name: str) -> None:
        self.fs, base = pafs.FileSystem.from_uri(folder)
        self.file = self.fs.open_input_file(f"{base}/{name}")
        size = self.file.size()
        frames, _, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError(f"{name}: no seek table")
        length = 12 * frames + 9
        at = size - length
        self.table = np.frombuffer(self.file.read_at(12 * frames, at), dtype="<u4").reshape(frames, 3)
        length = 1 + 8 * frames + -(-frames // 8)
        raw = self.file.read_at(length, at - 8 - length)
        self.width = raw[0]
        self.doc_ids = np.frombuffer(raw, dtype="<i8", offset=1, count=frames)
        self.known = np.unpackbits(np.frombuffer(raw, dtype=np.uint8, offset=1 + 8 * frames), count=frames).astype(bool)
        self.starts = np.concatenate([[0], np.cumsum(self.table[:, 0], dtype=np.int64)])
        self.token_starts = np.concatenate([[0], np.cumsum(self.table[:, 1] // self.width, dtype=np.int64)])
        self.zstd = zstandard.ZstdDecompressor()

    def __len__(self) -> int:
        return len(self.table)

    def frame(self, k: int) -> np.ndarray:
        """The ids of the k-th document; raises if the frame does not match its checksum."""
        packed, size, check = (int(x) for x in self.table[k])
        raw = self.zstd.decompress(self.file.read_at(packed, int(self.starts[k])), max_output_size=max(size, 1)) if size else b""
        if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k}: wrong checksum")
        return np.frombuffer(raw, dtype=f"<u{self.width}").astype(np.uint32)

    def document(self, doc_id: int | None) -> np.ndarray:
        """The ids of a document by its id (the first, if there are several)."""
        nulls = int(len(self) - self.known.sum())  # they come first
        k = 0 if doc_id is None else nulls + int(np.searchsorted(self.doc_ids[nulls:], doc_id))
        if k >= (nulls if doc_id is None else len(self)) or (doc_id is not None and self.doc_ids[k] != doc_id):
            raise KeyError(doc_id)
        return self.frame(k)


def write_shards(docs: DataFrame, tokenizer: str, end_id: int, folder: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encode ``docs`` (doc_id, text) in ascending doc_id order into shards; returns the manifest, already written.

    Manifest columns: file, part, seq (the order of the shards), n_docs, n_tokens, start (ids in all shards before).
    """
    small_batches(docs.sparkSession)
    types = {"file": pa.string(), "part": pa.int32(), "seq": pa.int32(), "n_docs": pa.int64(), "n_tokens": pa.int64()}

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = word_bpe(tokenizer)
        width = 2 if max(model.model.get_vocab_size() - 1, end_id) < 1 << 16 else 4
        part, seq, shard = TaskContext.get().partitionId(), 0, None

        def row(w: ShardWriter) -> pa.RecordBatch:
            w.close()
            return batch_of({"file": [w.name], "part": [part], "seq": [seq], "n_docs": [len(w.table)], "n_tokens": [w.tokens]}, types)

        end = np.array([end_id], dtype=np.uint32)
        for b in batches:
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), model.encode(texts_of(b)), strict=True):
                shard = shard or ShardWriter(folder, width)
                shard.add(doc_id, np.concatenate([ids, end]))
                if shard.bytes >= shard_bytes:
                    yield row(shard)
                    shard, seq = None, seq + 1
        if shard:
            yield row(shard)

    rows = docs.selectExpr("CAST(doc_id AS bigint) AS doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    manifest = saved(rows.mapInArrow(write, "file string, part int, seq int, n_docs bigint, n_tokens bigint"), "token-manifest")
    tasks = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row for each writing task
    tasks = tasks.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    within = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return manifest.withColumn("start", within).join(tasks, "part").withColumn("start", F.col("start") + F.col("base")).drop("base")


def read_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document of the shards that ``manifest`` names: doc_id, start, n_tokens, ids_crc32."""
    types = {"doc_id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64(), "ids_crc32": pa.int64()}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, start in zip(b.column("file").to_pylist(), b.column("start").to_pylist(), strict=True):
                shard = ShardReader(folder, name)
                for k in range(0, len(shard), 4096):
                    to = range(k, min(k + 4096, len(shard)))
                    crc = [zlib.crc32(shard.frame(i).astype("<u4").tobytes()) for i in to]
                    n = np.diff(shard.token_starts[k : to.stop + 1])
                    ids = pa.array(shard.doc_ids[k : to.stop], mask=~shard.known[k : to.stop])
                    yield batch_of({"doc_id": ids, "start": shard.token_starts[k : to.stop] + start, "n_tokens": n, "ids_crc32": crc}, types)

    spread = manifest.select("file", "start").repartitionByRange(max(1, manifest.count()), "start")
    return spread.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_shards(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write all documents to shards in the shared folder and read every frame back."""
    folder = workspace(docs.sparkSession, "token-shards")
    return read_shards(write_shards(docs, tokenizer, end_id, folder), folder)
