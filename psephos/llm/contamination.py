"""Benchmark decontamination by winnowing.

Both sides keep, for each window of ten consecutive words, the smallest hash of the five-word grams in it. Two equal windows
have equal fingerprints, so the join of document and item fingerprints misses no shared span of ten words or more. What it
finds is compared word by word with the benchmark's window of the same hash, and adjoining hits extend each other to whole
spans. Items with fewer words than that have one window of their own length and are looked up by the gram of that length.
Equal windows of the benchmark are held once, so a document of any kind, periodic ones too, is searched in time proportional
to its words and what it shares.

Words are compared by their number in the benchmark's vocabulary, so what is reported is exact. The benchmark side is handed
to the executors in blocks of at most ``BLOCK_BYTES`` of text, measured before one is collected; a larger benchmark takes
several passes over the documents, never a larger broadcast. Repeated items are taken once, and long items are cut into parts
that overlap by a window less one word, so that no block depends on the size of one item.

Defined cases: null texts have no words; an empty or null item has no window; a null item id is written as the empty string;
repeated rows give repeated results, and items of one id count once; a very long text is searched whole; an empty table gives no
rows, and an empty benchmark leaves every document clean; other columns are ignored (or passed on by ``clean``).
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from itertools import repeat
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from psephos.llm.common import arrow_map, batch_of, gram_hashes, place_of, saved, small_batches

#: Words as UTF-8 bytes after ASCII lower-casing: letters, digits and everything beyond ASCII.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WINDOW = 10
GRAM = 5
#: Most bytes of benchmark text that go to the executors at once, and of a part of an item.
BLOCK_BYTES = 16 << 20
PART_BYTES = 1 << 20

_built: dict[str, Index] = {}


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


def fingerprints(ids: np.ndarray) -> np.ndarray:
    """For each window of WINDOW words the smallest gram hash in it."""
    grams = gram_hashes(ids.astype(np.uint64), GRAM)
    n = len(ids) - WINDOW + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    least = grams[:n].copy()
    for k in range(1, WINDOW - GRAM + 1):
        np.minimum(least, grams[k : n + k], out=least)
    return least


class Windows:
    """The distinct windows of ``length`` words among items, by hash, each with the items that have it."""

    def __init__(self, items: list[tuple[int, np.ndarray]], length: int) -> None:
        self.length = length
        flat = np.concatenate([*(ids for _, ids in items), np.empty(0, np.int64)])
        sizes = np.array([len(ids) - length + 1 for _, ids in items], dtype=np.int64)
        begin = np.cumsum([0, *(len(ids) for _, ids in items)])[:-1]
        start = np.repeat(begin - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
        owner = np.repeat(np.array([k for k, _ in items], dtype=np.int64), sizes)
        grid = flat[start[:, None] + np.arange(length)]
        self.salt = 0
        while True:  # until different windows have different hashes
            keys = np.concatenate([gram_hashes(self._salted(ids), length) for _, ids in items])
            order = np.lexsort((owner, keys))
            keys, place = keys[order], grid[order]
            new = np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)]
            if new[1:].all() or (place[1:] == place[:-1])[~new[1:]].all():
                break
            self.salt += 1
        self.keys, self.words = keys[new], place[new]
        pairs = np.unique(np.stack([np.cumsum(new) - 1, owner[order]]), axis=1)
        self.owners = pairs[1]
        self.cuts = np.searchsorted(pairs[0], np.arange(len(self.keys) + 1))

    def _salted(self, ids: np.ndarray) -> np.ndarray:
        return ids.astype(np.uint64) + np.uint64(self.salt << 40)

    def find(self, ids: np.ndarray, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Where windows of the benchmark occur in ``ids`` (of those at the places ``at``), and which ones."""
        values = gram_hashes(self._salted(ids), self.length)
        at = np.arange(len(values)) if at is None else at
        if not len(self.keys) or not len(at):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        slot = np.minimum(np.searchsorted(self.keys, values[at]), len(self.keys) - 1)
        same = self.keys[slot] == values[at]
        at, slot = at[same], slot[same]
        same = (ids[at[:, None] + np.arange(self.length)] == self.words[slot]).all(axis=1)
        return at[same], slot[same]


class Index:
    """Fingerprints and windows of a block of items."""

    def __init__(self, items: list[tuple[str, str]]) -> None:
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary.setdefault
        self.names = [name for name, _ in items]
        ids = [np.array([number(w, len(self.vocabulary) + 1) for w in words_of(text)], dtype=np.int64) for _, text in items]
        lengths = sorted({min(len(x), WINDOW) for x in ids if len(x)})
        self.windows = {m: Windows([(k, x) for k, x in enumerate(ids) if min(len(x), WINDOW) == m], m) for m in lengths}
        self.prints = np.unique(np.concatenate([np.empty(0, np.uint64), *(fingerprints(x) for x in ids)]))

    def search(self, words: list[bytes]) -> tuple[np.ndarray, set[int]]:
        """Which words are hit, and the items (by number) that have a window here."""
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int64, len(words))
        edge = np.zeros(len(words) + 1, np.int64)
        found: set[int] = set()
        for m, windows in self.windows.items():
            at = None
            if m == WINDOW:  # the join of fingerprints
                prints = fingerprints(ids)
                if not len(prints):
                    continue
                slot = np.minimum(np.searchsorted(self.prints, prints), len(self.prints) - 1)
                at = np.flatnonzero(self.prints[slot] == prints)
            at, which = windows.find(ids, at)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + m, -1)
            for k in np.unique(which).tolist():
                found.update(windows.owners[windows.cuts[k] : windows.cuts[k + 1]].tolist())
        return np.cumsum(edge[:-1]) > 0, found


def parts_of(text: str | None, size: int = PART_BYTES) -> list[str]:
    """An item's words in parts of about ``size`` bytes, each beginning with the last words of the one before, so that every
    window lies in one of them whole."""
    words = words_of(text)
    if not words or len(text or "") <= size // 4:
        return [text] if words else []
    out, at = [], 0
    sizes = np.cumsum([len(w) + 1 for w in words])
    while True:
        end = max(int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + size)), at + WINDOW)
        out.append(b" ".join(words[at:end]).decode("utf-8", "surrogatepass"))
        if end >= len(words):
            return out
        at = end - WINDOW + 1


def _index(key: str, items: list[tuple[str, str]]) -> Index:
    """The block's index, built once in a worker process."""
    if key not in _built:
        _built.clear()
        _built[key] = Index(items)
    return _built[key]


def blocks_of(benchmark: DataFrame, block_bytes: int) -> tuple[DataFrame, int]:
    """The distinct parts of the items as (block, item_id, text), written to the shared folder, and the number of blocks, none of
    which is larger than ``block_bytes`` (unless it is a single part)."""
    part_bytes = min(PART_BYTES, max(1, block_bytes // 4))

    def cut(b: pa.RecordBatch) -> pa.RecordBatch:
        found = [(name, part) for name, text in zip(b.column("item_id").to_pylist(), b.column("text").to_pylist(), strict=True) for part in parts_of(text, part_bytes)]
        types = {"item_id": pa.string(), "text": pa.string()}
        return batch_of(dict(zip(types, ([x for x, _ in found], [x for _, x in found]), strict=True)), types)

    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    parts = saved(arrow_map(items, cut, "item_id string, text string").distinct(), "benchmark-parts")
    size = F.octet_length("text") + F.octet_length("item_id") + 40
    total = parts.agg(F.sum(size)).first()[0] or 0
    blocks = max(1, ceil(total / block_bytes))
    while True:
        dealt = parts.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).cast("int"))
        largest = dealt.groupBy("block").agg(F.sum(size).alias("n"), F.count("*").alias("parts")).where(F.col("parts") > 1).agg(F.max("n")).first()[0] or 0
        if largest <= block_bytes:
            return dealt, blocks
        blocks += ceil(blocks / 2)


def _marked(docs: DataFrame, benchmark: DataFrame, columns: list[str], finish, schema: str, block_bytes: int) -> DataFrame:
    """Carry (columns, text, hit bits, item names) through a pass for each block of the benchmark, then ``finish``."""
    spark = docs.sparkSession
    small_batches(spark)
    items, blocks = blocks_of(benchmark, block_bytes)
    carried = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema)
    rows = docs.select(*columns, F.col("text").alias("_text"), F.lit(None).cast("binary").alias("_hit"), F.array().cast("array<string>").alias("_items"))

    def step(shared, key: str, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = _index(key, shared.value)
            for b in batches:
                if not b.num_rows:
                    continue
                texts, bits, names = (b.column(b.num_columns - k).to_pylist() for k in (3, 2, 1))
                out_bits, out_names, counts = [], [], []
                for text, old, had in zip(texts, bits, names, strict=True):
                    words = words_of(text)
                    hit, found = index.search(words)
                    if old is not None:
                        hit |= np.unpackbits(np.frombuffer(old, dtype=np.uint8), count=len(words)).astype(bool)
                    counts.append((text, words, hit))
                    out_bits.append(np.packbits(hit).tobytes())
                    out_names.append(sorted({*had, *(index.names[k] for k in found)}))
                kept = [b.column(k) for k in range(b.num_columns - 3)]
                if last:
                    yield finish(kept, counts, out_names)
                else:
                    yield pa.RecordBatch.from_arrays([*kept, b.column(b.num_columns - 3), pa.array(out_bits, b.schema.field(b.num_columns - 2).type), pa.array(out_names, b.schema.field(b.num_columns - 1).type)], schema=b.schema)

        return run

    for k in range(blocks):
        shared = spark.sparkContext.broadcast([(r.item_id, r.text) for r in items.where(F.col("block") == k).collect()])  # at most block_bytes
        last = k == blocks - 1
        rows = rows.mapInArrow(step(shared, uuid.uuid4().hex, last), schema if last else f"{carried}{', ' * bool(carried)}_text string, _hit binary, _items array<string>")
        if blocks > 1:
            rows = saved(rows, "decontamination")
            shared.destroy()
    return rows


def contamination_report(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""

    def finish(kept: list[pa.Array], counts: list, names: list[list[str]]) -> pa.RecordBatch:
        n_hit = [int(hit.sum()) for _, _, hit in counts]
        columns = [
            kept[0],
            pa.array([len(words) for _, words, _ in counts], pa.int64()),
            pa.array(n_hit, pa.int64()),
            pa.array([len(x) for x in names], pa.int64()),
            pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in names], pa.string()),
            pa.array([n > 0 for n in n_hit], pa.bool_()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    schema = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"
    return _marked(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), benchmark, ["doc_id"], finish, schema, block_bytes)


def clean(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that no window of the benchmark occurs in, with their own columns (``text`` must be one of them)."""
    names = [f"_c{k}" for k in range(len(docs.columns))]
    at = place_of(docs, "text")
    rows = docs.toDF(*names).withColumn("text", F.col(names[at]))

    def finish(kept: list[pa.Array], counts: list, found: list[list[str]]) -> pa.RecordBatch:
        free = pa.array([not hit.any() for _, _, hit in counts])
        return pa.RecordBatch.from_arrays([c.filter(free) for c in kept], names=names)

    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema, strict=True))
    return _marked(rows, benchmark, names, finish, schema, block_bytes).toDF(*docs.columns)
