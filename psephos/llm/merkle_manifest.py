"""A Merkle manifest of a dataset: a tree of arity three over each source, and one over the sources, with a proof for each row.

1. A row's leaf is the SHA-256 of its fields, each with its length; texts are read once, and only leaves go on.
2. Leaves are range-partitioned and sorted by (source, doc_id, leaf), and written with partition and place. Counts for each
   partition and source tell every leaf its index, and each source the number of its leaves and its own index.
3. Each partition folds its leaves to a sparse forest: nodes keyed by (tree, level, index), in which every run of siblings
   whose members are all there has become its parent. How many a run has is known from the number of leaves. A tree's last
   node is a leaf of the tree of sources (tree ``TOP``). Leaves are folded in aligned blocks of ``BLOCK``, so a task never has
   more of them in memory; it keeps the nodes above blocks and sources. Unresolved are the few nodes at a partition's edges.
4. Forests are an associative monoid (:class:`Forest`): ``treeReduce`` unites the unresolved nodes of all partitions and folds
   on, whatever the grouping. The root comes out. The nodes that were unresolved in a partition come along: the runs that a
   partition's edge cuts, four nodes a level at most, and as there are ``PARTS`` partitions at most, some megabytes, however
   many rows there are.
5. With these, and its own nodes above the blocks, each partition walks its leaves once more and writes every proof and the
   root that the leaf folds back to.

Defined cases: null fields are ``-`` and an empty text ``0:``; null sources are one tree, the first, and null ids come first in
theirs; ids that occur several times are ordered by leaf, and rows that are equal altogether stand side by side; a row without
an id is not tampered with; a very long text is one leaf like others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from psephos.llm.common import batch_of, saved

ARITY = 3
#: The tree of sources.
TOP = -1
#: Levels of a block and leaves that it has.
DEPTH = 9
BLOCK = ARITY**DEPTH
#: Partitions of leaves, at most.
PARTS = 2048

Key = tuple[int, int, int]


def digest(data: bytes) -> bytes:
    """SHA-256 in lower-case hex, as text."""
    return hashlib.sha256(data).hexdigest().encode()


@lru_cache(maxsize=1 << 12)
def heights(leaves: int) -> tuple[int, ...]:
    """Nodes of each level of a tree, from the leaves to its one last node."""
    out = [leaves]
    while out[-1] > 1:
        out.append(-(-out[-1] // ARITY))
    return tuple(out)


@dataclass
class Forest:
    """Nodes whose run is not complete; ``seen`` has these and all nodes that were in ``nodes`` before.

    ``sizes`` has the number of leaves of the trees.
    """

    sizes: dict[int, int] = field(default_factory=dict)
    nodes: dict[Key, bytes] = field(default_factory=dict)
    seen: dict[Key, bytes] = field(default_factory=dict)

    def put(self, nodes: dict[Key, bytes]) -> None:
        """Add nodes, and make every run that they complete its parent."""
        todo = list(nodes.items())
        while todo:
            key, node = todo.pop()
            tree, level, index = key
            self.nodes[key] = self.seen[key] = node
            counts = heights(self.sizes[tree])
            if level == len(counts) - 1:
                if tree != TOP:
                    todo.append(((TOP, 0, tree), self.nodes.pop(key)))
                continue
            first = index - index % ARITY
            run = [(tree, level, k) for k in range(first, min(first + ARITY, counts[level]))]
            if all(k in self.nodes for k in run):
                todo.append(((tree, level + 1, index // ARITY), digest(b"".join(self.nodes.pop(k) for k in run))))

    def united(self, other: Forest) -> Forest:
        self.sizes |= other.sizes
        self.seen |= other.seen
        self.put(other.nodes)
        return self


def _field(value: Column) -> Column:
    data = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(data).cast("string"), F.lit(":"), data), F.lit("-"))


def leaf(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return F.sha2(F.concat(*map(_field, (doc_id, source, lang, n_chars, text))).cast("binary"), 256)


def hashed(docs: DataFrame) -> DataFrame:
    """(doc_id, source, leaf, other): the leaf of each row, and the tampered one of the rows whose id's checksum is even."""
    columns = {c: F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")}
    own = docs.select(columns["doc_id"].cast("bigint").alias("doc_id"), columns["source"].cast("string").alias("source"), *(columns[c].alias(c) for c in ("lang", "n_chars", "text")))
    args = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    changed = even & F.contains("text", F.lit("\n"))
    real = leaf(*args, F.col("text"))
    rows = own.select("doc_id", "source", real.alias("leaf"), F.when(changed, leaf(*args, F.replace(F.col("text"), F.lit("\n"), F.lit("")))).alias("other"), F.coalesce(even, F.lit(False)).alias("tampered"))
    return rows.select("doc_id", "source", "leaf", F.when(F.col("tampered"), F.coalesce("other", "leaf")).alias("other"))


def placed(leaves: DataFrame, parts: int) -> DataFrame:
    """The leaves with ``pid`` and ``pos``: ranges of (source, doc_id, leaf), and places within."""
    types = {"doc_id": pa.int64(), "source": pa.string(), "leaf": pa.string(), "other": pa.string(), "pid": pa.int32(), "pos": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid, at = TaskContext.get().partitionId(), 0
        for b in batches:
            yield batch_of({n: b.column(n) for n in ("doc_id", "source", "leaf", "other")} | {"pid": [pid] * b.num_rows, "pos": range(at, at + b.num_rows)}, types)
            at += b.num_rows

    order = [F.asc_nulls_first(c) for c in ("source", "doc_id", "leaf")]
    spread = leaves.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return spread.mapInArrow(run, "doc_id bigint, source string, leaf string, other string, pid int, pos bigint")


def runs(rows: DataFrame) -> DataFrame:
    """(pid, source, start, first, leaves, tree, trees): where a source begins in a partition, the index of its first leaf there,
    how many it has in all, its index among sources, and how many sources there are. A row for each partition and source."""
    counts = saved(rows.groupBy("pid", "source").agg(F.count("*").alias("n"), F.min("pos").alias("start")), "counts")
    # sources are numbered by the partitions that they begin in, and by their order there
    begun = counts.groupBy("source").agg(F.min_by(F.struct("pid", "start"), F.struct("pid", "start")).alias("at"), F.sum("n").alias("leaves"))
    ahead = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    per_part = begun.groupBy("at.pid").agg(F.count("*").alias("new")).withColumns({"before": F.coalesce(F.sum("new").over(ahead), F.lit(0)), "trees": F.sum("new").over(Window.partitionBy())})
    trees = begun.withColumn("pid", F.col("at.pid")).join(per_part, "pid")
    trees = trees.select("source", "leaves", "trees", (F.col("before") + F.row_number().over(Window.partitionBy("pid").orderBy("at.start")) - 1).alias("tree"))
    earlier = Window.partitionBy("source").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.withColumn("first", F.coalesce(F.sum("n").over(earlier), F.lit(0))).withColumnRenamed("source", "_source")
    return first.join(trees, F.col("_source").eqNullSafe(F.col("source"))).select("pid", "source", "start", "first", "leaves", "tree", "trees")


class Segment:
    """Consecutive leaves of one tree within one block, and the nodes up to the block's root that are theirs alone."""

    def __init__(self, tree: int, first: int, leaves: int, hexes: list[bytes]):
        self.tree, self.counts = tree, heights(leaves)
        self.first, self.levels = [first], [b"".join(hexes)]
        for level, count in enumerate(self.counts[:-1][:DEPTH]):
            a, data = self.first[level], self.levels[level]
            b = a + len(data) // 64
            low, high = -(-a // ARITY), self.counts[level + 1] if b == count else b // ARITY
            self.first.append(low)
            self.levels.append(b"".join(digest(data[64 * (ARITY * k - a) : 64 * (ARITY * (k + 1) - a)]) for k in range(low, high)))

    def open(self) -> dict[Key, bytes]:
        """The nodes whose parent is not the segment's own."""
        out = {}
        for level, (a, data) in enumerate(zip(self.first, self.levels, strict=True)):
            b = a + len(data) // 64
            low, high = b, b  # places of the nodes that have a parent here
            if level + 1 < len(self.levels) and self.levels[level + 1]:
                p = self.first[level + 1]
                low, high = ARITY * p, ARITY * (p + len(self.levels[level + 1]) // 64)
            for k in (*range(a, low), *range(high, b)):
                out[self.tree, level, k] = data[64 * (k - a) : 64 * (k - a + 1)]
        return out

    def get(self, key: Key) -> bytes | None:
        tree, level, index = key
        if tree != self.tree or level >= len(self.levels) or not 0 <= (at := 64 * (index - self.first[level])) < len(self.levels[level]):
            return None
        return self.levels[level][at : at + 64]


def _segments(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple[tuple, list[tuple]]]:
    """The consecutive rows of one partition, tree and block: (pid, tree, trees, leaves), and the rows' index and ``columns``."""
    shared = ("pid", "tree", "trees", "leaves", "block")
    key, rows = None, []
    for b in batches:
        for values in zip(*(b.column(c).to_pylist() for c in (*shared, "index", *columns)), strict=True):
            if values[: len(shared)] != key:
                if rows:
                    yield key, rows
                key, rows = values[: len(shared)], []
            rows.append(values[len(shared) :])
    if rows:
        yield key, rows


def _by_part(rows: DataFrame) -> DataFrame:
    return rows.repartition("pid").sortWithinPartitions("pid", "pos", "level")


def forests(rows: DataFrame) -> DataFrame:
    """(pid, tree, trees, leaves, level, index, node, open): of each partition the nodes above blocks and sources and those at
    its edges, and whether they are unresolved."""
    types = {"pid": pa.int32(), "tree": pa.int64(), "trees": pa.int64(), "leaves": pa.int64(), "level": pa.int32(), "index": pa.int64(), "node": pa.string(), "open": pa.bool_()}

    def out(pid: int, trees: int, forest: Forest) -> Iterator[pa.RecordBatch]:
        found = [(pid, key[0], trees, forest.sizes[key[0]], key[1], key[2], node.decode(), key in forest.nodes) for key, node in forest.seen.items()]
        for k in range(0, len(found), 10_000):
            yield batch_of(dict(zip(types, zip(*found[k : k + 10_000], strict=True), strict=True)), types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, Forest()
        for (pid, tree, trees, leaves, _), own in _segments(batches, ("leaf",)):
            if pid != at:
                if at is not None:
                    yield from out(at, held.sizes[TOP], held)
                at, held = pid, Forest({TOP: trees})
            held.sizes[tree] = leaves
            held.put(Segment(tree, own[0][0], leaves, [x.encode() for _, x in own]).open())
        if at is not None:
            yield from out(at, held.sizes[TOP], held)

    return _by_part(rows).mapInArrow(run, "pid int, tree bigint, trees bigint, leaves bigint, level int, index bigint, node string, open boolean")


def reduced(fragments: DataFrame) -> Forest:
    """The union of all partitions' unresolved nodes."""

    def fold(rows: Iterator) -> Iterator[Forest]:
        held = Forest()
        for r in rows:
            held.sizes |= {TOP: r["trees"], r["tree"]: r["leaves"]}
            held.put({(r["tree"], r["level"], r["index"]): r["node"].encode()})
        yield held

    return fragments.where("open").rdd.mapPartitions(fold).treeReduce(lambda a, b: a.united(b), 3)


def proofs(rows: DataFrame, fragments: DataFrame, whole: Forest) -> DataFrame:
    """Per leaf its subroot, the root, the digest of its proof and the root that it, or its tampered version, folds back to."""
    known = rows.sparkSession.sparkContext.broadcast(whole.seen)  # bounded by PARTS, see the module's text
    (root,) = whole.nodes.values()
    types = {n: pa.int64() if n == "doc_id" else pa.bool_() if n == "verified" else pa.string() for n in COLUMNS}

    def walked(segment: Segment, trees: int, own: list[tuple], nodes: dict[Key, bytes], spine: dict[Key, bytes]) -> pa.RecordBatch:
        def node(key: Key) -> bytes:
            return segment.get(key) or nodes.get(key) or spine[key]

        top, tree = heights(trees), segment.tree
        ladder = [(tree, level, n) for level, n in enumerate(segment.counts[:-1])] + [(TOP, level, n) for level, n in enumerate(top[:-1])]
        subroot = node((tree, len(segment.counts) - 1, 0)).decode()
        path: list[tuple[int, bytes, bytes]] = [(-1, b"", b"")] * len(ladder)
        out: list[list] = [[] for _ in types]
        for index, doc_id, own_leaf, other in own:
            at = index
            for step, (part, level, count) in enumerate(ladder):
                if part == TOP and level == 0:
                    at = tree
                if path[step][0] == at:
                    break  # all above is as before
                first = at - at % ARITY
                path[step] = (at, b"".join(node((part, level, k)) for k in range(first, at)), b"".join(node((part, level, k)) for k in range(at + 1, min(first + ARITY, count))))
                at //= ARITY
            now = (own_leaf if other is None else other).encode()
            for _, before, after in path:
                now = digest(before + now + after)
            proof = digest(b"".join(x for _, before, after in path for x in (before, after))).decode()
            for column, value in zip(out, (doc_id, own_leaf, subroot, root.decode(), proof, now.decode(), now == root), strict=True):
                column.append(value)
        return batch_of(dict(zip(types, out, strict=True)), types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, nodes = None, {}
        for (pid, tree, trees, leaves, block), own in _segments(batches, ("doc_id", "leaf", "other", "level")):
            if pid != at:
                at, nodes = pid, {}
            if block is None:  # nodes above blocks, which come first
                nodes |= {(tree, level, index): node.encode() for index, _, node, _, level in own}
            else:
                segment = Segment(tree, own[0][0], leaves, [x.encode() for _, _, x, _, _ in own])
                yield walked(segment, trees, [x[:4] for x in own], nodes, known.value)

    above = fragments.select("pid", F.lit(-1).cast("bigint").alias("pos"), "tree", "trees", "leaves", F.lit(None).cast("bigint").alias("block"), "index", F.lit(None).cast("bigint").alias("doc_id"), F.col("node").alias("leaf"), F.lit(None).cast("string").alias("other"), "level")
    return _by_part(rows.unionByName(above)).mapInArrow(run, SCHEMA)


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
SCHEMA = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def manifest(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    parts = min(PARTS, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = saved(placed(saved(hashed(docs), "leaves"), parts), "placed")
    at = saved(runs(rows), "runs").withColumnsRenamed({"pid": "_pid", "source": "_source"})
    index = F.col("first") + F.col("pos") - F.col("start")
    rows = rows.join(at, (F.col("pid") == F.col("_pid")) & F.col("source").eqNullSafe(F.col("_source")))
    rows = rows.select("pid", "pos", "tree", "trees", "leaves", F.floor(index / BLOCK).alias("block"), index.alias("index"), "doc_id", "leaf", "other", F.lit(0).alias("level"))
    fragments = saved(forests(rows), "forests")
    if fragments.isEmpty():
        return docs.sparkSession.createDataFrame([], SCHEMA)
    return proofs(rows, fragments, reduced(fragments))
