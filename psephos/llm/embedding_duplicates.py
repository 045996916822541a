"""Near-duplicate vectors by p-stable hashing: links of equal labels at a cosine, confirmed in double precision.

1. Vectors are normalised; those of one label and equal components form a class, and only the class goes on.
2. ``tables()`` hash tables of ``WIDTH`` quantised Gaussian projections give each class a bucket a table: floor((a * v + b) / CELL).
   At the threshold two unit vectors are 0.2 apart, and share no bucket with a probability below ``UNSEEN``.
3. Buckets of two classes or more are compared in blocks: a bucket's classes are dealt into chunks of ``CHUNK``, and each pair
   of chunks is one block, so that a bucket of any size is spread over tasks. A block multiplies its vectors in double precision.
   A pair counts in the first table whose bucket it shares, which both rows' keys tell, so no pair is ever shuffled.
4. A block returns sums of links for each class and a forest of its linked classes: rows by members, not by pairs.
   Components come from these forests.

The work within a group of vectors that are all near each other is quadratic in its distinct vectors, as the number of links
asks for; rows, shuffles and memory are not. Each class is written once for each of its shared buckets.

Defined cases: a null vector, one without components, with a null or non-finite component, or of zeros only links with nothing,
nor does a null label or a null id (its component is null and it is kept); vectors of different lengths are not linked; equal
vectors are links of each other; repeated rows of an id are one vector, each with a row of the result; an id with different
vectors has a row for each, all in one component; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from psephos.llm.common import arrow_map, batch_of, mix, saved
from psephos.llm.near_duplicates import components

#: Least cosine of a link.
COSINE = 0.98
#: Projections of a table and width of their cells, for unit vectors.
WIDTH, CELL = 8, 1.5
#: Probability below which a pair at the threshold may share no bucket.
UNSEEN = 1e-6
#: Classes of a bucket that are compared at once with as many others.
CHUNK = 1024
#: Groups up to this size are compared by shifted rows, larger ones by a product of matrices.
SMALL = 16
#: Rows that are gathered before whole buckets are compared.
GATHERED = 8192


def tables(cosine: float = COSINE) -> int:
    """Tables that it takes to miss a pair at the threshold less often than UNSEEN."""
    r = CELL / math.sqrt(2 - 2 * cosine)
    same = math.erf(r / math.sqrt(2)) - math.sqrt(2 / math.pi) / r * (1 - math.exp(-r * r / 2))
    return math.ceil(math.log(UNSEEN) / math.log1p(-(same**WIDTH)))


@lru_cache(maxsize=8)
def projections(dim: int, n_tables: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(dim)
    return rng.standard_normal((dim, n_tables * WIDTH)), rng.uniform(0, CELL, n_tables * WIDTH)


def bucket_keys(unit: np.ndarray, n_tables: int) -> np.ndarray:
    """32 bits of each table's cell of unit vectors."""
    a, b = projections(unit.shape[1], n_tables)
    cells = np.floor((unit @ a + b) / CELL).astype(np.int64).view(np.uint64).reshape(len(unit), n_tables, WIDTH)
    key = np.zeros(cells.shape[:2], np.uint64)
    with np.errstate(over="ignore"):
        for k in range(WIDTH):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + cells[:, :, k] + np.uint64(1))
    return (key >> np.uint64(32)).astype("<u4")


def units(x: np.ndarray) -> np.ndarray:
    """Rows over their norms; an exact scaling by powers of two comes first, so that squares neither overflow nor vanish."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, products over norms."""
    x, y = (np.ldexp(v, -np.frexp(np.abs(v).max(axis=1))[1][:, None]) for v in (x, y))
    return (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))


def sketched(rows: DataFrame) -> DataFrame:
    """(vec_id, grp, digest, x): group of equal label and length, digest of group and vector, and the vector's bytes; nulls for
    vectors that link with nothing."""
    kind = "<f4" if isinstance(rows.schema["embedding"].dataType.elementType, T.FloatType) else "<f8"
    types = {"vec_id": pa.int64(), "grp": pa.string(), "digest": pa.binary(), "x": pa.binary()}

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        vectors, labels, ids = b.column("embedding"), b.column("label").to_pylist(), b.column("vec_id")
        out: tuple[list, list, list] = ([], [], [])
        for v, label, known in zip(vectors, labels, ids.is_valid().to_pylist(), strict=True):
            grp = digest = data = None
            if known and label is not None and v.is_valid and len(v.values) and not v.values.null_count:
                x = v.values.to_numpy().astype(kind) + 0.0  # one zero only
                if np.isfinite(x).all() and x.any():
                    grp, data = f"{len(x)}:{label}", x.tobytes()
                    digest = xxhash.xxh3_128_digest(grp.encode() + b"\0" + data)
            for column, value in zip(out, (grp, digest, data), strict=True):
                column.append(value)
        return batch_of({"vec_id": ids, "grp": out[0], "digest": out[1], "x": out[2]}, types)

    return arrow_map(rows, fn, "vec_id bigint, grp string, digest binary, x binary")


def keyed(classes: DataFrame, kind: str, n_tables: int) -> DataFrame:
    """The classes (grp, digest, id, n, x) with ``keys``, the bytes of their bucket in each table."""
    types = {"grp": pa.string(), "digest": pa.binary(), "id": pa.int64(), "n": pa.int64(), "x": pa.binary(), "keys": pa.binary()}

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        raw = b.column("x").to_pylist()
        keys: list[bytes] = [b""] * len(raw)
        for size in set(map(len, raw)):
            at = [k for k, r in enumerate(raw) if len(r) == size]
            found = bucket_keys(units(np.frombuffer(b"".join(raw[k] for k in at), kind).reshape(len(at), -1).astype(float)), n_tables)
            for k, key in zip(at, found, strict=True):
                keys[k] = key.tobytes()
        return batch_of({n: b.column(n) for n in types if n != "keys"} | {"keys": keys}, types)

    return arrow_map(classes, fn, "grp string, digest binary, id bigint, n bigint, x binary, keys binary")


def entries(classes: DataFrame, n_tables: int) -> DataFrame:
    """(grp, tab, cell, digest): a row for each class and table."""
    types = {"grp": pa.string(), "tab": pa.int32(), "cell": pa.int64(), "digest": pa.binary()}

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        keys = np.frombuffer(b"".join(b.column("keys").to_pylist()), "<u4").reshape(-1, n_tables)
        at = pa.array(np.repeat(np.arange(b.num_rows), n_tables))
        return batch_of({"grp": b.column("grp").take(at), "tab": np.tile(np.arange(n_tables, dtype=np.int32), b.num_rows), "cell": keys.ravel().astype(np.int64), "digest": b.column("digest").take(at)}, types)

    return arrow_map(classes.select("grp", "digest", "keys"), fn, "grp string, tab int, cell bigint, digest binary")


def near_pairs(unit: np.ndarray, raw: np.ndarray, bounds: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the pairs within groups, given by their bounds, that reach the cosine."""
    group = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    small = (np.diff(bounds) <= SMALL)[group]
    left, right = [], []

    def keep(i: np.ndarray, j: np.ndarray, c: np.ndarray) -> None:
        near = c >= cosine - 1e-9
        i, j, c = i[near], j[near], c[near]
        close = np.flatnonzero(np.abs(c - cosine) < 1e-9)
        for k in range(0, len(close), GATHERED):  # so near the threshold that rounding may decide
            s = close[k : k + GATHERED]
            c[s] = cosines(raw[i[s]], raw[j[s]])
        left.append(i[c >= cosine])
        right.append(j[c >= cosine])

    for d in range(1, min(SMALL, len(group))):
        i = np.flatnonzero((group[:-d] == group[d:]) & small[:-d])
        if not len(i):
            break
        keep(i, i + d, np.einsum("ij,ij->i", unit[i], unit[i + d]))
    for k in np.flatnonzero(np.diff(bounds) > SMALL):
        a, b = bounds[k], bounds[k + 1]
        for start in range(a, b, CHUNK):
            c = unit[start : min(start + CHUNK, b)] @ unit[start:b].T
            i, j = np.nonzero(c >= cosine - 1e-9)
            up = j > i
            keep(i[up] + start, j[up] + start, c[i[up], j[up]])
    return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, np.int64), np.empty(0, np.int64))


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node that the pairs lead to."""
    least = np.arange(n)
    while True:
        low = np.minimum(least[i], least[j])
        before = least.copy()
        np.minimum.at(least, i, low)
        np.minimum.at(least, j, low)
        np.minimum.at(least, before, least)  # roots follow their members
        least = least[least]
        if (least == before).all():
            return least


def compared(rows: DataFrame, kind: str, n_tables: int, cosine: float) -> DataFrame:
    """(digest, more, a, b): for each class of a block that is linked the links that the block adds, and an edge of its forest."""
    types = {"digest": pa.binary(), "more": pa.int64(), "a": pa.int64(), "b": pa.int64()}
    group = ["grp", "tab", "cell", "low", "high"]

    def block(t: pa.Table, bounds: np.ndarray) -> pa.RecordBatch | None:
        raw = np.frombuffer(b"".join(t.column("x").to_pylist()), kind).reshape(t.num_rows, -1).astype(float)
        i, j = near_pairs(units(raw), raw, bounds, cosine)
        part, tab = t.column("part").to_numpy(), t.column("tab").to_numpy()
        across = (t.column("low").to_numpy() == t.column("high").to_numpy())[i] | (part[i] != part[j])
        i, j = i[across], j[across]
        keys = np.frombuffer(b"".join(t.column("keys").to_pylist()), "<u4").reshape(t.num_rows, n_tables)
        fresh = np.ones(len(i), bool)
        for k in range(n_tables - 1):
            fresh &= (keys[i, k] != keys[j, k]) | (tab[i] <= k)
        i, j = i[fresh], j[fresh]
        if not len(i):
            return None
        n, more = t.column("n").to_numpy(), np.zeros(t.num_rows, np.int64)
        np.add.at(more, i, n[j])
        np.add.at(more, j, n[i])
        least, at, ids = forest(t.num_rows, i, j), np.flatnonzero(more), t.column("id").to_numpy()
        return batch_of({"digest": t.column("digest").take(pa.array(at)).combine_chunks(), "more": more[at], "a": ids[at], "b": ids[least[at]]}, types)

    def whole(t: pa.Table) -> Iterator[pa.RecordBatch]:
        """The blocks of a table of whole blocks; those of equal vector length are compared together."""
        size = pc.binary_length(t.column("x")).to_numpy()
        for s in np.unique(size):
            own = t.take(pa.array(np.flatnonzero(size == s))) if (size != s).any() else t
            if (out := block(own, np.append(starts(own), own.num_rows))) is not None:
                yield out

    def starts(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        new[:1] = True
        for name in group:
            c = t.column(name).combine_chunks()
            new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
        return np.flatnonzero(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) < GATHERED:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            last = int(starts(t)[-1])  # the last block may go on
            if last:
                yield from whole(t.slice(0, last))
            held = t.slice(last).combine_chunks().to_batches()
        if held:
            yield from whole(pa.Table.from_batches(held).combine_chunks())

    spread = rows.repartition(*group).sortWithinPartitions(*group)
    return spread.mapInArrow(run, "digest binary, more bigint, a bigint, b bigint")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Per row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id (the least vec_id reachable), kept."""
    element = vectors.select("embedding").schema[0].dataType.elementType
    kind, elements = ("<f4", "array<float>") if isinstance(element, T.FloatType) else ("<f8", "array<double>")
    rows = sketched(vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast(elements).alias("embedding"), F.col("label").cast("string").alias("label")))
    n_tables = tables(cosine)
    usable = rows.where("digest IS NOT NULL")
    once = usable.groupBy("digest", "vec_id").agg(F.first("grp").alias("grp"), F.first("x").alias("x"))
    classes = once.groupBy("digest").agg(F.first("grp").alias("grp"), F.min("vec_id").alias("id"), F.count("*").alias("n"), F.first("x").alias("x"))
    classes = saved(keyed(classes.select("grp", "digest", "id", "n", "x"), kind, n_tables), "classes")

    keys = saved(entries(classes, n_tables), "entries")
    bucket = ["grp", "tab", "cell"]
    full = saved(keys.groupBy(*bucket).agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("parts"), F.count("*").alias("size")).where("size > 1").drop("size"), "full")
    placed = keys.join(full, bucket).withColumn("part", F.pmod(F.xxhash64("digest", "tab"), F.col("parts")).cast("int"))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumns({"low": F.least("part", "other"), "high": F.greatest("part", "other")})
    whole = met.select("digest", "tab", "cell", "low", "high", "part").join(classes, "digest")
    found = saved(compared(whole, kind, n_tables, cosine), "found")

    more = found.groupBy("digest").agg(F.sum("more").alias("more"))
    edges = found.where("a <> b").select("a", "b").distinct()
    several = usable.groupBy("vec_id").agg(F.min("digest").alias("d0"), F.max("digest").alias("d1")).where("d0 <> d1").select("vec_id")
    ids = classes.select("digest", "id")
    tied = usable.select("vec_id", "digest").join(several, "vec_id", "left_semi").join(ids, "digest").select(F.col("vec_id").alias("a"), F.col("id").alias("b")).where("a <> b").distinct()
    edges = saved(edges.unionByName(tied), "edges")
    reached = components(edges, edges.count()) if not edges.isEmpty() else edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    known = classes.select("digest", "id", "n").join(more, "digest", "left").join(reached, "id", "left")
    known = saved(known.select("digest", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component")), "known")
    out = rows.select("vec_id", "digest").join(known, "digest", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(F.col("vec_id").isNotNull(), component).alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
