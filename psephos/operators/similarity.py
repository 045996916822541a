"""Best matches by name within blocks: candidates are filtered by upper bounds of their similarity, and few are compared.

The bound of a pair of names comes from their lengths and letter counts. Of each target only the best two scores are kept; a
pair is compared only while its bound, less the deduction for the difference of shares, reaches the second best score found. A
block is dealt into parts of targets and of candidates, and each pair of parts meets in one group, so that the largest array is
``TARGETS`` by ``POOL`` numbers, and what leaves a group is two rows for each target.

Most targets need none of this. Distinct names meet first where they are equal after one or two characters are left out of
either (:func:`close_pairs`), which takes work in proportion to the names and their close neighbours. A target is done where
both of its best scores exceed what any name can have that it has not met; the rest goes through the comparison by bounds. Pairs
of names travel as two numbers, once for all blocks; pairs of rows are formed in the task that has a slice of the targets' names.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Targets and candidates that meet at once.
TARGETS, POOL = 512, 2048
#: Candidates of a target that are compared in one round, and numbers in an array of edit distances.
ROUND, CELLS = 12, 1 << 22
#: Letters from which a text is compared by itself, and pairs of shorter texts that are compared together.
LONG, TOGETHER = 100, 1 << 14
#: Distinct names of targets that meet their close names in one task; parts that the rows of a pool name are dealt to at most.
SLICE, PIECES = 4096, 64
#: Pairs of rows in a task's arrays.
SPREAD = 1 << 18

#: Letters of the longest name that is indexed, and of the longest with one character left out instead of two.
LONGEST, SHORT = 64, 20
#: Pool names that meet in a shortened text at most; kinds of letters told apart; names of a kind that far names still meet, if
#: they may be as similar as that.
BUCKET, SIGNS, FEW, WORTH = 4096, 256, 512, 0.92

KINDS = ("ratio", "edit")


def letter_counts(names: list[str], letters: dict[str, int]) -> np.ndarray:
    """A row of counts for each name; letters beyond the table share its last column, which keeps a bound a bound."""
    out = np.zeros((len(names), len(letters) + 1), np.int32)
    for row, name in zip(out, names, strict=True):
        for c, n in Counter(name).items():
            row[letters.get(c, len(letters))] += n
    return out


class Names:
    """Distinct names of one side with their lengths, letter counts and codes."""

    def __init__(self, names: list[str], letters: dict[str, int]):
        self.names, at = np.unique(np.array(names, dtype=object), return_inverse=True) if names else (np.array([], dtype=object), np.array([], int))
        self.at = at.ravel()
        self.lengths = np.array([len(n) for n in self.names], np.int64)
        self.counts = letter_counts(list(self.names), letters)


def bounds(a: Names, b: Names, kind: str) -> np.ndarray:
    """The most that the similarity of each pair of distinct names can be."""
    common = np.zeros((len(a.names), len(b.names)), np.int32)
    for k in range(a.counts.shape[1]):
        common += np.minimum(a.counts[:, k][:, None], b.counts[:, k][None, :])
    la, lb = a.lengths[:, None], b.lengths[None, :]
    some = (la > 0) & (lb > 0)
    if kind == "ratio":
        return np.where(some, 2 * common / np.maximum(la + lb, 1), 0.0)
    longest = np.maximum(np.maximum(la, lb), 1)
    return np.where(some, 1 - (longest - common) / longest, 0.0)


def edit_distances(a: list[str], b: list[str]) -> np.ndarray:
    """The edit distance of each pair, a row of the table at a time for all pairs of like length."""
    la, lb = (np.array([len(x) for x in s], np.int64) for s in (a, b))
    out = np.zeros(len(a), np.int64)
    order = np.argsort(np.maximum(la, lb), kind="stable")
    k = 0
    while k < len(order):
        step = max(1, CELLS // max(1, int(max(la[order[k]], lb[order[k]])) + 8))
        at = order[k : k + step]
        wide = max(1, CELLS // (int(max(la[at].max(), lb[at].max())) + 1))
        at = at[:wide]
        k += len(at)
        m, n = int(la[at].max(initial=0)), int(lb[at].max(initial=0))
        x, y = np.full((len(at), m), -1, np.int32), np.full((len(at), n), -2, np.int32)
        for row, (i, rx, ry) in enumerate(zip(at.tolist(), x, y, strict=True)):
            rx[: len(a[i])] = np.frombuffer(a[i].encode("utf-32-le", "surrogatepass"), np.int32)
            ry[: len(b[i])] = np.frombuffer(b[i].encode("utf-32-le", "surrogatepass"), np.int32)
        places = np.arange(n + 1, dtype=np.int32)
        row = np.broadcast_to(places, (len(at), n + 1)).copy()
        last = lb[at]
        found = np.where(la[at] == 0, last, 0)
        for i in range(m):
            best = np.empty_like(row)
            best[:, 0] = i + 1
            np.minimum(row[:, 1:] + 1, row[:, :-1] + (y != x[:, i : i + 1]), out=best[:, 1:])
            row = np.minimum.accumulate(best - places, axis=1) + places  # insertions
            ends = np.flatnonzero(la[at] == i + 1)
            found[ends] = row[ends, last[ends]]
        out[at] = found
    return out


def _longest_runs(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each pair of rows the length of the longest run of equal letters and where it begins in either: of equal ones the first."""
    size, i0, j0 = (np.zeros(len(x), np.int16) for _ in range(3))
    run, places = np.zeros((len(x), y.shape[1] + 1), np.int16), np.arange(len(x))
    for i in range(x.shape[1]):
        run[:, 1:] = np.where(y == x[:, i : i + 1], run[:, :-1] + 1, 0)
        j = run.argmax(axis=1)
        top = run[places, j]
        more = top > size
        size[more], i0[more], j0[more] = top[more], i + 1 - top[more], j[more] - top[more]
    return size, i0, j0


def matched(a: list[str], b: list[str]) -> np.ndarray:
    """Letters in matching runs of each pair, as ``SequenceMatcher`` finds them in texts of under 200 letters: the longest run, then
    those on either side of it. All pairs are taken a level at a time."""
    x, y = (_codes(s, fill) for s, fill in ((a, -1), (b, -2)))
    row = np.arange(len(a))
    a0, a1, b0, b1 = np.zeros(len(a), int), np.array([len(s) for s in a], int), np.zeros(len(b), int), np.array([len(s) for s in b], int)
    out = np.zeros(len(a), np.int64)
    while len(row):
        m, n = np.arange((a1 - a0).max(initial=0)), np.arange((b1 - b0).max(initial=0))
        xs = np.where(m < (a1 - a0)[:, None], x[row[:, None], np.minimum(a0[:, None] + m, x.shape[1] - 1)], -1)
        ys = np.where(n < (b1 - b0)[:, None], y[row[:, None], np.minimum(b0[:, None] + n, y.shape[1] - 1)], -2)
        size, i, j = (v.astype(int) for v in _longest_runs(xs, ys))
        np.add.at(out, row, size)
        i, j = a0 + i, b0 + j
        sides = ((row, a0, i, b0, j), (row, i + size, a1, j + size, b1))
        row, a0, a1, b0, b1 = (np.concatenate(v) for v in zip(*([v[(size > 0) & (s[1] < s[2]) & (s[3] < s[4])] for v in s] for s in sides), strict=True))
    return out


def _codes(texts: list[str], fill: int) -> np.ndarray:
    """A row of code points for each text."""
    lengths = np.array([len(t) for t in texts], int)
    out = np.full((len(texts), max(1, lengths.max(initial=0))), fill, np.int32)
    out[np.arange(out.shape[1]) < lengths[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.int32)
    return out


def similarities(a: list[str], b: list[str], kind: str) -> np.ndarray:
    """Of each pair; 0 if either side is empty."""
    if kind == "ratio":
        long = np.array([max(len(x), len(y)) >= LONG for x, y in zip(a, b, strict=True)], bool)
        out = np.zeros(len(a))
        for k in np.flatnonzero(long):
            out[k] = SequenceMatcher(None, a[k], b[k]).ratio() if a[k] and b[k] else 0.0
        short = np.flatnonzero(~long)
        for at in range(0, len(short), TOGETHER):
            some = short[at : at + TOGETHER]
            p, q = [a[k] for k in some], [b[k] for k in some]
            whole = np.array([len(u) + len(v) if u and v else 0 for u, v in zip(p, q, strict=True)], float)
            out[some] = np.where(whole > 0, 2.0 * matched(p, q) / np.maximum(whole, 1), 0.0)
        return out
    longest = np.array([max(len(x), len(y)) for x, y in zip(a, b, strict=True)], float)
    some = np.array([bool(x and y) for x, y in zip(a, b, strict=True)], bool)
    return np.where(some, 1 - edit_distances(a, b) / np.maximum(longest, 1), 0.0)


def joined(local: str, eng: str) -> str:
    return " ".join(x for x in (local, eng) if x).strip(" ")


class Pairs:
    """Similarities of the names of targets and candidates: the best of five, each pair of distinct names compared once."""

    def __init__(self, targets: tuple[list[str], list[str]], pool: tuple[list[str], list[str]], kind: str):
        letters = {c: k for k, (c, _) in enumerate(Counter("".join(dict.fromkeys(x for side in (*targets, *pool) for x in side))).most_common(63))}
        a, b = ([Names(list(s), letters) for s in (*side, [joined(x, y) for x, y in zip(*side, strict=True)])] for side in (targets, pool))
        self.kind = kind
        self.views = [(a[i], b[j]) for i, j in ((0, 0), (1, 1), (2, 2), (0, 1), (1, 0))]
        self.most = [bounds(x, y, kind) for x, y in self.views]
        self.known = [np.full(m.shape, np.nan) for m in self.most]

    def bound(self) -> np.ndarray:
        """Of each target and candidate."""
        out = np.zeros((len(self.views[0][0].at), len(self.views[0][1].at)))
        for (x, y), most in zip(self.views, self.most, strict=True):
            np.maximum(out, most[np.ix_(x.at, y.at)], out=out)
        return out

    def exact(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Of the given targets and candidates. A kind of name is compared only where it may exceed the others' value."""
        out = np.zeros(len(i))
        order = range(len(self.views))
        for k in order:
            (x, y), most, known = self.views[k], self.most[k], self.known[k]
            u, v = x.at[i], y.at[j]
            todo = np.flatnonzero(np.isnan(known[u, v]) & (most[u, v] > out))
            if len(todo):
                both = np.unique(u[todo] * len(y.names) + v[todo])
                p, q = np.divmod(both, len(y.names))
                known[p, q] = similarities(list(x.names[p]), list(y.names[q]), self.kind)
            out = np.fmax(out, known[u, v])
        return out


def best_two(pairs: Pairs, deduction: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(target, candidate, score) of the two best allowed candidates of each target, the first of equal ones."""
    n, m = deduction.shape
    score = np.where(allowed, pairs.bound() * 100 - deduction, -np.inf)
    exact = ~allowed
    keep = min(2, m)
    while True:
        second = np.partition(np.where(exact, score, -np.inf), m - keep, axis=1)[:, m - keep]
        open_ = ~exact & (score >= second[:, None])
        if not open_.any():
            break
        rank = np.where(open_, score, -np.inf)
        take = min(ROUND, m)
        at = np.argpartition(-rank, take - 1, axis=1)[:, :take] if take < m else np.broadcast_to(np.arange(m), (n, m))
        i = np.repeat(np.arange(n), at.shape[1])
        j = at.ravel()
        hit = open_[i, j]
        i, j = i[hit], j[hit]
        score[i, j] = pairs.exact(i, j) * 100 - deduction[i, j]
        exact[i, j] = True
    final = np.where(exact & allowed, score, -np.inf)
    first = final.argmax(axis=1)
    rows = np.arange(n)
    best = final[rows, first]
    final[rows, first] = -np.inf
    next_ = final.argmax(axis=1)
    i, j, s = np.concatenate([rows, rows]), np.concatenate([first, next_]), np.concatenate([best, final[rows, next_]])
    return i[np.isfinite(s)], j[np.isfinite(s)], s[np.isfinite(s)]


def once(df: DataFrame) -> DataFrame:
    """A table that is worked out once: written to the folder that the session names in spark.checkpoint.dir, or cached where it
    names none."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        return df.persist()
    path = f"{folder.rstrip('/')}/names-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _parts(rows: DataFrame, keys: list[str], size: int, name: str) -> DataFrame:
    """How many parts each group of rows is dealt to."""
    return rows.groupBy(*keys).agg(F.ceil(F.count("*") / size).cast("int").alias(name))


def top_two(targets: DataFrame, pool: DataFrame, keys: list[str], tolerance: float | None, most: float, kind: str) -> DataFrame:
    """(_t, _id, score, _gap): of each target the two best candidates with equal (known) ``keys``, by score and then id. Both sides
    have ``_local``, ``_eng`` and ``_share``; with a tolerance only candidates whose share is as near as that, or unknown, count."""
    parts = _parts(targets, keys, TARGETS, "_a_n").join(_parts(pool, keys, POOL, "_b_n"), keys)  # groups that have both
    # each part of one side goes to all parts of the other
    own = targets.join(parts, keys).withColumns({"_a": F.pmod(F.xxhash64("_t"), F.col("_a_n")).cast("int"), "_b": F.explode(F.sequence(F.lit(0), F.col("_b_n") - 1))})
    other = pool.join(parts, keys).withColumns({"_b": F.pmod(F.xxhash64("_id"), F.col("_b_n")).cast("int"), "_a": F.explode(F.sequence(F.lit(0), F.col("_a_n") - 1))})
    kinds = {"_t": own.schema["_t"].dataType, "_id": other.schema["_id"].dataType}
    schema = f"_t {kinds['_t'].simpleString()}, _id {kinds['_id'].simpleString()}, score double, _gap double"
    arrow = pa.schema([*((n, to_arrow_type(k)) for n, k in kinds.items()), ("score", pa.float64()), ("_gap", pa.float64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return arrow.empty_table()
        right = right.sort_by("_id")
        names = [tuple([x or "" for x in t.column(c).to_pylist()] for c in ("_local", "_eng")) for t in (left, right)]
        share = [t.column("_share").to_numpy(zero_copy_only=False).astype(float) for t in (left, right)]
        gap = np.abs(share[0][:, None] - share[1][None, :])
        allowed = np.ones(gap.shape, bool) if tolerance is None else np.isnan(gap) | (gap <= tolerance)
        i, j, score = best_two(Pairs(*names, kind), np.nan_to_num(np.minimum(gap, most), nan=0.0), allowed)
        gaps = pa.array(gap[i, j], from_pandas=True)
        return pa.Table.from_arrays([left.column("_t").take(pa.array(i)), right.column("_id").take(pa.array(j)), pa.array(score), gaps], schema=arrow)

    group = [*keys, "_a", "_b"]
    fields = ["_local", "_eng", "_share"]
    # few bytes become much work here: the number of partitions is given, so that they are not taken together
    parts = int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own, other = own.select(*group, "_t", *fields).repartition(parts, *group), other.select(*group, "_id", *fields).repartition(parts, *group)
    found = own.groupBy(*group).cogroup(other.groupBy(*group)).applyInArrow(run, schema)
    return kept_two(found)


def reach(n: int) -> int:
    """How many characters are left out of a name of ``n``; less than none if it is not indexed."""
    return -1 if n > LONGEST else 1 if n <= SHORT else 2


def shortened(text: str) -> set[str]:
    """The text without any characters that may be left out."""
    return {"".join(text[a:b] for a, b in zip((0, *(k + 1 for k in at)), (*at, len(text)), strict=True)) for n in range(reach(len(text)) + 1) for at in combinations(range(len(text)), n)}


def sign(text: str) -> str:
    """The letters of a text in order, digits being one kind."""
    return "".join(sorted("0" if c in "123456789" else c for c in text))


def views(local: str, eng: str) -> set[str]:
    return {x for x in (local, eng, joined(local, eng)) if x}


def far_bound(a: int, b: int, common: int, kind: str) -> float:
    """The most that the similarity of names of these lengths can be if they have not met: two that have more letters in order in
    common than this have a shortened text in common."""
    most = min(common, a, b)
    if reach(a) >= 0 and reach(b) >= 0:
        most = min(most, max(a - reach(a), b - reach(b)) - 1)
    return max(most, 0) * 2 / (a + b) if kind == "ratio" else max(most, 0) / max(a, b)


def _listed(names: DataFrame, key: str, field: str, of) -> DataFrame:
    """The names' ``key`` with each text of ``of`` their views."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                texts = [list(set().union(*map(of, views(x, y)))) for x, y in zip(b.column("_l").to_pylist(), b.column("_e").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(key), pa.array(texts, pa.list_(pa.string()))], names=[key, field])

    return names.select(key, "_l", "_e").mapInArrow(run, f"{key} long, {field} array<string>").withColumn(field, F.explode(field))


def _bounded(names: DataFrame, kinds: list[tuple[int, str | None, int]], kind: str) -> DataFrame:
    """Names (_a, _h, _l, _e) with ``_open``, what names that they do not meet may reach, and ``_cross``, the few kinds they meet whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parsed = [(n, letters, Counter(letters) if letters is not None else None, count) for n, letters, count in kinds]

        @lru_cache(4096)
        def of(own: str) -> tuple[float, tuple[str, ...]]:
            most, cross, mine = 0.0, [], Counter(own)
            for n, letters, counts, count in parsed:
                value = far_bound(len(own), n, min(len(own), n) if counts is None else (mine & counts).total(), kind)
                if value > WORTH and counts is not None and count <= FEW:
                    cross.append(letters)
                else:
                    most = max(most, value)
            return most, tuple(cross)

        for b in batches:
            found = [[of(sign(v)) for v in views(x, y)] for x, y in zip(b.column("_l").to_pylist(), b.column("_e").to_pylist(), strict=True)]
            most = pa.array([max((m for m, _ in f), default=0.0) for f in found], pa.float64())
            cross = pa.array([list({c for _, cs in f for c in cs}) for f in found], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in ("_a", "_h", "_l", "_e")), most, cross], names=["_a", "_h", "_l", "_e", "_open", "_cross"])

    return names.select("_a", "_h", "_l", "_e").mapInArrow(run, "_a long, _h int, _l string, _e string, _open double, _cross array<string>")


#: Kinds of names of targets and candidates that are compared: local, English, both.
_ORDER = ((1, 1), (2, 2), (0, 0), (0, 1), (1, 0))


def close_pairs(names: DataFrame, others: DataFrame, kind: str) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Distinct names of targets (_a, _h, _l, _e, _open) and of the pool (_b, _l, _e), and the pairs (_a, _b) that may have a
    similarity above ``_open``, without loss; a name that meets a crowded shortened text has no pairs at all. ``_h`` numbers slices
    of the targets' names in their order, so that names in a slice have many close names in common; the last value is how many.
    Texts meet as hashes: a chance meeting makes a pair more, which the comparison drops."""
    spark = names.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = once(names.distinct())
    slices = max(min(parts, 4 * spark.sparkContext.defaultParallelism), -(-names.count() // SLICE))
    names = names.repartitionByRange(slices, "_e", "_l").withColumns({"_h": F.spark_partition_id(), "_a": F.monotonically_increasing_id()})
    others = once(others.distinct().repartition(parts).withColumn("_b", F.monotonically_increasing_id()))
    signs = _listed(others, "_b", "_s", lambda v: {sign(v)})
    found = signs.groupBy("_s").count().limit(SIGNS + 1).collect()
    kinds = [(len(r["_s"]), r["_s"], r["count"]) for r in found]
    if len(kinds) > SIGNS:
        kinds = [(r[0], None, 0) for r in signs.select(F.length("_s")).distinct().collect()]
    names = once(_bounded(names, kinds, kind))
    own, pool = (once(_listed(side.repartition(parts), key, "_v", shortened).select(key, F.xxhash64("_v").alias("_v"))) for side, key in ((names, "_a"), (others, "_b")))
    crowded = pool.groupBy("_v").count().where(F.col("count") > BUCKET).select("_v")
    stuck = own.join(crowded, "_v", "left_semi").select("_a").distinct()
    met = own.join(pool.join(crowded, "_v", "left_anti"), "_v").select("_a", "_b")
    whole = names.select("_a", F.explode("_cross").alias("_s")).join(signs, "_s").select("_a", "_b")
    pairs = once(met.unionByName(whole).distinct().join(stuck, "_a", "left_anti"))
    return names.drop("_cross"), others, pairs, slices


def _spread(counts: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each place as often as its count says, and the number of the time; about ``most`` at once, or those of one place."""
    upto, at = np.cumsum(counts), 0
    while at < len(counts):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
        n = counts[at:end]
        yield np.repeat(np.arange(at, end), n), np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        at = end


def _close_similarities(own: pa.Table, pool: pa.Table, a: np.ndarray, b: np.ndarray, open_: np.ndarray, kind: str) -> np.ndarray:
    """Of the pairs of names ``a`` and ``b``, the best of the kinds of names, or 0 where it does not exceed ``open_``. A kind is
    compared only where its bound from lengths and letter counts exceeds that and the others' value."""
    sides = []
    for t in (own, pool):
        local, eng = t.column("_l").to_pylist(), t.column("_e").to_pylist()
        sides.append([local, eng, [joined(x, y) for x, y in zip(local, eng, strict=True)]])
    letters = {c: k for k, (c, _) in enumerate(Counter("".join(x for side in sides for x in (*side[0], *side[1]))).most_common(63))}
    counts = [[letter_counts(s, letters).astype(np.uint8 if max(map(len, s), default=0) < 256 else np.int32) for s in side] for side in sides]
    sizes = [[np.array([len(x) for x in s], float) for s in side] for side in sides]
    alone = [np.array([x == y for x, y in zip(side[1], side[2], strict=True)], bool) for side in sides]  # the English name is all there is
    out = np.zeros(len(a))
    for at in range(0, len(a), TOGETHER):
        p, q = a[at : at + TOGETHER], b[at : at + TOGETHER]
        sim, least = np.zeros(len(p)), open_[at : at + TOGETHER]
        for x, y in _ORDER:
            la, lb = sizes[0][x][p], sizes[1][y][q]
            common = np.minimum(counts[0][x][p], counts[1][y][q]).sum(axis=1)
            most = 2 * common / np.maximum(la + lb, 1) if kind == "ratio" else 1 - (np.maximum(la, lb) - common) / np.maximum(np.maximum(la, lb), 1)
            fresh = ~(alone[0][p] & alone[1][q]) if (x, y) == (2, 2) else True
            todo = np.flatnonzero((la > 0) & (lb > 0) & fresh & (most > np.maximum(sim, least)))
            if len(todo):
                sim[todo] = np.maximum(sim[todo], similarities([sides[0][x][k] for k in p[todo]], [sides[1][y][k] for k in q[todo]], kind))
        out[at : at + TOGETHER] = np.where(sim > least, sim, 0.0)
    return out


def _first_two(t: np.ndarray, row: np.ndarray, score: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Places of the two best of each target, by score and then the candidate's rank."""
    order = np.lexsort((rank[row], -score, t))
    own = t[order]
    third = np.zeros(len(own), bool)
    third[2:] = own[2:] == own[:-2]
    return order[~third]


def top_two_close(targets: DataFrame, pool: DataFrame, keys: list[str], tolerance: float, most: float, kind: str) -> DataFrame:
    """:func:`top_two` of the targets that close names decide: both best scores exceed all that other names can have.

    A slice of the targets' names is one group: its targets, its pairs of names, and once each the pool names that any of them
    meets, with their rows. Pairs of rows exist only in the task's arrays, CELLS at a time; two for each target leave it."""
    spark = targets.sparkSession
    name = {"_l": F.coalesce("_local", F.lit("")), "_e": F.coalesce("_eng", F.lit(""))}
    left, right = targets.withColumns(name), pool.withColumns(name)
    names, others, pairs, slices = close_pairs(left.select("_l", "_e"), right.select("_l", "_e"), kind)
    blocks = once(left.select(*keys).distinct().withColumn("_k", F.monotonically_increasing_id()))
    own = left.join(blocks, keys).join(names.select("_a", "_h", "_l", "_e"), ["_l", "_e"]).select(F.col("_h").alias("_h"), "_a", "_k", "_t", "_share")
    rows = right.join(blocks, keys).join(others, ["_l", "_e"]).groupBy("_b", F.pmod(F.xxhash64("_id"), F.lit(PIECES)).alias("_piece"))
    rows = rows.agg(F.collect_list("_k").alias("_ks"), F.collect_list("_id").alias("_ids"), F.collect_list(F.coalesce("_share", F.lit(float("nan")))).alias("_shares"))
    rows = rows.join(others, "_b").select("_b", "_l", "_e", "_ks", "_ids", "_shares")
    needed = pairs.join(names.select("_a", "_h"), "_a").select("_h", "_b").distinct()
    met = needed.join(rows, "_b").select("_h", F.col("_b").alias("_n"), "_l", "_e", F.lit(None).cast("double").alias("_open"), F.lit(None).cast("array<long>").alias("_bs"), "_ks", "_ids", "_shares")
    each = pairs.groupBy("_a").agg(F.collect_list("_b").alias("_bs")).join(names, "_a")
    each = each.select("_h", F.col("_a").alias("_n"), "_l", "_e", "_open", "_bs", *(F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("_ks", "_ids", "_shares")))
    kinds = {"_t": own.schema["_t"].dataType, "_id": pool.schema["_id"].dataType}
    schema = f"_t {kinds['_t'].simpleString()}, _id {kinds['_id'].simpleString()}, score double, _gap double"
    arrow = pa.schema([*((n, to_arrow_type(k)) for n, k in kinds.items()), ("score", pa.float64()), ("_gap", pa.float64())])

    def run(target: pa.Table, other: pa.Table) -> pa.Table:
        is_pool = pc.is_null(other.column("_open"))
        mine, met = other.filter(pc.invert(is_pool)).combine_chunks(), other.filter(is_pool).combine_chunks()
        if not target.num_rows or not mine.num_rows or not met.num_rows:
            return arrow.empty_table()
        flat = lambda t, c: t.column(c).combine_chunks().flatten()
        spread = lambda t, c: pc.list_value_length(t.column(c)).to_numpy()
        number = lambda t, c: t.column(c).to_numpy()
        # the pool's rows, by name and block
        b, first, piece = np.unique(number(met, "_n"), return_index=True, return_inverse=True)
        block = np.unique(np.concatenate([number(target, "_k"), flat(met, "_ks").to_numpy()]))
        code = np.repeat(piece, spread(met, "_ks")) * len(block) + np.searchsorted(block, flat(met, "_ks").to_numpy())
        order = np.argsort(code, kind="stable")
        code, ids, p_share = code[order], flat(met, "_ids").take(pa.array(order)), flat(met, "_shares").to_numpy()[order]
        rank = pc.rank(ids, tiebreaker="min").to_numpy()
        # the targets, by name
        a = number(mine, "_n")
        by_name = np.argsort(a)
        t_a = np.searchsorted(a, number(target, "_a"), sorter=by_name)
        known = (t_a < len(a)) & (a[by_name[np.minimum(t_a, len(a) - 1)]] == number(target, "_a"))
        t_row = np.flatnonzero(known)
        t_name = by_name[t_a[t_row]]
        t_order = np.argsort(t_name, kind="stable")
        t_row, t_name = t_row[t_order], t_name[t_order]
        begin, n_own = np.searchsorted(t_name, np.arange(len(a))), np.bincount(t_name, minlength=len(a))
        t_block = np.searchsorted(block, number(target, "_k")[t_row])
        t_share = target.column("_share").to_numpy().astype(float)[t_row]
        # the pairs of names
        u, other_name = np.repeat(np.arange(len(a)), spread(mine, "_bs")), flat(mine, "_bs").to_numpy()
        v = np.minimum(np.searchsorted(b, other_name), len(b) - 1)
        here = b[v] == other_name  # others have rows in blocks without targets alone
        u, v = u[here], v[here]
        open_ = number(mine, "_open")
        sim = _close_similarities(mine, met.take(pa.array(first)), u, v, open_[u], kind)
        u, v, sim = u[sim > 0], v[sim > 0], sim[sim > 0]
        held = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0))]

        def two(rows: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
            found = [np.concatenate(x) for x in zip(*rows, strict=True)]
            kept = _first_two(found[0], found[1], found[2], rank)
            return tuple(x[kept] for x in found)

        begins, sizes = np.unique(code, return_index=True, return_counts=True)[1:]
        codes = code[begins]
        for pair, k in _spread(n_own[u], SPREAD):
            t = begin[u[pair]] + k
            at = v[pair] * len(block) + t_block[t]
            low = np.minimum(np.searchsorted(codes, at), len(codes) - 1)
            for place, more in _spread(np.where(codes[low] == at, sizes[low], 0), SPREAD):
                row, own_ = begins[low[place]] + more, t[place]
                gap = np.abs(t_share[own_] - p_share[row])
                near = np.isnan(gap) | (gap <= tolerance)
                own_, row, gap = own_[near], row[near], gap[near]
                score = sim[pair[place[near]]] * 100 - np.nan_to_num(np.minimum(gap, most), nan=0.0)
                held.append(two([(own_, row, score, gap)]))
                if sum(len(x[0]) for x in held[1:]) > 8 * SPREAD:
                    held = [two(held)]
        t, row, score, gap = two(held)  # in the order of targets, the better first
        second = 1 + np.flatnonzero((t[1:] == t[:-1]) & (score[1:] > open_[t_name[t[1:]]] * 100 + 1e-9))
        decided = np.sort(np.concatenate([second - 1, second]))
        t, row, score, gap = t[decided], row[decided], score[decided], gap[decided]
        return pa.Table.from_arrays([target.column("_t").take(pa.array(t_row[t])).combine_chunks(), ids.take(pa.array(row)), pa.array(score), pa.array(gap, from_pandas=True)], schema=arrow)

    own, other = own.repartition(slices, "_h"), met.unionByName(each).repartition(slices, "_h")
    return own.groupBy("_h").cogroup(other.groupBy("_h")).applyInArrow(run, schema)


def kept_two(found: DataFrame) -> DataFrame:
    """The two best rows of each target; tasks drop the others before they meet."""
    w = Window.partitionBy("_t").orderBy(F.desc("score"), "_id")
    return found.withColumn("_n", F.row_number().over(w)).where("_n <= 2").drop("_n")
