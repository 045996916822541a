"""Substring deduplication with compressed FM-indexes.

A window is 20 consecutive words; a word goes if a window over it has the same words as one that starts earlier (smaller id,
or the same document and an earlier start). The corpus is not indexed as one: equal windows hold the same smallest six-word
gram, so a text is cut into runs of windows around one such gram, and runs with different grams never need to meet.

1. One pass gives each run's gram hash and content hash. Grams that occur once are done with. Runs of equal content have equal
   matching statistics, so a content is searched once and all its runs take the result over. Grams and contents are
   aggregated before they are shuffled.
2. The contents of a gram form a group, and groups are dealt to shards of about ``SHARD_WORDS`` words. Each shard gets a
   compressed FM-index: the run-length encoded Burrows-Wheeler transform (suffixes sorted as deep as a window), whose run
   heads lie in a wavelet matrix of packed bits with rank directories. The shard's runs are streamed against it, and backward
   search gives each place where a window ends its matching statistic: how many words up to it are found at a second place as
   well, counted up to a window's length. Where that length is reached, all but the earliest place of the interval are reported, and every
   later run of the same content.
3. A group of more words than a shard (a passage in very many surroundings) is first divided by longer grams: a window's words
   beside the gram are halved, and windows go on with the gram and the longer half. Equal windows stay together, every division
   takes half of the open words, and after five a group is one window, so no group is too large. Runs that have become equal
   are one content again.

Defined cases: a null or blank text has no words; a very long text is cut into runs like any other; texts of fewer than 20 words
lose nothing; rows of one id with the same words are one document; of an id's rows with different words, those whose words have
the least digest are the document, and the others neither lose anything nor count as an occurrence; rows with a null id lose
nothing; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from psephos.llm.common import arrow_map, batch_of, gram_hashes, hashed_words, mix, powers, saved, small_batches, stable_text_hash

WINDOW = 20
GRAM = 6
SPAN = WINDOW - GRAM + 1
#: Words of a shard's text, about, and the most of a group.
SHARD_WORDS = 100_000

#: Bits of a place in :func:`last_smallest`.
PLACE_BITS = 24


def last_smallest(values: np.ndarray, span: int) -> np.ndarray:
    """For each window of ``span`` values where the smallest by its upper bits is, the last of equal ones.

    The place is packed into the lower bits, so that minima of doubling widths settle both; very long inputs go in parts.
    """
    most = (1 << PLACE_BITS) - 1
    if len(values) > most:
        step = most - span + 1
        return np.concatenate([k + last_smallest(values[k : k + most], span) for k in range(0, len(values) - span + 1, step)])
    low = np.uint64(most)
    packed = values & ~low | (low - np.arange(len(values), dtype=np.uint64))
    width = 1
    while 2 * width <= span:
        packed = np.minimum(packed[:-width], packed[width:])
        width *= 2
    if width < span:
        packed = np.minimum(packed[: len(packed) - span + width], packed[span - width :])
    return (low - (packed & low)).astype(np.int64)


def runs_of(text: str | None) -> tuple[np.ndarray, ...]:
    """Runs of windows that share the place of their smallest gram: first window, windows, the gram's place after it, gram hash, content hash."""
    h = hashed_words(text.encode("utf-8", "surrogatepass")) if text else np.empty(0, np.uint64)
    n = len(h) - WINDOW + 1
    if n <= 0:
        empty = np.empty(0, np.int64)
        return empty, empty, empty, empty, empty
    grams = gram_hashes(h, GRAM)
    place = last_smallest(grams, SPAN)
    start = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    size = np.diff(np.concatenate([start, [n]]))
    up, down = powers(len(h))
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)], dtype=np.uint64)])
        content = mix((total[start + size + WINDOW - 1] - total[start]) * down[start] + size.astype(np.uint64))
    return start, size, place[start] - start, grams[place[start]].view(np.int64), content.view(np.int64)


#: Bits of a symbol that a level of the wavelet matrix settles.
DIGIT = 3
#: The bits of a word below each of its bits.
BELOW = (np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1)


class WaveletMatrix:
    """Ranks of symbols in a sequence: a level for each three bits of a symbol, with a packed bit map for each of the eight digits
    and the ones before each of its words."""

    def __init__(self, symbols: np.ndarray, bits: int) -> None:
        self.shifts = range(DIGIT * (-(-bits // DIGIT) - 1), -1, -DIGIT)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.words = len(symbols) // 64 + 1
        now = symbols
        for shift in self.shifts:
            digit = (now >> shift) & ((1 << DIGIT) - 1)
            flags = np.zeros((1 << DIGIT, self.words * 64), bool)
            flags[digit, np.arange(len(now))] = True
            packed = np.packbits(flags, axis=1, bitorder="little").view("<u8").ravel()
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)[:-1]])  # digits one after the other, as the next level has them
            self.levels.append((packed, before.astype(np.int32)))
            now = now[np.argsort(digit.astype(np.uint8), kind="stable")]

    def follow(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where prefix lengths ``at`` end up behind the last level, on each symbol's path."""
        for shift, (packed, before) in zip(self.shifts, self.levels, strict=True):
            word = ((symbol >> shift) & ((1 << DIGIT) - 1)) * self.words + (at >> 6)
            at = before[word] + np.bitwise_count(packed[word] & BELOW[at & 63])
        return at


class FMIndex:
    """Backward search over a text of symbols 1, 2, ...; 0 separates its parts and matches nothing.

    Held are the runs of equal symbols in the transform: their heads in a wavelet matrix, where they start, and their summed
    lengths in the order of their symbols, which is where an interval goes in a step. The text is not held.
    """

    def __init__(self, text: np.ndarray, depth: int) -> None:
        n, top = len(text), int(text.max(initial=0))
        self.size, self.depth = n, depth
        rank = text.astype(np.int64)
        reach = 1
        while reach < depth:  # prefix doubling, no deeper than patterns are long
            second = np.zeros(n, np.int64)
            second[: n - reach] = rank[reach:] + 1
            key = rank * (n + top + 2) + second
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate([[0], (ordered[1:] != ordered[:-1]).astype(np.int64)]))
            reach *= 2
        transform = text[order - 1]
        self.starts = np.flatnonzero(np.concatenate([[True], transform[1:] != transform[:-1]])).astype(np.int32)
        self.heads = transform[self.starts].astype(np.int32)
        lengths = np.diff(np.append(self.starts, n))
        self.before = np.concatenate([[0], np.cumsum(lengths[np.argsort(self.heads, kind="stable")])]).astype(np.int32)
        self.matrix = WaveletMatrix(self.heads, max(1, top.bit_length()))
        counts = np.bincount(self.heads, minlength=top + 1)
        self.first = np.concatenate([[0], np.cumsum(counts)])  # heads of smaller symbols
        self.shift = self.first[:-1] - self.matrix.follow(np.arange(top + 1), np.zeros(top + 1, np.int64))

    def step(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the interval ends ``at`` go when ``symbol`` is put in front."""
        run = np.maximum(np.searchsorted(self.starts, at) - 1, 0)  # the run that the last row before it is in
        return self.before[self.matrix.follow(symbol, run) + self.shift[symbol]] + np.where(self.heads[run] == symbol, at - self.starts[run], 0)

    def matching_statistics(self, stream: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each of the places ``ends`` of the stream the length of the longest string that ends there and occurs twice in the
        text, up to ``depth``, and for those that reach it where their interval begins (-1 for others). Strings don't go
        across 0."""
        lengths, begins = np.zeros(len(ends), np.int32), np.full(len(ends), -1, np.int64)
        alive = np.flatnonzero(stream[ends] > 0)
        c = stream[ends[alive]]
        low, high = self.before[self.first[c]], self.before[self.first[c + 1]]
        for k in range(self.depth):
            if k:
                back = ends[alive] - k
                c = np.where(back >= 0, stream[back], 0)
                go = c > 0
                if not go.all():
                    alive, low, high, c = alive[go], low[go], high[go], c[go]
                low, high = self.step(c, low), self.step(c, high)
            many = high - low > 1
            if not many.all():
                alive, low, high = alive[many], low[many], high[many]
            lengths[alive] = k + 1
        begins[alive] = low
        return lengths, begins


def later_windows(parts: list[list[str]]) -> list[np.ndarray]:
    """For each part (in ascending order of place) the windows that occur earlier, in this or another part."""
    number: dict[str, int] = {}
    ids = [[number.setdefault(w, len(number) + 1) for w in p] for p in parts]
    sizes = np.array([len(x) + 1 for x in ids])
    text = np.fromiter((i for x in ids for i in (*x, 0)), np.int32, int(sizes.sum()))
    begin = np.cumsum(sizes) - sizes
    windows = sizes - WINDOW
    ends = np.repeat(begin + WINDOW - 1 - np.cumsum(windows) + windows, windows) + np.arange(int(windows.sum()))  # where a window ends
    lengths, low = FMIndex(text, WINDOW).matching_statistics(text, ends)  # a shard's runs are its stream
    full = np.flatnonzero(lengths == WINDOW)
    order = np.lexsort((full, low[full]))
    first = np.concatenate([[True], low[full[order]][1:] != low[full[order]][:-1]])[: len(order)]
    later = np.sort(ends[full[order][~first]]) - (WINDOW - 1)
    cut = np.searchsorted(later, np.append(begin, len(text)))
    return [later[cut[k] : cut[k + 1]] - begin[k] for k in range(len(parts))]


def intervals(starts: np.ndarray) -> list[tuple[int, int]]:
    """The word intervals that windows with these (ascending) starts cover."""
    if not len(starts):
        return []
    cut = np.flatnonzero(starts[1:] - starts[:-1] > 1)
    return list(zip(starts[np.concatenate([[0], cut + 1])].tolist(), (starts[np.concatenate([cut, [len(starts) - 1]])] + WINDOW).tolist(), strict=True))


#: Columns of a content that is to be searched: its first run, the place and length of the words that its group shares, whether
#: there are more runs of it, and its words, joined by one space.
SLICE = {
    "key": pa.int64(), "content": pa.int64(), "doc_id": pa.int64(), "pos": pa.int32(), "size": pa.int32(), "at": pa.int32(), "span": pa.int32(),
    "copied": pa.bool_(), "words": pa.string(),
}
SLICE_SCHEMA = "key bigint, content bigint, doc_id bigint, pos int, size int, at int, span int, copied boolean, words string"


def text_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, size, at, key, content) of all runs; ``key`` is the gram's hash, ``at`` its place in the run."""
    types = {"doc_id": pa.int64(), "pos": pa.int32(), "size": pa.int32(), "at": pa.int32(), "key": pa.int64(), "content": pa.int64()}

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        got = [runs_of(t) for t in b.column("text").to_pylist()]
        ids = np.repeat(b.column("doc_id").to_numpy(), [len(g[0]) for g in got])
        columns = [np.concatenate([g[k] for g in got]) for k in range(5)]
        return batch_of(dict(zip(types, [ids, *(c.astype(np.int32) for c in columns[:3]), *columns[3:]], strict=True)), types)

    return arrow_map(docs, fn, "doc_id bigint, pos int, size int, at int, key bigint, content bigint")


def _slices(docs: DataFrame, contents: DataFrame) -> DataFrame:
    """The contents (key, content, doc_id, pos, size, at, copied) with the words of their first runs."""
    wanted = contents.groupBy("doc_id").agg(F.collect_list(F.struct("key", "content", "pos", "size", "at", "copied")).alias("runs"))

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        out: dict[str, list] = {k: [] for k in SLICE}
        for doc_id, text, runs in zip(*(b.column(k).to_pylist() for k in ("doc_id", "text", "runs")), strict=True):
            words = text.encode("utf-8", "surrogatepass").split()
            for r in runs:
                for k, v in (r | {"doc_id": doc_id, "span": GRAM}).items():
                    out[k].append(v)
                out["words"].append(b" ".join(words[r["pos"] : r["pos"] + r["size"] + WINDOW - 1]).decode("utf-8", "surrogatepass"))
        return batch_of(out, SLICE)

    return arrow_map(docs.join(wanted, "doc_id"), fn, SLICE_SCHEMA)


def halves(size: int, at: int, span: int) -> list[tuple[str, int, int, int, int]]:
    """A run's windows by which half of the words beside its shared ones they have: (side, first window, windows, place and
    length of the words shared then) of each half. A window that shares all its words stays as it is."""
    rest = WINDOW - span
    if not rest:
        return [("all", 0, size, at, span)]
    take = (rest + 1) // 2
    left = min(max(at - take + 1, 0), size)
    out = [("left", 0, left, at - take, span + take)] if left else []
    return out + ([("right", left, size - left, at - left, span + rest - take + 1)] if left < size else [])


def _divided(slices: DataFrame) -> DataFrame:
    """The runs of ``slices`` divided into halves, under longer grams."""

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        out: dict[str, list] = {k: [] for k in SLICE}
        for doc_id, pos, size, at, span, text in zip(*(b.column(k).to_pylist() for k in ("doc_id", "pos", "size", "at", "span", "words")), strict=True):
            words = text.split(" ")
            for side, first, count, place, length in halves(size, at, span):
                part = words[first : first + count + WINDOW - 1]
                key = stable_text_hash(" ".join([side, str(length), *part[place : place + length]]))
                row = (key, stable_text_hash(" ".join(part)), doc_id, pos + first, count, place, length, False, " ".join(part))
                for k, v in zip(SLICE, row, strict=True):
                    out[k].append(v)
        return batch_of(out, SLICE)

    return arrow_map(slices, fn, SLICE_SCHEMA)


def _searched(slices: DataFrame, shards: int) -> DataFrame:
    """(key, content, doc_id, start, end): for each content the windows that occur earlier in others of its group, and if there
    are more runs of it one row without an end, as all windows of these do."""
    types = {"key": pa.int64(), "content": pa.int64(), "doc_id": pa.int64(), "start": pa.int32(), "end": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, int, bool, list[str]]] = []
        shard = None

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            later = later_windows([h[-1] for h in held])
            rows = [(k, c, d, p + a, p + e) for (k, c, d, p, _, _), x in zip(held, later, strict=True) for a, e in intervals(x)]
            rows += [(k, c, d, p, None) for k, c, d, p, copied, _ in held if copied]
            held.clear()
            if rows:
                yield batch_of(dict(zip(types, zip(*rows, strict=True), strict=True)), types)

        for b in batches:
            for at, *row, text in zip(*(b.column(k).to_pylist() for k in ("shard", "key", "content", "doc_id", "pos", "copied", "words")), strict=True):
                if at != shard:
                    yield from flush()
                    shard = at
                held.append((*row, text.split(" ")))
        yield from flush()

    dealt = slices.select(F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"), "key", "content", "doc_id", "pos", "copied", "words")
    return dealt.repartition("shard").sortWithinPartitions("shard", "doc_id", "pos").mapInArrow(run, "key bigint, content bigint, doc_id bigint, start int, end int")


def repeated_intervals(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end): word intervals of ``docs`` (doc_id, text) that windows with an earlier occurrence cover."""
    length = F.col("size") + (WINDOW - 1)
    place = F.struct("doc_id", "pos", "size", "at")
    runs = text_runs(docs)
    recurring = saved(runs.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "grams")  # written, so that the join below may split a hot gram's rows
    members = saved(runs.join(recurring, "key"), "runs")
    contents = members.groupBy("key", "content").agg(F.min(place).alias("first"), (F.count("*") > 1).alias("copied"))
    slices = saved(_slices(docs, contents.select("key", "content", "first.*", "copied")), "slices")
    marks = []
    while True:
        groups = slices.groupBy("key").agg(F.sum(length).alias("words"), F.count("*").alias("n"))
        total = groups.agg(F.sum("words"), F.max(F.when(F.col("n") > 1, F.col("words")))).first()
        divide = (total[1] or 0) > SHARD_WORDS
        calm = slices
        if divide:
            large = saved(groups.where((F.col("words") > SHARD_WORDS) & (F.col("n") > 1)).select("key"), "large")
            calm, rest = slices.join(large, "key", "left_anti"), slices.join(large, "key")
        found = saved(_searched(calm, max(1, (total[0] or 0) // SHARD_WORDS)), "found")
        copied = found.where("end IS NULL").select("key", "content", F.col("doc_id").alias("first_id"), F.col("start").alias("first_pos"))
        if divide:
            copied = copied.unionByName(rest.where("copied").select("key", "content", F.col("doc_id").alias("first_id"), F.col("pos").alias("first_pos")))
        again = members.join(copied, ["key", "content"]).where("doc_id <> first_id OR pos <> first_pos")
        marks += [found.where("end IS NOT NULL").select("doc_id", "start", "end"), again.select("doc_id", F.col("pos").alias("start"), (F.col("pos") + length).alias("end"))]
        if not divide:
            return reduce(DataFrame.unionByName, marks)
        parts = saved(_divided(rest), "divided")
        shared = saved(parts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "divided-grams")
        members = saved(parts.join(shared, "key"), "divided-runs")
        contents = members.groupBy("key", "content").agg(F.min_by(F.struct("doc_id", "pos", "size", "at", "span", "words"), F.struct("doc_id", "pos")).alias("first"), (F.count("*") > 1).alias("copied"))
        slices = saved(contents.select("key", "content", "first.*", "copied").select(*SLICE), "slices")


def _covered(spans: list[dict], n: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    for s in spans:
        edge[s["start"]] += 1
        edge[s["end"]] -= 1
    return np.cumsum(edge[:-1]) > 0


def _words_digest(text: str | None) -> tuple[int, str]:
    words = (text or "").encode("utf-8", "surrogatepass").split()
    return len(words), hashlib.sha256(b" ".join(words)).hexdigest()


def _one_text_an_id(rows: DataFrame, base: DataFrame) -> DataFrame:
    """``rows`` without those that are not their id's document."""
    several = base.where("doc_id IS NOT NULL AND n_words > 0").groupBy("doc_id").agg(F.min("kept_sha256").alias("own"), F.max("kept_sha256").alias("last")).where("own <> last").select("doc_id", "own")
    several = saved(several, "several")
    if several.isEmpty():
        return rows
    types = {"doc_id": pa.int64(), "text": pa.string()}

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        own = [_words_digest(t)[1] == d for t, d in zip(b.column("text").to_pylist(), b.column("own").to_pylist(), strict=True)]
        return b.select(list(types)).filter(pa.array(own, pa.bool_()))

    chosen = arrow_map(rows.join(several, "doc_id").select("doc_id", "text", "own"), fn, "doc_id bigint, text string")
    return rows.join(several, "doc_id", "left_anti").unionByName(chosen)


def substring_report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 (of the kept words, joined by one space)."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    types = {"doc_id": pa.int64(), "n_words": pa.int64(), "kept_sha256": pa.string()}

    def whole(b: pa.RecordBatch) -> pa.RecordBatch:
        found = [_words_digest(t) for t in b.column("text").to_pylist()]
        return batch_of({"doc_id": b.column("doc_id"), "n_words": [n for n, _ in found], "kept_sha256": [d for _, d in found]}, types)

    base = saved(arrow_map(rows, whole, "doc_id bigint, n_words bigint, kept_sha256 string"), "base")
    known = _one_text_an_id(rows.where("doc_id IS NOT NULL AND text IS NOT NULL"), base)
    spans = repeated_intervals(known).groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    cut_types = {"doc_id": pa.int64(), "kept_sha256": pa.string(), "n_removed": pa.int64(), "cut_sha256": pa.string()}

    def cut(b: pa.RecordBatch) -> pa.RecordBatch:
        out: dict[str, list] = {k: [] for k in cut_types}
        for doc_id, text, spans in zip(*(b.column(k).to_pylist() for k in ("doc_id", "text", "spans")), strict=True):
            words = text.encode("utf-8", "surrogatepass").split()
            gone = _covered(spans, len(words))
            out["doc_id"].append(doc_id)
            out["kept_sha256"].append(_words_digest(text)[1])
            out["n_removed"].append(int(gone.sum()))
            out["cut_sha256"].append(hashlib.sha256(b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)).hexdigest())
        return batch_of(out, cut_types)

    touched = arrow_map(known.join(spans, "doc_id"), cut, "doc_id bigint, kept_sha256 string, n_removed bigint, cut_sha256 string")
    touched = touched.groupBy("doc_id", "kept_sha256").agg(F.max("n_removed").alias("n_removed"), F.min("cut_sha256").alias("cut_sha256"))  # equal rows
    out = base.join(touched, ["doc_id", "kept_sha256"], "left")
    return out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("cut_sha256", "kept_sha256").alias("kept_sha256"))
