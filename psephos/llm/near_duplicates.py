"""Near-duplicate groups by MinHash with sequential Bayesian verification.

Documents are sets of distinct five-word shingles; two are linked if 100 * |both| >= percent * |either|, where
``percent`` is 85 unless given. The steps:

1. One pass over the texts leaves a sketch of each document: size and digest of its set and a MinHash signature. Documents
   with one and the same set form a class, and only its smallest id goes on (exact copies never become pairs).
2. Signatures are cut into bands; classes that share a band are candidates. In each band bucket every class is paired with one
   hub alone (first the smallest id, in later rounds one drawn by hash), so a bucket of any size gives as many pairs as it has
   members; what is connected already is left out of later rounds.
3. Candidates are compared batch by batch of signature positions. After each batch the posterior of the similarity (uniform
   prior) tells the probability that the pair still reaches the threshold; below ``MISS`` it is dropped. Survivors are
   verified exactly on the full sets.
4. Buckets that still hold different components after that are searched on: every member outside the component of the
   bucket's smallest id is compared, chunk by chunk, with the members of other components whose sets are of a size that allows
   a link, until it is linked to them or all have been tried, so that no link between different components is left out.
   Chunks are bounded in members and bytes.
5. Components come from alternating large-star and small-star steps on tables in the shared folder.

A pair at the threshold shares no band with probability below 1e-6: 24 bands of 5 positions at 85 per cent, 27 of 4 at 80.

Defined cases: null or blank texts have an empty set and are linked with nothing; a text of fewer than five words has its whole
sequence as its one shingle; rows of one id are one document, linked if any of its texts is; a null id is never linked, has a
null component and stays; a very long text is one set like any other, and a chunk of its own in step 4 (it must fit a row of
2 GB); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from psephos.llm.common import arrow_map, batch_of, gram_hashes, hashed_words, mix, saved, small_batches

SHINGLE = 5
#: Links need 100 * intersection >= PERCENT * union, unless another threshold is given.
PERCENT = 85
POSITIONS = 120
#: Probability below which a pair at the threshold may share no band.
UNSEEN = 1e-6
#: Signature positions compared at once.
BATCH = 24
#: Posterior probability of reaching the threshold below which a pair is dropped.
MISS = 1e-7
#: Members of a hub that are verified by one group of rows.
GROUP = 64
#: Rounds of star pairs before the rest of each bucket is compared in full.
TURNS = 3
#: Members of a bucket that are compared at once with four times as many others, and most bytes of their texts.
CHUNK = 64
CHUNK_BYTES = 8 << 20

_SEED = np.random.default_rng(977).integers(0, 1 << 63, (2, POSITIONS), dtype=np.uint64)
_A, _B = _SEED[0] * np.uint64(2) + np.uint64(1), _SEED[1]


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    h = hashed_words(text.encode("utf-8", "surrogatepass").lower()) if text else np.empty(0, np.uint64)
    if not len(h):
        return h
    return np.unique(gram_hashes(h, min(SHINGLE, len(h))))


def signature(items: np.ndarray) -> np.ndarray:
    """The least of each of POSITIONS hash functions over the set, as 32 bits."""
    least = np.full(POSITIONS, np.iinfo(np.uint64).max, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(0, len(items), 1024):
            np.minimum(least, (_A[:, None] * items[None, k : k + 1024] + _B[:, None]).min(axis=1), out=least)
    return (least >> np.uint64(32)).astype("<u4")


def banding(percent: int = PERCENT) -> tuple[int, int]:
    """(bands, rows): the longest bands, and no more of them than it takes to miss a pair at the threshold less often than UNSEEN."""
    for rows in range(POSITIONS, 0, -1):
        seen = (percent / 100) ** rows
        bands = math.ceil(math.log(UNSEEN) / math.log1p(-seen)) if seen < 1 else 1
        if bands * rows <= POSITIONS:
            return bands, rows
    raise ValueError(f"{POSITIONS} positions are too few for {percent} per cent")


@lru_cache(maxsize=8)
def least_matches(percent: int = PERCENT) -> list[int]:
    """For each batch end n the fewest of n matching positions with which a pair may go on: the least m for which the posterior
    Beta(m + 1, n - m + 1) puts at least MISS on similarities of the threshold and above."""
    grid = (np.arange(200_000) + 0.5) / 200_000
    out = []
    for n in range(BATCH, POSITIONS + 1, BATCH):
        for m in range(n + 1):
            log = m * np.log(grid) + (n - m) * np.log1p(-grid)
            weight = np.exp(log - log.max())
            if weight[grid >= percent / 100].sum() >= MISS * weight.sum():
                break
        out.append(m)
    return out


def survivors(left: np.ndarray, right: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Which pairs of signature rows the posterior bounds let through, batch by batch."""
    alive = np.arange(len(left))
    matches = np.zeros(len(left), np.int64)
    for k, least in enumerate(least_matches(percent)):
        cut = slice(k * BATCH, (k + 1) * BATCH)
        matches[alive] += (left[alive, cut] == right[alive, cut]).sum(axis=1)
        alive = alive[matches[alive] >= least]
    return alive


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """The exact test on two sorted distinct sets."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def sketches(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_shingles, length of the text, and for sets that are not empty digest and signature."""
    types = {"doc_id": pa.int64(), "n_shingles": pa.int64(), "bytes": pa.int64(), "digest": pa.binary(), "sig": pa.binary()}

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = b.column("text").to_pylist()
        sets = [shingles(t) for t in texts]
        return batch_of(
            {
                "doc_id": b.column("doc_id"), "n_shingles": [len(s) for s in sets], "bytes": [len(t or "") for t in texts],
                "digest": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
                "sig": [signature(s).tobytes() if len(s) else None for s in sets],
            }, types,
        )

    return arrow_map(docs, fn, "doc_id bigint, n_shingles bigint, bytes bigint, digest binary, sig binary")


def band_keys(classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(key, id) of each band of each class."""
    types = {"key": pa.int64(), "id": pa.int64()}
    bands, rows = banding(percent)
    salt = mix(np.arange(1, bands + 1, dtype=np.uint64))

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), dtype="<u4").reshape(-1, POSITIONS)[:, : bands * rows].reshape(-1, bands, rows).astype(np.uint64)
        key = np.broadcast_to(salt, sig.shape[:2]).copy()
        with np.errstate(over="ignore"):
            for k in range(rows):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, k])
        return batch_of({"key": key.ravel().view(np.int64), "id": np.repeat(b.column("id").to_numpy(), bands)}, types)

    return arrow_map(classes.select("id", "sig"), fn, "key bigint, id bigint")


def plausible(pairs: DataFrame, sigs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) that the sequential comparison of their signatures lets through."""
    rows = pairs.join(sigs.select(F.col("id").alias("a"), F.col("sig").alias("sa")).hint("merge"), "a").join(sigs.select(F.col("id").alias("b"), F.col("sig").alias("sb")).hint("merge"), "b").select("a", "b", "sa", "sb")

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        left, right = (np.frombuffer(b"".join(b.column(k).to_pylist()), dtype="<u4").reshape(-1, POSITIONS) for k in ("sa", "sb"))
        return b.select(["a", "b"]).take(pa.array(survivors(left, right, percent)))

    return arrow_map(rows, fn, "a bigint, b bigint")


def linked_across(placed: DataFrame, outside: DataFrame, sigs: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) between members ``outside`` (key, id, comp) and the other components among the members ``placed`` of the
    same bucket: at least one for each such member and component that have any.

    Both sides are packed into chunks of a bounded number of members, and chunks meet: in a chunk pair, signatures are compared
    sequentially, and what they let through is verified on the full sets, likeliest first, until a component is reached. What
    is shuffled and emitted is chunks and links, never pairs.
    """
    own = texts.select(F.col("doc_id").alias("id"), "text")
    step = -math.log(percent / 100)  # sets that are linked are of the same size class or of neighbouring ones
    sized = sigs.select("id", F.floor(F.log("n") / step).cast("int").alias("level"), "bytes")

    def packed(rows: DataFrame, size: int, name: str) -> DataFrame:
        full = F.greatest(F.count("*") / size, F.sum("bytes") / (size // CHUNK * CHUNK_BYTES))
        levels = rows.join(sized.hint("merge"), "id")
        parts = levels.groupBy("key", "level").agg(F.ceil(full).cast("int").alias("parts"))
        dealt = levels.join(parts, ["key", "level"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
        whole = dealt.join(sigs.select("id", "n", "sig").hint("merge"), "id").join(own.hint("merge"), "id")
        return whole.groupBy("key", "level", "part").agg(F.collect_list(F.struct("id", "comp", "n", "sig", "text")).alias(name)).drop("part")

    touched = placed.join(outside.select("key").distinct(), "key", "left_semi")
    near = packed(outside, CHUNK, "own").withColumnRenamed("level", "own_level")
    rows = near.join(packed(touched, 4 * CHUNK, "other"), "key").where(F.abs(F.col("level") - F.col("own_level")) <= 1).select("own", "other")
    types = {"a": pa.int64(), "b": pa.int64()}

    def unpacked(c: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        v = c.values
        return v.field("id").to_numpy(), v.field("comp").to_numpy(), v.field("n").to_numpy(), np.frombuffer(b"".join(v.field("sig").to_pylist()), dtype="<u4").reshape(-1, POSITIONS), v.field("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: set[tuple[int, int]] = set()
            for k in range(b.num_rows):
                (xi, xc, xn, xs, xt), (yi, yc, yn, ys, yt) = unpacked(b.column("own")[k]), unpacked(b.column("other")[k])
                sets: dict[int, np.ndarray] = {}
                for i in range(len(xi)):
                    at = np.flatnonzero((yc != xc[i]) & (100 * np.minimum(yn, xn[i]) >= percent * np.maximum(yn, xn[i])))
                    at = at[survivors(np.broadcast_to(xs[i], (len(at), POSITIONS)), ys[at], percent)]
                    if not len(at):
                        continue
                    at = at[np.argsort(-(ys[at] == xs[i]).sum(axis=1), kind="stable")]
                    mine, reached = shingles(xt[i].as_py()), set()
                    for j in at.tolist():
                        if yc[j] in reached:
                            continue
                        if j not in sets:
                            sets[j] = shingles(yt[j].as_py())
                        if linked(mine, sets[j], percent):
                            reached.add(yc[j])
                            found.add((min(int(xi[i]), int(yi[j])), max(int(xi[i]), int(yi[j]))))
            if found:
                yield batch_of({"a": [x for x, _ in found], "b": [y for _, y in found]}, types)

    return rows.mapInArrow(run, "a bigint, b bigint").distinct()


def verified(pairs: DataFrame, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) that are linked on their full sets.

    Rows of a hub ``a`` are dealt out in groups of about GROUP members, each with a copy of the hub's text, so that a hub of
    any size is spread over many tasks; a group is streamed, and holds only the hub's set.
    """
    hubs = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("parts"))
    members = pairs.join(hubs, "a").select(F.col("a").alias("hub"), F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.col("b").alias("doc_id"))
    heads = hubs.select(F.col("a").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("a").alias("doc_id"))
    wanted = members.withColumn("member", F.lit(1)).unionByName(heads.withColumn("member", F.lit(0)))
    rows = wanted.join(docs.hint("merge"), "doc_id").select("hub", "part", "member", "doc_id", "text")
    types = {"a": pa.int64(), "b": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: tuple[int, int] | None = None
        heads: list[np.ndarray] = []
        for b in batches:
            out: list[tuple[int, int]] = []
            for hub, part, member, doc_id, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (hub, part) != group:
                    group, heads = (hub, part), []
                own = shingles(text)
                if not member:
                    heads.append(own)
                elif any(linked(h, own, percent) for h in heads):
                    out.append((hub, doc_id))
            if out:
                yield batch_of({"a": [x for x, _ in out], "b": [y for _, y in out]}, types)

    spread = rows.repartition("hub", "part").sortWithinPartitions("hub", "part", "member")
    return spread.mapInArrow(run, "a bigint, b bigint").distinct()


def components(edges: DataFrame, rows: int) -> DataFrame:
    """(id, component) of all ids in ``edges`` (a, b) other than the components' smallest, by large-star and small-star steps.

    ``rows`` is about the number of edges; the steps never have more than these and the nodes together.
    """
    now = saved(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges", rows)
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == before:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
        before = state
        # large star: neighbours above a node go to the smallest of the node and its neighbours
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its neighbours below go to the smallest of these
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        now = saved(small.where("u <> v").distinct(), "edges", state[0])


def links(docs: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(id, component) of the linked classes.

    Aggregates over buckets are written before they are joined back, so that the joins may split a large bucket's rows.
    """
    keys = saved(band_keys(classes, percent), "bands")
    full = saved(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "full")
    buckets = saved(keys.join(full, "key"), "buckets")
    rows = buckets.count()  # what follows has no more rows than this
    members = buckets.select("id").distinct()
    sigs = saved(classes.select("id", "n", "bytes", "sig").join(members.hint("merge"), "id", "left_semi"), "signatures")
    texts = saved(docs.join(members.select(F.col("id").alias("doc_id")).hint("merge"), "doc_id", "left_semi"), "texts")

    found = None  # (id, component) so far
    for turn in range(TURNS):
        # star pairs with one hub a bucket: first its smallest id, then by chance, leaving out what is connected already
        placed = _placed(buckets, found)
        order = F.col("id") if turn == 0 else F.xxhash64("id", "key", F.lit(turn))
        hubs = placed.groupBy("key").agg(F.min_by(F.struct("id", "comp"), order).alias("hub"), F.min("comp").alias("c0"), F.max("comp").alias("c1"))
        hubs = saved(hubs.where("c0 <> c1").select("key", F.col("hub.id").alias("h"), F.col("hub.comp").alias("hc")), "hubs", rows)
        stars = placed.join(hubs, "key").where("comp <> hc").select(F.least("id", "h").alias("a"), F.greatest("id", "h").alias("b")).distinct()
        found = _joined(found, verified(saved(plausible(stars, sigs, percent), "plausible", rows), texts, percent), rows)

    placed = _placed(buckets, found)
    hubs = placed.groupBy("key").agg(F.min_by("comp", "id").alias("hc"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1")
    outside = saved(placed.join(hubs.select("key", "hc"), "key").where("comp <> hc").drop("hc"), "outside", rows)
    if outside.isEmpty():
        return found
    rest = saved(linked_across(placed, outside, sigs, texts, percent), "links", rows)
    return found if rest.isEmpty() else _joined(found, rest, rows)


def _placed(buckets: DataFrame, found: DataFrame | None) -> DataFrame:
    """(key, id, comp): the members of the buckets with their components so far."""
    if found is None:
        return buckets.select("key", "id", F.col("id").alias("comp"))
    return buckets.join(found, "id", "left").select("key", "id", F.coalesce("component", "id").alias("comp"))


def _joined(found: DataFrame | None, pairs: DataFrame, rows: int) -> DataFrame:
    """The components when ``pairs`` (a, b) are linked too."""
    if found is None:
        return components(pairs, rows)
    return components(found.select(F.col("component").alias("a"), F.col("id").alias("b")).unionByName(pairs), rows)


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest doc_id reachable), kept (doc_id = component_id)."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    sketched = saved(sketches(rows), "sketches")
    full = sketched.where("doc_id IS NOT NULL AND digest IS NOT NULL")
    classes = saved(full.groupBy("digest").agg(F.min("doc_id").alias("id"), F.min("n_shingles").alias("n"), F.max("bytes").alias("bytes"), F.min_by("sig", "doc_id").alias("sig")), "classes")
    found = links(rows.where("doc_id IS NOT NULL"), classes, percent)
    label = classes.select("digest", "id").join(found, "id", "left").select("digest", F.coalesce("component", "id").alias("component"))
    out = sketched.select("doc_id", "n_shingles", "digest").join(label, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def one_of_each_group(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, with their own columns, but those of documents that are not the smallest of their component."""
    gone = near_duplicates(docs, percent).where(~F.col("kept")).select("doc_id").distinct()
    name = next(n for n in (f"gone_{k}" for k in range(len(docs.columns) + 1)) if n not in map(str.lower, docs.columns))
    gone = gone.withColumnRenamed("doc_id", name)
    return docs.join(gone, docs["doc_id"].cast("bigint") == gone[name], "left_anti")
