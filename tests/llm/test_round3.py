"""Vector near-duplicates, source divergence and the Merkle manifest against brute force; odd rows; words that once hashed alike."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import groupby

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

from psephos.llm import contamination, embedding_duplicates, merkle_manifest, near_duplicates, pii, source_divergence, substrings, toxicity
from psephos.llm.common import hashed_words

VECTORS = "vec_id bigint, embedding array<float>, label int"


def near(made: list[tuple], cosine: float = 0.98) -> dict:
    """(n_links, component) of each row, by all pairs; rows of one id and vector are one."""
    ok = {}
    for i, v, label in made:
        if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            ok[i, tuple(np.asarray(v, np.float32).tolist()), label] = np.asarray(v, np.float32).astype(float)
    keys = list(ok)
    links, root = Counter(), {i: i for i, *_ in keys}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(keys)):
        for b in range(a):
            x, y = ok[keys[a]], ok[keys[b]]
            if keys[a][2] == keys[b][2] and len(x) == len(y) and x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= cosine:
                links[keys[a]] += 1
                links[keys[b]] += 1
                p, q = sorted((find(keys[a][0]), find(keys[b][0])))
                root[q] = p
    return {k: (links[k], find(k[0])) for k in keys}


def groups(rng, sizes, dim, spread):
    """Vectors around centres, ``spread`` apart from them."""
    out = []
    for n in sizes:
        centre = rng.standard_normal(dim)
        centre /= np.linalg.norm(centre)
        out += [(centre + spread * rng.standard_normal(dim) / math.sqrt(dim)).tolist() for _ in range(n)]
    return out


def check_vectors(spark, made, **more):
    got = embedding_duplicates.near_duplicates(spark.createDataFrame(made, VECTORS), **more).collect()
    want = near(made)
    by_id = defaultdict(set)
    for (i, _, _), v in want.items():
        by_id[i].add(v)
    assert len(got) == len(made)
    for r in got:
        if r.vec_id in by_id:
            assert (r.n_links, r.component_id) in by_id[r.vec_id] and r.kept == (r.vec_id == r.component_id)
    return got, want


def test_vectors_as_all_pairs(spark):
    rng = np.random.default_rng(5)
    vectors = groups(rng, [1] * 60 + [2] * 10 + [5] * 5 + [40, 90], 32, 0.11)
    order = rng.permutation(len(vectors))
    made = [(int(k), vectors[k], int(rng.integers(3)) if k < 60 else 1) for k in order]
    made += [(1000 + k, vectors[-1], 1) for k in range(20)]  # exact copies
    got, want = check_vectors(spark, made)
    links = {r.vec_id: r.n_links for r in got}
    assert max(links.values()) > 60 and links == {i: n for (i, *_), (n, _) in want.items()}


def test_vectors_in_many_blocks(spark, monkeypatch):
    """Buckets larger than a chunk, batches of few rows."""
    monkeypatch.setattr(embedding_duplicates, "CHUNK", 8)
    monkeypatch.setattr(embedding_duplicates, "GATHERED", 16)
    rng = np.random.default_rng(6)
    vectors = groups(rng, [120, 30, 3], 16, 0.1)
    check_vectors(spark, [(k, v, 0) for k, v in enumerate(vectors)])


def test_vectors_odd(spark):
    nan, inf = float("nan"), float("inf")
    base = [1.0, 2.0, 3.0]
    made = [
        (1, base, 1), (1, base, 1), (2, [2.0, 4.0, 6.0], 1), (3, base, 2), (4, base, None), (None, base, 1), (5, None, 1), (6, [], 1), (7, [0.0, 0.0, 0.0], 1), (8, [1.0, nan, 3.0], 1),
        (9, [1.0, inf, 3.0], 1), (10, [1.0, None, 3.0], 1), (11, [1.0, 2.0, 3.0, 0.0], 1), (12, [-0.0, 0.0, 1.0], 1), (13, [0.0, -0.0, 1.0], 1), (14, [1e-30, 2e-30, 3e-30], 1), (15, [1e30, 2e30, 3e30], 1),
        (16, base, 1), (16, [3.0, -2.0, 1.0], 1), (17, [3.0, -2.0, 1.001], 1),
    ]
    df = spark.createDataFrame(made, VECTORS).withColumns({"digest": F.lit(1), "x": F.lit("a"), "id": F.lit(2), "n": F.lit(3), "grp": F.lit("g")})
    got = defaultdict(list)
    for r in embedding_duplicates.near_duplicates(df).collect():
        got[r.vec_id].append((r.n_links, r.component_id, r.kept))
    assert got[1] == [(4, 1, True)] * 2 and got[2] == [(4, 1, False)] and got[14] == got[15] == [(4, 1, False)]
    assert sorted(got[16]) == [(1, 1, False), (4, 1, False)] and got[17] == [(1, 1, False)]
    assert got[12] == [(1, 12, True)] and got[13] == [(1, 12, False)] and got[None] == [(0, None, True)]
    assert all(got[k] == [(0, k, True)] for k in (3, 4, 5, 6, 7, 8, 9, 10, 11))
    assert embedding_duplicates.near_duplicates(df.limit(0)).count() == 0
    doubles = df.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("LABEL"))
    assert {r.vec_id for r in embedding_duplicates.near_duplicates(doubles).where("n_links = 4").collect()} == {1, 2, 14, 15, 16}


def test_tables_miss_less_than_one_in_a_million():
    """By simulation: how often two unit vectors at the threshold share a cell of one table."""
    rng = np.random.default_rng(1)
    x = embedding_duplicates.units(rng.standard_normal((2000, 24)))
    side = embedding_duplicates.units(np.cross(x[:, :3], rng.standard_normal((2000, 3))).repeat(8, axis=1) * np.array([1.0, *[0.0] * 7] * 3))
    y = embedding_duplicates.units(x + 0.2 * side)
    n = embedding_duplicates.tables()
    same = (embedding_duplicates.bucket_keys(x, n) == embedding_duplicates.bucket_keys(y, n)).mean()
    assert (1 - same) ** n < 1e-5 and n < 40


def divergences(docs, min_docs, top):
    """The contract word by word, in whole numbers."""
    fold = {c: c + 32 for c in range(65, 91)}
    texts = [((t or "").translate(fold), lang or "", source or "") for t, lang, source in docs]
    words = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t), lang, source) for t, lang, source in texts]
    out = []
    for lang in {x[1] for x in words}:
        own = [(w, s) for w, x, s in words if x == lang]
        within = Counter(t for w, _ in own for t in set(w))
        kept = [t for t, n in within.items() if n >= min_docs]
        count = {s: Counter(t for w, x in own if x == s for t in w) for _, s in own}
        scaled = lambda c: {t: 1 + 1_000_000_000 * (c[t] + 5) // (sum(c[k] for k in kept) + 5 * len(kept)) for t in kept}
        p, q = {s: scaled(c) for s, c in count.items()}, scaled(sum(count.values(), Counter()))
        for s in count:
            pairs = [(x, sum(abs(p[s][t] - p[x][t]) for t in kept)) for x in count if x != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if count[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                ranked = sorted(found, key=lambda r: (-r[1], r[0].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(ranked[: top if part == "term" else None])]
    return sorted(out)


def test_divergence_as_defined(spark):
    rng = np.random.default_rng(9)
    vocabulary = [f"Wort{'abcdefghij'[k % 10]}{'xyz'[k % 3]}" for k in range(40)] + ["É", "été", "日本", "a\x85b", " ", "Zoë"]
    made = [(" ".join(rng.choice(vocabulary, rng.integers(0, 60))), ["en", "de", None][int(rng.integers(3))], ["s1", "s2", "é", None, "S"][int(rng.integers(5))]) for _ in range(150)]
    made += [(None, "en", "empty"), ("", "xx", "a"), ("123 _", "xx", "b"), ("lonely", "yy", "c"), ("x" * 100_000 + " Worta " * 1000, "en", "s1")]
    df = spark.createDataFrame(made, "text string, lang string, source string").withColumns({"term": F.lit(1), "n": F.lit(2), "p": F.lit(3), "sources": F.lit(4)}).repartition(5)
    for min_docs, top in ((10, 3), (1, 50), (1000, 50)):
        got = sorted(tuple(r) for r in source_divergence.divergence(df, min_docs, top).collect())
        assert got == divergences(made, min_docs, top)
    assert source_divergence.divergence(df.limit(0)).count() == 0


def manifest(docs):
    """The contract, node by node."""
    h = lambda *x: hashlib.sha256("".join(x).encode("utf-8", "surrogatepass")).hexdigest()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda d, text: h(*map(field, (d[0], d[3], d[2], d[4], text)))

    def tree(leaves):
        """Levels, and for each leaf the (before, after) siblings up to the last node."""
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append([h(*levels[-1][k : k + 3]) for k in range(0, len(levels[-1]), 3)])
        paths = []
        for i in range(len(leaves)):
            path = []
            for level in levels[:-1]:
                first = i - i % 3
                path.append(("".join(level[first:i]), "".join(level[i + 1 : first + 3])))
                i //= 3
            paths.append(path)
        return levels[-1][0], paths

    by_source = defaultdict(list)
    for d in docs:
        by_source[d[3]].append(d)
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    rows, subs = [], []
    for s in sources:
        own = sorted(((d[0] is not None, d[0] or 0, leaf(d, d[1]), d) for d in by_source[s]), key=lambda r: r[:3])
        sub, paths = tree([r[2] for r in own])
        subs.append(sub)
        rows.append([(r[3], r[2], p) for r, p in zip(own, paths, strict=True)])
    root, tops = tree(subs)
    out = []
    for sub, top, own in zip(subs, tops, rows, strict=True):
        for d, x, path in own:
            even = d[0] is not None and zlib.crc32(str(d[0]).encode()) % 2 == 0
            now = leaf(d, d[1].replace("\n", "")) if even and d[1] is not None else x
            for before, after in path + top:
                now = h(before, now, after)
            out.append((d[0], x, sub, root, h(*(y for pair in path + top for y in pair)), now, now == root))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[4]))


FIELDS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def check_manifest(df, made):
    got = sorted((tuple(r) for r in merkle_manifest.manifest(df).collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[4]))
    assert got == manifest(made)
    return got


def test_manifest_as_defined(spark):
    made = [(k, f"text {k}\nline é" if k % 3 else f"no line {k}", "en", ["a", "b", "É", None, ""][k % 5 if k % 7 else 0], k) for k in range(200)]
    made += [(None, "a\nb", "en", "a", 3), (None, "a\nb", "en", "a", 3), (5, None, None, None, None), (5, "", None, None, None), (7, "again\n", "x", "a", 1), (7, "again\n", "x", "a", 1), (300, "alone\n", None, "one", 1), (301, "\n" * 100_000, None, "two", 1), (302, "\n", "", "two", 0)]
    df = spark.createDataFrame(made, FIELDS).withColumns({"leaf": F.lit(1), "tree": F.lit(2), "pid": F.lit(3), "index": F.lit(4), "other": F.lit(5)})
    got = check_manifest(df.repartition(7), made)
    assert {r[6] for r in got} == {True, False}
    for n in (1, 2, 3, 4, 10):
        check_manifest(df.limit(n), [tuple(r)[:5] for r in df.limit(n).collect()])
    assert merkle_manifest.manifest(df.limit(0)).count() == 0


def test_manifest_across_blocks_and_partitions(spark):
    made = [(k, f"t{k}\n", "en", "hot" if k % 12 else f"s{k % 144:03}", 1) for k in range(45_000)]
    assert sum(d[3] == "hot" for d in made) > 2 * merkle_manifest.BLOCK
    check_manifest(spark.createDataFrame(made, FIELDS), made)


def test_forests_unite_in_any_order():
    """The monoid gives one root however nodes are dealt out and united."""
    rng = np.random.default_rng(2)
    sizes = {merkle_manifest.TOP: 3, 0: 25, 1: 1, 2: 9}
    leaves = {(t, 0, k): merkle_manifest.digest(f"{t}/{k}".encode()) for t in range(3) for k in range(sizes[t])}
    roots = set()
    for _ in range(20):
        part = rng.integers(0, 5, len(leaves))
        held = []
        for p in rng.permutation(5):
            f = merkle_manifest.Forest(dict(sizes))
            f.put({k: v for (k, v), q in zip(leaves.items(), part, strict=True) if q == p})
            held.append(f)
        while len(held) > 1:
            k = int(rng.integers(len(held) - 1))
            held[k : k + 2] = [held[k].united(held[k + 1])]
        assert len(held[0].nodes) == 1
        roots |= set(held[0].nodes.items())
    assert len(roots) == 1


def thue_morse(n: int) -> tuple[str, str]:
    bits = [bin(k).count("1") & 1 for k in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_long_words_differ(spark):
    """Words of which any polynomial modulo a power of two gives the same hash: nothing is linked or removed for them."""
    for n in (1024, 4096):
        one, two = thue_morse(n)
        assert hashed_words(one.encode())[0] != hashed_words(two.encode())[0]
        shared = [f"w{k}" for k in range(19)]
        texts = [(1, " ".join([*shared[:10], one, *shared[10:]])), (2, " ".join([*shared[:10], two, *shared[10:]]))]
        df = spark.createDataFrame(texts, "doc_id bigint, text string")
        assert [r.n_removed for r in substrings.substring_report(df).collect()] == [0, 0]
        assert all(r.kept for r in near_duplicates.near_duplicates(spark.createDataFrame([(1, one), (2, two)], "doc_id bigint, text string")).collect())


def test_substrings_of_an_id_with_several_texts(spark):
    """Of an id's rows with different words the least digest's are the document, and the others are left as they are."""
    words = " ".join(f"w{k}" for k in range(25))
    made = [(1, words), (2, "x " + words), (2, "short text"), (2, None), (3, words), (3, words), (4, "y " + words + " z"), (4, "q " + words)]
    got = defaultdict(list)
    for r in substrings.substring_report(spark.createDataFrame(made, "doc_id bigint, text string")).collect():
        got[r.doc_id].append((r.n_words, r.n_removed))
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    own = {2: min(("x " + words, "short text"), key=digest), 4: min(("y " + words + " z", "q " + words), key=digest)}
    want = defaultdict(list)
    for i, t in made:
        n = len((t or "").split())
        want[i].append((n, 25 if (i == 3 or own.get(i) == t) and n >= 20 else 0))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_a_column_that_is_spelt_otherwise(spark):
    docs = spark.createDataFrame([(1, "write to a.b@c.org now please"), (2, None)], "doc_id bigint, TEXT string")
    bench = spark.createDataFrame([("i", "write to a b c org now please")], "item_id string, text string")
    labels = spark.createDataFrame([(1, 0)], "doc_id bigint, toxic int")
    assert pii.redact(docs).columns == docs.columns and "a.b@c.org" not in pii.redact(docs).first().TEXT
    assert [r.doc_id for r in contamination.clean(docs, bench).collect()] == [2]
    assert toxicity.keep_clean(docs, docs, labels).columns == docs.columns
