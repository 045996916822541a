"""Toxicity from the nearest labelled examples, by exact TF-IDF cosine over a block-max inverted index.

Terms are all words of the labelled examples and the four- and five-letter beginnings of longer words, in lower case. A vector
holds (1 + ln tf) * idf * association for each term, at length one. The association is 1, and more for a term that toxic
examples have more often than others: 1 plus the z-score of the difference of the two shares, in which examples that are
copies of each other count as one. (With plain TF-IDF, the few words that matter drown in long texts; see the README.)

Postings lie in blocks of examples, with the largest weight of each term and of each term in each block. A query adds up its
common terms first (their postings are full rows, so a batch of queries is one matrix product), then the others from the
largest possible contribution down, unless the k-th best sum beats all that the rest could add. Block maxima of the rest then
leave few examples, whose cosines are computed in full, so the neighbours are exact; all that are as close as the k-th are
neighbours. Votes are weighted by closeness, and a monotone curve fitted on left-out examples (without their
copies) turns a vote into a probability. The neighbours are returned as evidence.

The index is fitted in one task on a sample of the labelled rows, never a held-out one: at most ``SAMPLE`` rows and
``SAMPLE_BYTES`` bytes of texts of at most ``LONGEST`` bytes. Scoring is one pass over all texts.

Defined cases: a text without any known term (null and empty ones too) has no neighbour and gets the rate of toxic examples
among those without neighbours; without labels all scores are 0; a document with several labels counts as toxic if any says
so, one with several texts has the smallest; repeated rows get equal scores, ids and order never change one; a very long text
is one vector like any other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import pickle
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from psephos.llm.common import batch_of, held_out_column, multipliers, place_of, small_batches, workspace
from psephos.llm.near_duplicates import shingles
from psephos.llm.quality_classifier import training_rows

WORD = re.compile(r"[^\W\d_]+")
#: Most labelled rows that the index is fitted on.
SAMPLE = 2_000
NEIGHBOURS = 15
BLOCK = 64
#: Letters of the beginnings that are terms.
HEADS = (4, 5)
#: Terms that a query begins with; the others follow if these don't settle it.
FIRST_TERMS = 24
#: A term that one example in so many has, or more, has its postings as a row with a place for each example.
COMMON = 16
#: Examples whose common parts are computed at once.
BATCH = 256
#: Words whose terms a process remembers.
REMEMBERED = 50_000
#: Cosines that differ by less are equal.
EQUAL = 1e-6


def term_counts(text: str | None) -> Counter[str]:
    """All words and beginnings of a text; beginnings are marked by a trailing star."""
    words = Counter(WORD.findall(text.lower())) if text else Counter()
    heads: Counter[str] = Counter()
    for w, n in words.items():
        for k in HEADS:
            if len(w) > k:
                heads[w[:k] + "*"] += n
    words.update(heads)
    return words


def copy_groups(texts: list[str | None]) -> np.ndarray:
    """A number for each text, the same for those that share one of four minima over shingle hashes with an earlier one."""
    seen: dict[int, int] = {}
    out = []
    for k, t in enumerate(texts):
        own = shingles(t)
        with np.errstate(over="ignore"):
            marks = [int((own * m).min()) ^ j for j, m in enumerate(multipliers(4) | np.uint64(1))] if len(own) else []
        group = next((seen[m] for m in marks if m in seen), k)
        for m in marks:
            seen.setdefault(m, group)
        out.append(group)
    return np.array(out, dtype=np.int64)


def gathered(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1, ... of runs of these sizes, one run after the other."""
    ends = np.cumsum(size)
    return np.repeat(begin - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)


class WordTerms(dict):
    """The known terms of words, of as many words as a process remembers."""

    def __init__(self, vocabulary: dict[str, int]) -> None:
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> list[int]:
        get, found = self.vocabulary.get, []
        if (t := get(word)) is not None:
            found.append(t)
        for k in HEADS:
            if len(word) > k and (t := get(word[:k] + "*")) is not None:
                found.append(t)
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = found
        return found

    def __reduce__(self) -> tuple:
        return WordTerms, (self.vocabulary,)


class Index:
    """Labelled (doc_id, label, text) examples, searchable."""

    def __init__(self, rows: list[tuple[int, int, str | None]]) -> None:
        groups = copy_groups([t for _, _, t in rows])
        _, back, sizes = np.unique(groups, return_inverse=True, return_counts=True)
        share = 1.0 / sizes[back]
        labels = np.array([y for _, y, _ in rows], dtype=np.int64)
        counted = [term_counts(t) for _, _, t in rows]
        self.vocabulary: dict[str, int] = {}
        number = self.vocabulary.setdefault
        terms = [np.array(sorted(number(w, len(self.vocabulary)) for w in c), dtype=np.int32) for c in counted]
        names = list(self.vocabulary)
        times = [np.array([c[names[t]] for t in ts.tolist()], dtype=np.float32) for c, ts in zip(counted, terms, strict=True)]
        del counted, names
        count = len(self.vocabulary)
        flat, of = np.concatenate([*terms, np.empty(0, np.int32)]), np.repeat(np.arange(len(rows)), [len(t) for t in terms])
        df = np.bincount(flat, minlength=count)
        self.weight = np.log((1 + len(rows)) / (1 + df)) * self._association(flat, share[of], labels[of], share, labels, count)
        bare = [y for _, y, t in zip(labels, labels, terms, strict=True) if not len(t)]
        self.none_rate = (sum(bare) + 0.01) / (len(bare) + 1)
        # examples with the same heaviest term lie together, which keeps the maxima of the other blocks low
        full = [k for k in range(len(rows)) if len(terms[k])]
        heaviest = {k: int(terms[k][np.argmax(self.weight[terms[k]])]) for k in full}
        full.sort(key=lambda k: (heaviest[k], terms[k].tobytes(), times[k].tobytes(), int(labels[k])))
        self.ids, self.labels, self.groups = np.array([rows[k][0] for k in full], dtype=np.int64), labels[full], groups[full]
        vectors = [self.vector(terms[k], times[k]) for k in full]
        self.first = np.concatenate([[0], np.cumsum([len(terms[k]) for k in full], dtype=np.int64)])
        self.terms = np.concatenate([*(terms[k] for k in full), np.empty(0, np.int32)])
        self.values = np.concatenate([*vectors, np.empty(0)]).astype(np.float32)
        self._invert(count)
        self.curve = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
        self.query = np.zeros(count)
        self.words = WordTerms(self.vocabulary)

    @staticmethod
    def _association(flat: np.ndarray, shares: np.ndarray, of: np.ndarray, share: np.ndarray, labels: np.ndarray, count: int) -> np.ndarray:
        """1 + z, at least 1: how much more often toxic examples have each term, copies counted as one."""
        toxic, clean = (np.bincount(flat, weights=shares * (of == y), minlength=count) for y in (1, 0))
        n1, n0 = float(share[labels == 1].sum()), float(share[labels == 0].sum())
        if not n1 or not n0:
            return np.ones(count)
        p = (toxic + clean) / (n1 + n0)
        z = (toxic / n1 - clean / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / n1 + 1 / n0))
        return 1 + np.maximum(z, 0)

    def _invert(self, count: int) -> None:
        """Postings and block maxima of each term."""
        place = np.repeat(np.arange(len(self.ids), dtype=np.int32), np.diff(self.first))
        order = np.argsort(self.terms, kind="stable")
        self.places, self.weights = place[order], self.values[order]
        sizes = np.bincount(self.terms, minlength=count)
        self.begin, self.size = np.cumsum(sizes) - sizes, sizes
        term = self.terms[order]
        block = self.places // BLOCK
        cut = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (block[1:] != block[:-1])])) if len(term) else np.empty(0, np.int64)
        self.blocks, self.block_max = block[cut].astype(np.int16 if len(self.ids) < BLOCK << 15 else np.int32), np.maximum.reduceat(self.weights, cut) if len(cut) else np.empty(0, np.float32)
        sizes = np.bincount(term[cut], minlength=count)
        self.block_begin, self.block_size = np.cumsum(sizes) - sizes, sizes
        self.most = np.zeros(count, np.float32)
        np.maximum.at(self.most, term[cut], self.block_max)
        n = len(self.ids)
        common = np.flatnonzero(self.size * COMMON > n)
        self.row = np.full(count, -1, np.int32)
        self.row[common] = np.arange(len(common))
        self.rows = np.zeros((len(common), n), np.float32)
        at = gathered(self.begin[common], self.size[common])
        self.rows[np.repeat(np.arange(len(common)), self.size[common]), self.places[at]] = self.weights[at]

    def vector(self, terms: np.ndarray, times: np.ndarray) -> np.ndarray:
        w = (1 + np.log(times)) * self.weight[terms]
        length = float(np.sqrt(w @ w))
        return w / length if length else w

    def common_parts(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """What the common terms add to the cosine of each vector with each example: one matrix product."""
        many = np.zeros((len(vectors), len(self.rows)), np.float32)
        for k, (terms, weights) in enumerate(vectors):
            row = self.row[terms]
            many[k, row[row >= 0]] = weights[row >= 0]
        return many @ self.rows

    def nearest(self, terms: np.ndarray, weights: np.ndarray, common: np.ndarray, k: int = NEIGHBOURS, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k nearest examples and of all that are as close as the k-th, of those with a positive cosine;
        ``common``: the common terms' part; ``without``: a group of copies that doesn't count."""
        n = len(self.ids)
        rare = self.row[terms] < 0
        left, rest_weights = terms[rare], weights[rare]
        bound = rest_weights * self.most[left]
        order = np.argsort(-bound, kind="stable")
        left, rest_weights, bound = left[order], rest_weights[order], bound[order]
        rest = np.append(np.cumsum(bound[::-1])[::-1], 0.0)  # the most that the terms from here on can add
        sums, done = common.astype(float), 0
        if without >= 0:
            sums[self.groups == without] = -np.inf
        while True:
            least = float(np.partition(sums, n - k)[n - k]) if n > k else 0.0
            if done == len(left) or rest[done] + EQUAL < least:
                break
            part = slice(done, done + FIRST_TERMS if not done else len(left))
            size = self.size[left[part]]
            at = gathered(self.begin[left[part]], size)
            sums += np.bincount(self.places[at], weights=self.weights[at] * np.repeat(rest_weights[part], size), minlength=n)
            done = min(part.stop, len(left))
        if done == len(left):  # the sums are whole cosines
            places = np.flatnonzero((sums > 0) & (sums >= least - EQUAL))
            return places, sums[places]
        t = left[done:]
        at = gathered(self.block_begin[t], self.block_size[t])
        more = np.bincount(self.blocks[at], weights=self.block_max[at] * np.repeat(rest_weights[done:], self.block_size[t]), minlength=n // BLOCK + 1)
        far = sums + more[np.arange(n) // BLOCK]
        places = np.flatnonzero((far > 0) & (far >= least - EQUAL))
        if not len(places):
            return places, np.empty(0)
        self.query[terms] = weights
        size = np.diff(self.first)[places]
        at = gathered(self.first[places], size)
        cosines = np.add.reduceat(self.values[at] * self.query[self.terms[at]], np.cumsum(size) - size)
        self.query[terms] = 0.0
        if len(places) > k:
            near = cosines >= np.partition(cosines, len(cosines) - k)[len(cosines) - k] - EQUAL
            places, cosines = places[near], cosines[near]
        near = cosines > 0
        return places[near], cosines[near]

    def vote(self, terms: np.ndarray, weights: np.ndarray, common: np.ndarray, without: int = -1) -> tuple[float, np.ndarray, np.ndarray]:
        """The weighted share of toxic neighbours (-1 without any), and the neighbours."""
        places, cosines = self.nearest(terms, weights, common, without=without) if len(terms) else (terms, weights)
        if not len(places):
            return -1.0, places, cosines
        weight = cosines / (1.05 - np.minimum(cosines, 1))
        return float(weight @ self.labels[places] / weight.sum()), places, cosines

    def calibrate(self) -> None:
        """Fit a rising step curve (pool adjacent violators) of the label on the vote of examples left out with their copies."""
        vectors = [(self.terms[a:b], self.values[a:b].astype(float)) for a, b in pairwise(self.first.tolist())]
        votes = np.concatenate([np.empty(0), *(
            [self.vote(t, w, c, g)[0] for (t, w), c, g in zip(part, self.common_parts(part), self.groups[k : k + BATCH].tolist(), strict=True)]
            for k in range(0, len(vectors), BATCH) for part in [vectors[k : k + BATCH]]
        )])
        votes = np.round(votes, 5)  # the same whatever the order of sums
        held = np.flatnonzero(votes >= 0)
        if not len(held):
            return
        values, back, sizes = np.unique(votes[held], return_inverse=True, return_counts=True)
        toxic = np.bincount(back, weights=self.labels[held])
        pools: list[list[float]] = []
        for pool in zip(values.tolist(), toxic.tolist(), sizes.tolist(), strict=True):
            pools.append([*pool])
            while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
                v, y, n = pools.pop()
                pools[-1] = [(pools[-1][0] * pools[-1][2] + v * n) / (pools[-1][2] + n), pools[-1][1] + y, pools[-1][2] + n]
        at = [0.0, *(p[0] for p in pools), 1.0]
        rate = [(p[1] + 0.5 * p[0]) / (p[2] + 0.5) for p in pools]
        self.curve = (np.array(at), np.array([rate[0], *rate, rate[-1]]))

    def known(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The known terms of a text, ascending, and how often each occurs."""
        counts = Counter(WORD.findall(text.lower()) if text else ())
        found = list(map(self.words.__getitem__, counts))
        sizes = list(map(len, found))
        terms = np.fromiter(chain.from_iterable(found), np.int64, sum(sizes))
        times = np.repeat(np.fromiter(counts.values(), float, len(counts)), sizes)
        if not len(terms):
            return terms, times
        order = np.argsort(terms)
        terms, times = terms[order], times[order]
        cut = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]]))
        return terms[cut], np.add.reduceat(times, cut)

    def weighted(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Terms and weights of the texts' vectors."""
        return [(t, self.vector(t, n)) for t, n in map(self.known, texts)]

    def scores(self, texts: list[str | None]) -> list[tuple[float, list[int]]]:
        """For each text the probability of toxicity and the ids of the nearest examples, nearest first."""
        vectors = self.weighted(texts)
        out = []
        for (terms, weights), common in zip(vectors, self.common_parts(vectors), strict=True):
            vote, places, cosines = self.vote(terms, weights, common)
            ids = self.ids[places]
            out.append((float(np.interp(vote, *self.curve)) if vote >= 0 else float(self.none_rate), ids[np.lexsort((ids, -cosines))].tolist()))
        return out


def fitted(rows: list[tuple[int, int, str | None]]) -> Index:
    """The index of labelled (doc_id, label, text) rows."""
    index = Index(rows)
    index.calibrate()
    return index


def toxicity_index(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> str | None:
    """The index of a bounded sample of labelled rows, made in one task and kept in the shared folder; returns its file. It never
    passes through the driver."""
    small_batches(docs.sparkSession)
    folder = workspace(docs.sparkSession, "toxicity")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(b.column(k).to_pylist() for k in ("doc_id", "label", "text")), strict=True)]
        if rows:
            fs, base = pafs.FileSystem.from_uri(folder)
            fs.create_dir(base, recursive=True)
            name = f"{uuid.uuid4().hex}.index"  # a task that is run again writes another file
            with fs.open_output_stream(f"{base}/{name}") as out:
                out.write(pickle.dumps(fitted(rows)))
            yield pa.RecordBatch.from_arrays([pa.array([name])], names=["name"])

    row = training_rows(docs, labels, "toxic", sample).mapInArrow(fit, "name string").first()
    return f"{folder}/{row.name}" if row else None


def load(file: str | None) -> Index | None:
    """The index of a file; a task holds it no longer than it runs."""
    if not file:
        return None
    fs, path = pafs.FileSystem.from_uri(file)
    with fs.open_input_file(path) as f:
        return pickle.load(f)


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted, and the nearest examples' ids as ``evidence``."""
    file = toxicity_index(docs, labels, sample)
    types = {"doc_id": pa.int64(), "score": pa.float64(), "evidence": pa.list_(pa.int64())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = load(file)
        for b in batches:
            texts = b.column("text").to_pylist()
            got = index.scores(texts) if index else [(0.0, [])] * len(texts)
            if got:
                yield batch_of({"doc_id": b.column("doc_id"), "score": [s for s, _ in got], "evidence": [e for _, e in got]}, types)

    out = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, score double, evidence array<bigint>")
    held = F.coalesce(held_out_column(), F.lit(False)).alias("held_out")
    return out.select("doc_id", held, "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")


def keep_clean(docs: DataFrame, training: DataFrame, labels: DataFrame, threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` whose text scores below the threshold, with their own columns; ``training`` has the labelled texts."""
    file = toxicity_index(training, labels, sample)
    at = place_of(docs, "text")
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = load(file)
        for b in batches:
            if index:
                b = b.filter(pa.array([s < threshold for s, _ in index.scores(b.column(at).to_pylist())], pa.bool_()))
            if b.num_rows:
                yield b

    return docs.mapInArrow(run, docs.schema)
