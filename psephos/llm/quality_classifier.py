"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

The n-grams are taken of two readings of a text's words: the words themselves in lower case, and their shapes (upper case,
lower case, digits and each mark, runs as one). Each n-gram hashes to one of ``DIMENSIONS`` weights; an n-gram's value is its
share of the n-grams of its kind, and a score is the sigmoid of a sparse dot product.

Training sees at most ``SAMPLE`` labelled rows (those with the smallest hashes of their ids, never a held-out one) and
``SAMPLE_BYTES`` bytes of texts of at most ``LONGEST`` bytes, in one task; the weights, of fixed size, are broadcast. Scoring is one pass over all texts.

Defined cases: a null or blank text has the bias alone as its score; rows without a label are not trained on; without any
usable label all scores are 0.5; a document with several labels has the largest, one with several texts is learnt by the
smallest; repeated rows get equal scores; a very long text is scored whole; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from psephos.llm.common import arrow_map, batch_of, gram_hashes, hashed_words, held_out_column, small_batches

#: Most labelled rows that training looks at.
SAMPLE = 8_000
#: Most bytes of text that are trained on, and of one text among them.
SAMPLE_BYTES = 64 << 20
LONGEST = 1 << 20
#: Passes over the sample: at least so many, and as many as give so many updates.
EPOCHS = 3
UPDATES = 12_000
BITS = 18
DIMENSIONS = 1 << BITS
#: Sizes of the grams of words and of shapes.
WORD_GRAMS = (1, 2)
SHAPE_GRAMS = (1, 2, 3)
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-3
#: Scale of the values, which are shares.
SCALE = 8.0

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[65:91] = 65
_SHAPE[97:123] = 97
_SHAPE[128:] = 97
_SHAPE[48:58] = 48
_SHAPE[9:14] = 32


def shapes(data: bytes) -> bytes:
    """The bytes by class, runs of one class as one."""
    s = _SHAPE[np.frombuffer(data, dtype=np.uint8)]
    return s[np.concatenate([[True], s[1:] != s[:-1]])].tobytes() if len(s) else b""


def features(text: str | None) -> list[np.ndarray]:
    """Slots of a text's n-grams, one array for each kind."""
    if not text:
        return []
    data = text.encode("utf-8", "surrogatepass")
    out = []
    for kind, (h, sizes) in enumerate(((hashed_words(data.lower()), WORD_GRAMS), (hashed_words(shapes(data)), SHAPE_GRAMS))):
        for k in sizes:
            g = gram_hashes(h + np.uint64(kind * 8 + k), k)
            if len(g):
                out.append((g >> np.uint64(64 - BITS)).astype(np.int64))
    return out


def sparse(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of a text, slots distinct."""
    got = features(text)
    if not got:
        return np.empty(0, np.int64), np.empty(0)
    slots, back = np.unique(np.concatenate(got), return_inverse=True)
    return slots, np.bincount(back, weights=np.concatenate([np.full(len(g), SCALE / len(g)) for g in got]))


class FTRL:
    """Per-coordinate follow-the-regularised-leader for logistic loss, with L1 and L2 terms; slot DIMENSIONS is the bias."""

    def __init__(self) -> None:
        self.z = np.zeros(DIMENSIONS + 1)
        self.n = np.zeros(DIMENSIONS + 1)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, slots: np.ndarray, values: np.ndarray, label: int) -> None:
        at, x = np.append(slots, DIMENSIONS), np.append(values, 1.0)
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def training_rows(docs: DataFrame, labels: DataFrame, label: str, sample: int, size: int = SAMPLE_BYTES) -> DataFrame:
    """(doc_id, label, text) of labelled documents that are not held out, in one partition, in hash order: those with the
    smallest hashes of their ids, at most ``sample`` of them and ``size`` bytes of text, without texts beyond LONGEST bytes.

    A document with several labels has the largest, one with several texts the smallest. What is broadcast is the sample's ids.
    """
    key = F.col("doc_id").cast("bigint")
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out_column())
    chosen = known.groupBy(key.alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(key.alias("doc_id"), "text")
    sizes = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.max(F.coalesce(F.octet_length("text"), F.lit(0))).alias("n"))
    sizes = sizes.where(F.col("n") <= LONGEST).withColumn("total", F.sum("n").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id")))  # at most ``sample`` rows
    kept = sizes.where(F.col("total") <= size).select("doc_id", "label")
    texts = rows.join(F.broadcast(kept), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return texts.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id").select("doc_id", "label", "text")


def trained(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """The weights, bias last."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[tuple[np.ndarray, np.ndarray, int]] = []
        model = FTRL()
        for b in batches:
            for y, t in zip(b.column("label").to_pylist(), b.column("text").to_pylist(), strict=True):
                slots, values = sparse(t)
                seen.append((slots.astype(np.int32), values.astype(np.float32), y))
                model.learn(slots, values, y)
        for _ in range(max(EPOCHS, ceil(UPDATES / max(1, len(seen)))) - 1):
            for slots, values, y in seen:
                model.learn(slots, values, y)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights(slice(None)).astype("<f4").tobytes()], pa.binary())], names=["weights"])

    small_batches(docs.sparkSession)
    row = training_rows(docs, labels, "quality", sample).mapInArrow(fit, "weights binary").first()
    return np.frombuffer(row.weights, dtype="<f4") if row else np.zeros(DIMENSIONS + 1, np.float32)


def score(text: str | None, weights: np.ndarray) -> float:
    total = float(weights[-1]) + sum(SCALE * float(weights[g].mean(dtype=np.float64)) for g in features(text))
    return float(1 / (1 + np.exp(-np.clip(total, -35, 35))))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(trained(docs, labels, sample))
    types = {"doc_id": pa.int64(), "score": pa.float64()}

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        return batch_of({"doc_id": b.column("doc_id"), "score": [score(t, shared.value) for t in b.column("text").to_pylist()]}, types)

    out = arrow_map(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), fn, "doc_id bigint, score double")
    return out.select("doc_id", F.coalesce(held_out_column(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
