"""Quality rules: base measures of a document, and lines that too many documents of a host share.

Lines are normalised (ASCII lower case, white space as one space, none at the ends) and hashed; for each host the distinct
documents that have a line are counted. Lines that more than ``line_limit`` documents of their host have are removed, and a
document that keeps less than ``least_kept`` per cent of its words is depleted and rejected, as is one that fails a base rule.

One Python pass over the texts leaves a few numbers and the line hashes of each document; everything after that is relational.
Counts are aggregated before they are shuffled, so a hot host or line sends a row from each task. The join of lines with the
common ones is on (host, line) and streams; a line of so many rows that its partition exceeds the skew size is split by
adaptive execution.

Defined cases: a null text has no words and fails the base; a null host is a host of its own, apart from the empty one; rows of
one id are one document, and so are all rows without an id; repeated rows are judged alike; a very long text is measured whole; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from psephos.llm.common import WORD, arrow_map, batch_of, gram_hashes, saved, small_batches, stable_text_hash, texts_of

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
#: Per cent of words in repeated windows above which a document fails.
MAX_REPEATED = 30
#: A line of more distinct documents of one host than this is boilerplate.
LINE_LIMIT = 20
#: Per cent of its words that a document must keep.
LEAST_KEPT = 33

BLANKS = re.compile(r"[\x20\x09-\x0D]+")


def repeated_words(words: list[str]) -> int:
    """Words inside 8-word windows that occur twice or more, the first occurrence included."""
    if len(words) <= WINDOW:
        return 0
    grams = gram_hashes(np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64), WINDOW)
    ordered = np.sort(grams)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    starts = np.flatnonzero(np.isin(grams, twice))
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + WINDOW, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def normal_line(line: str) -> str:
    """ASCII lower case, white space as one space, none at the ends."""
    plain = line.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    return BLANKS.sub(" ", plain).strip("\x20\x09\x0a\x0b\x0c\x0d")


def taken_out(text: str, gone: set[int]) -> str:
    """The text without the lines whose normalised form has one of the hashes; blank lines stay."""
    return "\n".join(x for x in text.split("\n") if not (n := normal_line(x)) or stable_text_hash(n) not in gone)


def measures(text: str) -> dict[str, object]:
    """Base measures of a text and its normalised lines as (hash, words)."""
    words = WORD.findall(text)
    seen: set[str] = set()
    dup, lines, sizes = 0, [], []
    for line in text.split("\n"):
        normal = normal_line(line)
        if not normal:
            continue
        if line in seen:
            dup += 1
        seen.add(line)
        lines.append(stable_text_hash(normal))
        sizes.append(normal.count(" ") + 1)
    repeats = repeated_words(words)
    n = len(words)
    return {
        "n_words": n, "word_chars": sum(map(len, words)), "n_symbols": sum(map(text.count, SYMBOLS)), "n_dup_lines": dup, "n_repeat_words": repeats,
        "base_failed": n < MIN_WORDS or 100 * repeats > MAX_REPEATED * n, "_lines": lines, "_sizes": sizes,
    }


def _judged(docs: DataFrame, host_col: str, line_limit: int, least_kept: int, with_text: bool = False) -> DataFrame:
    """The measures of each document, ``n_boilerplate_words`` and ``kept``; on request its text and ``_gone``, the hashes of its common lines."""
    small_batches(docs.sparkSession)
    types = {
        "doc_id": pa.int64(), "_host": pa.string(), "_row": pa.int64(), "n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(),
        "n_repeat_words": pa.int64(), "base_failed": pa.bool_(), "_lines": pa.list_(pa.int64()), "_sizes": pa.list_(pa.int32()),
    }
    if with_text:
        types["text"] = pa.large_string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            got = [measures(t) for t in texts_of(b)]
            out: dict[str, object] = {k: [g[k] for g in got] for k in types if got and k in got[0]}
            out |= {"doc_id": b.column("doc_id"), "_host": b.column("host"), "_row": list(range(row, row + b.num_rows))}
            if with_text:
                out["text"] = b.column("text").cast(pa.large_string())
            row += b.num_rows
            if b.num_rows:
                yield batch_of(out, types)

    schema = (
        "doc_id bigint, _host string, _row bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint,"
        " n_repeat_words bigint, base_failed boolean, _lines array<bigint>, _sizes array<int>" + (", text string" if with_text else "")
    )
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.concat(F.lit("="), F.col(host_col)), F.lit("")).alias("host"), "text")
    measured = saved(source.mapInArrow(run, schema), "line-measures")

    lines = measured.select("_row", "_host", "doc_id", F.explode(F.arrays_zip("_lines", "_sizes")).alias("x")).select(
        "_row", "_host", "doc_id", F.col("x._lines").alias("_line"), F.col("x._sizes").alias("_size")
    )
    common = lines.select("_host", "_line", "doc_id").distinct().groupBy("_host", "_line").count().where(F.col("count") > line_limit)
    lost = (
        lines.groupBy("_row", "_host", "_line").agg(F.sum("_size").alias("_size"))
        .join(common.select("_host", "_line"), ["_host", "_line"])
        .groupBy("_row").agg(F.sum("_size").alias("_lost"), *([F.collect_set("_line").alias("_gone")] if with_text else []))
    )
    judged = measured.join(lost, "_row", "left").withColumn("_lost", F.coalesce("_lost", F.lit(0)))
    depleted = 100 * (F.col("n_words") - F.col("_lost")) < least_kept * F.col("n_words")
    return judged.withColumn("kept", ~F.col("base_failed") & ~depleted).withColumnRenamed("_lost", "n_boilerplate_words")


def line_quality(docs: DataFrame, host_col: str = "source", line_limit: int = LINE_LIMIT, least_kept: int = LEAST_KEPT) -> DataFrame:
    """Per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_boilerplate_words."""
    judged = _judged(docs, host_col, line_limit, least_kept)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_boilerplate_words")


def without_common_lines(docs: DataFrame, host_col: str = "source", line_limit: int = LINE_LIMIT, least_kept: int = LEAST_KEPT) -> DataFrame:
    """Per document: doc_id, text with the common lines of its host taken out, n_boilerplate_words (the words of these), kept."""
    rows = _judged(docs, host_col, line_limit, least_kept, with_text=True).select("doc_id", "text", "_gone", "n_boilerplate_words", "kept")
    types = {"doc_id": pa.int64(), "text": pa.large_string(), "n_boilerplate_words": pa.int64(), "kept": pa.bool_()}

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t if not t or not gone else taken_out(t, set(gone)) for t, gone in zip(b.column("text").to_pylist(), b.column("_gone").to_pylist(), strict=True)]
        return batch_of({"doc_id": b.column("doc_id"), "text": texts, "n_boilerplate_words": b.column("n_boilerplate_words"), "kept": b.column("kept")}, types)

    return arrow_map(rows, fn, "doc_id bigint, text string, n_boilerplate_words bigint, kept boolean")
