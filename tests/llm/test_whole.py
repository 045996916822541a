"""Stages do the whole job: cases that a narrower rule leaves out."""

from __future__ import annotations

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline
from psephos.llm import line_quality, near_duplicates


def test_pipeline_takes_near_duplicates_from_80_per_cent(spark, data):
    """The stage against brute force over all pairs of the smallest table."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    sets = {r.doc_id: set(near_duplicates.shingles(r.text).tolist()) for r in docs.collect()}
    ids, root = sorted(sets), {k: k for k in sets}
    between = 0
    for i in ids:
        for j in (j for j in ids if j < i and sets[i] and sets[j]):
            both = len(sets[i] & sets[j])
            either = len(sets[i]) + len(sets[j]) - both
            between += 80 * either <= 100 * both < 85 * either
            if 100 * both >= 80 * either and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = {k: a if v == b else v for k, v in root.items()}
    assert between > 0
    left = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, data).collect()}
    assert left == {k for k in ids if root[k] == k}


def test_bands_miss_less_than_one_in_a_million():
    assert near_duplicates.banding(85) == (24, 5)
    for percent in (80, 85, 90, 95):
        bands, rows = near_duplicates.banding(percent)
        assert bands * rows <= near_duplicates.POSITIONS and (1 - (percent / 100) ** rows) ** bands < 1e-6


def test_common_lines_are_taken_out(spark, data):
    body = " ".join(f"own{k}" for k in range(30))
    made = [(k, f"Shared  LINE of the host\n\n{body} {k}\nrare line\n shared line OF the host ", "h") for k in range(30)] + [(99, "Shared line of the host\nx", "g"), (98, None, "h")]
    docs = spark.createDataFrame(made, "doc_id bigint, text string, source string")
    got = {r.doc_id: r for r in line_quality.without_common_lines(docs, line_limit=20).collect()}
    assert all(got[k].text == f"\n{body} {k}" and got[k].n_boilerplate_words == 12 and got[k].kept for k in range(30))
    assert got[99].text == "Shared line of the host\nx" and got[98].text is None
    docs = spark.read.parquet(f"{data}/documents.parquet")
    judged = {r.doc_id: (r.n_boilerplate_words, r.kept) for r in line_quality.line_quality(docs).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in line_quality.without_common_lines(docs).collect():
        assert (r.n_boilerplate_words, r.kept) == judged[r.doc_id]
        words = [sum(len(line_quality.normal_line(x).split()) for x in (t or "").split("\n")) for t in (texts[r.doc_id], r.text)]
        assert words[0] - words[1] == r.n_boilerplate_words
