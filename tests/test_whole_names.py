"""norm_name reads whole texts of all documents."""

from __future__ import annotations

import re
import unicodedata

from psephos.plans import registry

DOCS = [(1, "Élan  " + "mot " * 40 + "Fin & Été", "fr"), (2, "Grüne – ÖDP", "de"), (3, "No language", None), (4, " nan ", "en"), (5, None, "es"), (6, "", "fr"), (7, "ﬁn Ñandú", "es")]


def squeezed(t: str) -> str:
    return re.sub("[^a-z0-9]+", " ", t.lower()).strip(" ")


def folded(t: str | None) -> str:
    text = (t or "").strip()
    text = "" if text.lower() in ("", "nan", "none", "<na>") else text
    return squeezed("".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower().replace("&", " and "))


def test_norm_name_against_brute_force(spark, data, tmp_path):
    spark.createDataFrame(DOCS, "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    for d in (str(tmp_path), data):
        texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
        got = {r.doc_id: (r.plain, r.folded) for r in registry.queries()["norm_name"](spark, d).collect()}
        assert got == {k: (squeezed(t or ""), folded(t)) for k, t in texts.items()}
