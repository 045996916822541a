"""Pages whose address has a fragment are normalised and counted like all others."""

from __future__ import annotations

import re
from collections import Counter
from urllib.parse import urlsplit

import pytest

from psephos.functions import urls as U
from psephos.plans import registry

PAGES = [
    (0, "https://a.example/x?k=1#part"), (4, "https://a.example/x/#part?k=1"), (8, "https://A.example/x"), (1, "https://a.example/x#y"), (2, "http://b.example/en/z/?utm_medium=q&k=2#top"),
    (3, "https://b.example/#utm_source=1"), (7, "https://c.example/q?fbclid=1#"),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("pages"))
    spark.createDataFrame(PAGES, "page_id bigint, url string").write.parquet(f"{d}/pages.parquet")
    return d


def normal(k: int, url: str) -> tuple[str, str]:
    """The normalised address and its domain, by the standard library."""
    url = url.replace("://", "://www.") if k % 4 == 1 else url.replace("/en/", "//en//") if k % 4 == 2 else url
    u = urlsplit(url)
    host = u.netloc.lower().replace("www.", "")
    kept = "&".join(p for p in u.query.split("&") if p and not p.lower().startswith(U.TRACKING))
    return f"{u.scheme}://{host}{re.sub('/+', '/', u.path).rstrip('/')}" + (f"?{kept}" if kept else ""), host


def test_pages_with_fragments(spark, data, folder):
    for d in (folder, data.replace("sf0.001", "sf0.01")):
        want = {r.page_id: normal(r.page_id, r.url) for r in spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url").collect()}
        assert {r.page_id: r.url for r in registry.queries()["url_normalize"](spark, d).collect()} == {k: v[0] for k, v in want.items()}
        counts = {r.domain: r.n for r in registry.queries()["domain_publisher"](spark, d).collect()}
        assert counts == Counter(v[1] for v in want.values())
