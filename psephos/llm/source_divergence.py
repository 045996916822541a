"""How far the sources of a language differ in their terms, and which terms mark each source.

1. Every task counts the terms of its texts for each (language, source) and in how many documents they are, and hands on sums.
2. One shuffle by (language, term) completes the counts. A term of at least ``MIN_DOCS`` documents of its language is kept and
   pivoted: one row with an array of counts, one place for each source of the language.
3. Array functions turn counts into scaled probabilities p = 1 + floor(SCALE * (count + SMOOTH) / (N + SMOOTH * V)), N the
   source's kept occurrences and V the kept terms, and give each pair of sources its |p - p'|, place by place; partial
   aggregation sums them before the shuffle. All of it is whole numbers (decimals of 38 digits before the division).
4. A source's terms are those with p above the whole language's; a rank limit is applied in each task before ranks are final.

A row of step 2 is as wide as a language has sources, and the result has all pairs of sources of a language.

Defined cases: a null text, language or source is ''; a source without terms is a group like any other; a language without
kept terms has pairs of value 0 and no terms; ties rank by UTF-8 bytes; repeated rows and ids count as documents each; very
long texts are counted whole, like others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from psephos.llm.common import batch_of, saved, small_batches

#: Documents of a language that a kept term is in, at least.
MIN_DOCS = 30
SCALE, SMOOTH = 1_000_000_000, 5
#: Terms that are listed for a source.
TOP = 50
#: Counts that a task holds before it hands them on.
HELD = 400_000

#: Upper case to lower, and all that is in no term to blanks: a term is a run of ASCII letters and other than ASCII bytes.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: str) -> list[bytes]:
    """The terms of a text in order, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): sums of each task; a row with a null term for each group."""
    types = {"lang": pa.string(), "source": pa.string(), "term": pa.string(), "n": pa.int64(), "docs": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter[bytes], Counter[bytes]]] = {}

        def sums() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, within) in groups.items():
                words = list(n)
                for k in range(0, max(len(words), 1), 10_000):
                    part = words[k : k + 10_000]
                    first = [None] if not k else []
                    size = len(first) + len(part)
                    yield batch_of({"lang": [lang] * size, "source": [source] * size, "term": first + [w.decode() for w in part], "n": [0] * len(first) + [n[w] for w in part], "docs": [0] * len(first) + [within[w] for w in part]}, types)
            groups.clear()

        for b in batches:
            for text, lang, source in zip(*(b.column(c).to_pylist() for c in ("text", "lang", "source")), strict=True):
                n, within = groups.setdefault((lang, source), (Counter(), Counter()))
                words = terms(text)
                n.update(words)
                within.update(set(words))
            if sum(len(n) for n, _ in groups.values()) > HELD:
                yield from sums()
        yield from sums()

    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    return rows.mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")


def scaled(count: Column, whole: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + SMOOTH) / (whole + SMOOTH * kept)), exact."""
    top = (count.cast("decimal(20,0)") + F.lit(SMOOTH)) * F.lit(SCALE)
    return F.call_function("div", top.cast("decimal(38,0)"), (whole.cast("decimal(20,0)") + kept.cast("decimal(20,0)") * F.lit(SMOOTH)).cast("decimal(38,0)")) + 1


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): distances of each source to the others of its language, and its own terms."""
    small_batches(docs.sparkSession)
    sums = saved(counted(docs), "sums")
    places = sums.where("term IS NULL").select("lang", "source").distinct()
    langs = places.groupBy("lang").agg(F.array_sort(F.collect_list("source")).alias("sources"))

    # both aggregations are by (lang, term), so there is one shuffle
    own = sums.where("term IS NOT NULL").repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    wide = own.groupBy("lang", "term").agg(F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("by_source"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
    wide = saved(wide.drop("docs"), "wide")

    totals = wide.select("lang", F.explode("by_source").alias("source", "n")).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    totals = totals.groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("totals"), F.sum("n").alias("whole"))
    kept = wide.groupBy("lang").agg(F.count("*").alias("kept"))
    langs = saved(
        langs.join(totals, "lang", "left").join(kept, "lang", "left").select(
            "lang", "sources", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("whole", F.lit(0)).alias("whole"),
            F.transform("sources", lambda s: F.coalesce(F.try_element_at("totals", s), F.lit(0))).alias("totals"),
        ), "langs",
    )

    rows = wide.join(langs, "lang").select("lang", "term", "sources", "totals", "whole", "kept", F.transform("sources", lambda s: F.coalesce(F.try_element_at("by_source", s), F.lit(0))).alias("counts"))
    rows = rows.select("lang", "term", "sources", "counts", "whole", "kept", F.zip_with("counts", "totals", lambda c, n: scaled(c, n, F.col("kept"))).alias("p"))
    return pairs(rows.select("lang", "p"), langs).unionByName(own_terms(rows, top))


def pairs(rows: DataFrame, langs: DataFrame) -> DataFrame:
    """Sums of |p - p'| for each ordered pair of sources; a language's sources start at 0, so pairs without terms are there too."""
    zero = langs.select("lang", F.transform("sources", lambda s: F.lit(0).cast("bigint")).alias("p"))
    one = rows.unionByName(zero).select("lang", "p", F.posexplode("p").alias("i", "own"))
    later = F.transform(F.sequence(F.col("i") + 1, F.size("p") - 1), lambda j: F.struct(j.alias("j"), F.abs(F.get("p", j) - F.col("own")).alias("f")))
    each = one.where(F.col("i") < F.size("p") - 1).select("lang", "i", F.inline(later))
    value = each.groupBy("lang", "i", "j").agg(F.sum("f").alias("value"))
    both = value.select("lang", "value", F.explode(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).alias("at"))
    named = both.join(langs.select("lang", "sources"), "lang").select("lang", F.get("sources", F.col("at.i")).alias("source"), F.lit("pair").alias("part"), F.get("sources", F.col("at.j")).alias("item"), "value")
    return named.withColumn("rank", F.row_number().over(_order()))


def own_terms(rows: DataFrame, top: int) -> DataFrame:
    """Each source's terms with a probability above the language's."""
    whole = F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, c: a + c)
    used = rows.withColumn("q", scaled(whole, F.col("whole"), F.col("kept"))).select("lang", "term", "q", F.inline(F.arrays_zip("sources", "counts", "p")))
    found = used.where("counts > 0 AND p > q").select("lang", F.col("sources").alias("source"), F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    return found.withColumn("rank", F.row_number().over(_order())).where(F.col("rank") <= top)


def _order():
    return Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
