"""Language ID by Bayesian fusion of evidence.

For each page the log-odds of every language add up from

* the text: byte trigrams of its visible main text under smoothed models of each language,
  learned from a bounded sample of labelled documents (``SAMPLE`` for each language, whole texts);
* the language that the markup declares: how often pages of each language declare it;
* the suffix of the address, its domain and its host: shares of the languages among the
  pages of each, every level smoothed by the one above (all, suffix, domain, host).

The last two are grouped sums of the text's probabilities over all pages, with partial
aggregation, and a page's own share is taken out of what it is judged by. Pages of a host (or domain,
suffix, declared language) that has over 1 in ``common.HOT`` of all pages meet its shares by
broadcast, so no host's pages are gathered.

The markup is read in one pass, so its time is in proportion to its length whatever is left open in
it: a comment that isn't closed hides the rest, an element that isn't closed hides nothing, and a
"<" after which no ">" comes is text.

Defined results: a null or empty page has the text evidence 0, so it is judged by what is
declared and by its address. A null address is a host of its own under the suffix "". With
no labelled documents at all the language is null; with over ``LANGUAGES`` an error is raised, as the
model is sent to every task. Of equal languages the first by name is told. Rows that repeat a
page_id are judged each for itself. Other columns are kept; new columns replace ones of the same
name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import HOT, Scratch

#: Labelled documents of each language that are learned from, and languages at most: 64 MB of model.
SAMPLE, LANGUAGES = 300, 512
BUCKETS = 1 << 15
#: Trigrams overlap, so their log-likelihoods count in part; a page's are scaled to a range of so many.
PART, RANGE = 0.3, 60.0
#: Pages that a level's own shares must outweigh.
STRENGTH = 10.0
#: What a declared language that no page of a language declares counts, and languages that may be declared.
RARE, DECLARED = 0.5, 20
NEW = ("language", "probability", "text_language", "declared")

# Elements whose text isn't the page's.
HIDDEN = (b"script", b"style", b"nav", b"footer", b"template", b"noscript")
_NAME = re.compile(rb"<([a-z]+)")
_ENTITY = re.compile(rb"&[#a-zA-Z0-9]{1,32};")
_LANG = re.compile(rb"\blang\s*=\s*[\"']?\s*([a-zA-Z]{2,3})\b", re.I)


def visible(html: bytes) -> bytes:
    """The text of a page without markup, comments and hidden elements, with one space between words."""
    low, out, at = html.lower(), [], 0
    open_ = set(HIDDEN)  # those that are still closed somewhere further on
    while (start := html.find(b"<", at)) >= 0:
        out.append(html[at:start])
        if html.startswith(b"<!--", start):
            end = html.find(b"-->", start + 4)
            at = len(html) if end < 0 else end + 3
            continue
        name = m[1] if (m := _NAME.match(low, start)) else b""
        end = start + 1
        if name in open_:
            end = low.find(b"</" + name, start)
            if end < 0:
                open_.discard(name)
                end = start + 1
        end = html.find(b">", end)
        if end < 0:
            at = start
            break
        at = end + 1
    out.append(html[at:])
    return b" ".join(_ENTITY.sub(b" ", b" ".join(out)).split())


def declared_in(html: bytes) -> str:
    """The language that the first html tag declares, or nothing."""
    start = html.lower().find(b"<html")
    end = html.find(b">", start)
    if start < 0 or end < 0:
        return ""
    found = _LANG.search(html, start, end)
    return found[1].decode().lower() if found else ""


def trigrams(text: bytes) -> np.ndarray:
    b = np.frombuffer(b" " + text.lower() + b" ", np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64)
    code = b[:-2] * np.uint32(0x1F35) + b[1:-1] * np.uint32(0x3A2B1) + b[2:] * np.uint32(0x5BD1E995)
    return ((code ^ (code >> np.uint32(15))) & np.uint32(BUCKETS - 1)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, bucket, n): trigrams of a partition's texts."""
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            total[name] = total.get(name, 0) + np.bincount(trigrams(text.as_py().encode()), minlength=BUCKETS)
    for name, counts in total.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], names=["lang", "bucket", "n"])


def fit(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages in order and the log-probability of each bucket under each.

    One pass finds every language's documents of the smallest hashes of doc_id and text, one counts
    the trigrams of their whole texts, a language's sample in one task; the driver gets the counts.
    """
    fine = docs.where(F.col(lang).isNotNull() & (F.octet_length(text) >= 20)).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.lit(5), doc_id, text).alias("h"))
    langs = [r[0] for r in fine.select("lang").distinct().orderBy("lang").limit(LANGUAGES + 1).collect()]
    if len(langs) > LANGUAGES:
        raise ValueError(f"over {LANGUAGES} languages")
    # of each language the rows of the smallest hashes, by a threshold that some four times as many pass
    rows = fine.select("lang", "h").distinct()
    place = F.pmod("h", F.lit(1 << 20))
    most = F.broadcast(rows.groupBy("lang").count())  # LANGUAGES rows at most
    few = rows.join(most, "lang").where(place * F.col("count") <= (1 << 20) * 4 * (sample + 10))
    chosen = few.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(place, "h"))).where(F.col("k") <= sample).select("lang", "h")
    texts = fine.join(F.broadcast(chosen), ["lang", "h"]).dropDuplicates(["lang", "h"]).select("lang", "text")  # LANGUAGES x sample rows at most
    found = texts.repartition("lang").mapInArrow(_counted, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.full((len(langs), BUCKETS), 0.2)
    at = np.searchsorted(np.array(langs, object), found["lang"].to_numpy(zero_copy_only=False)) if len(langs) else np.zeros(0, int)
    counts[at, found["bucket"].to_numpy()] += found["n"].to_numpy()
    return langs, np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32)


def identify(pages: DataFrame, docs: DataFrame, *, url: str = "url", html: str = "html", model: tuple[list[str], np.ndarray] | None = None) -> DataFrame:
    """pages without their html, with language, probability, text_language and declared."""
    spark = pages.sparkSession
    langs, logs = model or fit(docs)
    kept = [c for c in pages.columns if c != html and c not in NEW]
    if not langs:
        return pages.select(*kept, *(F.lit(None).cast("double" if c == "probability" else "string").alias(c) for c in NEW))
    scratch, n = Scratch(spark, "language"), len(langs)
    shared = spark.sparkContext.broadcast(logs)  # languages x BUCKETS floats
    schema = T.StructType([*(pages.schema[c] for c in kept), T.StructField("__e", T.ArrayType(T.DoubleType())), T.StructField("declared", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = shared.value
        for batch in batches:
            column, evidence, declared = batch.column(batch.schema.get_field_index(html)), [], []
            for x in column:
                raw = (x.as_py() or "").encode()
                declared.append(declared_in(raw))
                e = np.zeros(n)
                t = trigrams(visible(raw))
                for start in range(0, len(t), 1 << 16):
                    e += logs[:, t[start : start + (1 << 16)]].sum(1, dtype=np.float64)
                e = (e - e.max()) * PART
                evidence.append(e * (RANGE / max(RANGE, -e.min())))
            values = np.concatenate(evidence) if evidence else np.zeros(0)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(evidence) + 1, dtype=np.int32) * n), pa.array(values))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), lists, pa.array(declared)], names=[*kept, "__e", "declared"])

    scored = pages.select(*dict.fromkeys([*kept, html])).mapInArrow(run, schema)
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1))
    parts = F.split("__host", r"\.")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    odds = F.transform("__e", F.exp)
    scored = scored.withColumn("__host", host).withColumn("__suffix", F.element_at(parts, -1)).withColumn("__domain", F.array_join(F.slice(parts, -F.least(F.size(parts), F.lit(2)), F.lit(2)), "."))
    scored = scored.withColumn("__x", odds).withColumn("__t", total(F.col("__x"))).withColumn("__p", F.transform("__x", lambda v: v / F.col("__t"))).drop("__x", "__t")
    scored = scratch.write(scored.withColumn("__number", F.monotonically_increasing_id()), "text")  # written, so numbers stay
    total_rows = scored.count()

    def shares(name: str, *by: str) -> DataFrame:
        """Sums of the pages' probabilities by columns, an array of one number for each language, and c, the pages."""
        sums = [F.sum(F.get("__p", F.lit(i))).alias(f"s{i}") for i in range(n)]
        return scratch.write(scored.groupBy(*by).agg(F.count("*").alias("c"), *sums).select(*by, "c", F.array(*(f"s{i}" for i in range(n))).alias(f"__{name}")), name)

    def with_shares(pages: DataFrame, of: DataFrame, name: str, by: str) -> DataFrame:
        """pages with the shares of their value of by; those of hot values, fewer than HOT, by broadcast, and their own keys spread."""
        hot = F.broadcast(of.where(F.col("c") * HOT > total_rows).select(F.col(by).alias("__hot"), F.col(f"__{name}").alias("__shares")))
        cold = of.where(F.col("c") * HOT <= total_rows).select(F.concat(F.lit("="), by).alias("__cold"), F.col(f"__{name}"))
        spread = F.when(F.col("__hot").isNull(), F.concat(F.lit("="), by)).otherwise(F.col("__number").cast("string"))
        both = pages.join(hot, F.col(by) == F.col("__hot"), "left").withColumn("__key", spread).join(cold, F.col("__key") == F.col("__cold"), "left")
        return both.withColumn(f"__{name}", F.coalesce(f"__{name}", "__shares")).drop("__hot", "__shares", "__key", "__cold")

    each = shares("all")
    joined = scored.crossJoin(F.broadcast(each.drop("c")))  # one row
    for name, by in (("of_suffix", "__suffix"), ("of_domain", "__domain"), ("of_host", "__host"), ("of_declared", "declared")):
        joined = with_shares(joined, shares(name, by), name, by)
    prior = F.zip_with("__all", "__p", lambda s, p: s - p + 1.0)
    joined = joined.withColumn("__prior", prior).withColumn("__count", total(F.col("__prior"))).withColumn("__prior", F.transform("__prior", lambda v: v / F.col("__count")))
    for level in ("of_suffix", "of_domain", "of_host"):
        own = F.zip_with(f"__{level}", "__p", lambda s, p: F.greatest(s - p, F.lit(0.0)))
        joined = joined.withColumn("__own", own).withColumn("__count", total(F.col("__own")))
        joined = joined.withColumn("__prior", F.zip_with("__own", "__prior", lambda s, q: (s + STRENGTH * q) / (F.col("__count") + STRENGTH)))
    # how often pages of each language declare what this one declares
    said = F.zip_with(F.zip_with("__of_declared", "__p", lambda s, p: F.greatest(s - p, F.lit(0.0))), F.zip_with("__all", "__p", lambda s, p: F.greatest(s - p, F.lit(0.0))), lambda s, a: F.log((s + RARE) / (a + RARE * DECLARED)))
    post = F.zip_with(F.zip_with("__e", "__prior", lambda e, q: e + F.log(q + 1e-12)), F.when(F.col("declared") == "", F.transform("__e", lambda e: F.lit(0.0))).otherwise(said), lambda a, b: a + b)
    joined = joined.withColumn("__post", post).withColumn("__top", F.array_max("__post"))
    names = F.array(*map(F.lit, langs))
    best = F.element_at(names, F.array_position("__post", F.col("__top")).cast("int"))
    text_best = F.element_at(names, F.array_position("__p", F.array_max("__p")).cast("int"))
    sure = 1 / total(F.transform("__post", lambda v: F.exp(v - F.col("__top"))))
    return joined.select(*kept, best.alias("language"), sure.alias("probability"), text_best.alias("text_language"), "declared")
