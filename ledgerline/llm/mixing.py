"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Each source is dealt into shards of bounded size by a hash of doc_id and text; a shard's
documents, in a fixed order, are one run of words, which is cut into blocks of equal word
counts. All blocks of the mix are seats: sources get them by the highest quotients
w / (2 n + 1) of their target words, and so do the shards of a source by their words, so
quotas are integers and none is above ``most`` times the blocks there are. A shard takes each
block ``quota // blocks`` times, and those with the smallest seeded hashes once more (``mix``).

``whole`` takes whole documents instead: a shard's quota in words becomes so many copies of
all its documents and one more of the first ones in a seeded order, up to the quota. What
the shards of a source miss together is made good in its largest one, so a source's words are
within one document of its target.

The driver holds a row for each source, at most ``SOURCES``, and a row for each shard, at most
``SHARDS`` and the sources; beyond that bound an error is raised before anything is gathered.
Documents meet only their shard's row, and a hot source is many shards.

Defined results: a null text has size 0; sizes of 0 take nothing, and a source of
size 0 has the target 0. A null source is one of its own, last in order. Rows of one
doc_id count each for itself, null doc_ids too; rows equal in doc_id and text stand side by side
in one shard. An empty table gives an empty result. Other columns are kept, and new columns
replace ones of the same name.
"""

from __future__ import annotations

import heapq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch

#: Sources at most, and shards over all sources, besides one for each source.
SOURCES, SHARDS = 1_000_000, 65_536
#: Words of a shard and of a block at least.
SHARD_WORDS, BLOCK_WORDS = 131_072, 64
#: Rows of a table that is broadcast: some 10 MB.
BROADCAST = 50_000
NEW = ("size", "source_size", "target", "taken")


def targets(sizes: list[int], weights: list[float], most: float = 3.0) -> np.ndarray:
    """Words wanted of each source: all sizes shared by weight, none above most times its size, the excess reshared."""
    size, weight = np.asarray(sizes, float), np.asarray(weights, float)
    out, left, open_ = np.zeros(len(size)), size.sum(), np.ones(len(size), bool)
    while open_.any():
        share = left * weight / weight[open_].sum()
        full = open_ & (share >= most * size)
        if not full.any():
            out[open_] = share[open_]
            break
        out[full] = most * size[full]
        left -= out[full].sum()
        open_ &= ~full
    return out


def apportion(weights: np.ndarray, seats: int, limits: np.ndarray) -> np.ndarray:
    """Seats by the highest quotients w / (2 n + 1), the first of equal ones, none above its limit."""
    weights, limits = np.asarray(weights, float), np.asarray(limits, np.int64)
    got = np.zeros(len(weights), np.int64)
    seats = min(seats, int(limits[weights > 0].sum()))
    if seats <= 0:
        return got

    def at(level: float) -> np.ndarray:
        """Seats whose quotients are above level."""
        n = np.ceil((weights / level - 1) / 2)
        return np.clip(n, 0, limits).astype(np.int64)

    low, high = 1e-12, float(weights.max()) * 2
    for _ in range(200):
        mid = (low * high) ** 0.5
        low, high = (mid, high) if at(mid).sum() > seats else (low, mid)
    got = at(high)  # all seats but those of equal quotients near the level
    heap = [(-weights[i] / (2 * got[i] + 1), i) for i in range(len(weights)) if weights[i] > 0 and got[i] < limits[i]]
    heapq.heapify(heap)
    for _ in range(seats - int(got.sum())):
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < limits[i]:
            heapq.heappush(heap, (-weights[i] / (2 * got[i] + 1), i))
    return got


class Shards(NamedTuple):
    """One entry for each shard, by source and number: its source's place, its number, its words, blocks and quota of blocks."""

    source: np.ndarray
    shard: np.ndarray
    words: np.ndarray
    blocks: np.ndarray
    quota: np.ndarray


def _size(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def _sent(table: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(table) if rows <= BROADCAST else table


def quotas(sized: DataFrame, source: str, weights: tuple[float, ...], most: int) -> tuple[DataFrame, int, np.ndarray]:
    """(__source, __i, source_size, target, __shards) of every source, their number and targets."""
    spark = sized.sparkSession
    by_source = sized.groupBy(source).agg(F.sum("size").alias("size"))
    if (n := by_source.count()) > SOURCES:
        raise ValueError(f"{n} sources; a mix is of {SOURCES} at most")
    found = by_source.orderBy(F.col(source).isNull(), source).toArrow()  # one row for each source, at most SOURCES
    size = found["size"].to_numpy()
    wanted = targets(size, np.resize(np.asarray(weights, float), n), most)
    shard_words = max(SHARD_WORDS, -(-int(size.sum()) // SHARDS))
    table = pa.table({"__source": found[source], "__i": np.arange(n, dtype=np.int32), "source_size": size, "target": wanted, "__shards": np.maximum(1, -(-size // shard_words))})
    return spark.createDataFrame(table, f"__source {dict(sized.dtypes)[source]}, __i int, source_size long, target double, __shards long") if n else None, n, wanted


def shards_of(dealt: DataFrame, wanted: np.ndarray, most: int) -> Shards:
    """All shards with their quotas: at most SHARDS and the sources."""
    found = dealt.where("size > 0").groupBy("__i", "__shard").agg(F.sum("size").alias("words")).orderBy("__i", "__shard").toArrow()
    of, number, words = (found[c].to_numpy().astype(np.int64) for c in ("__i", "__shard", "words"))
    total = int(words.sum())
    smallest = min((t for t in wanted if t > 0), default=0)
    shard_words = max(SHARD_WORDS, -(-total // SHARDS))
    block_words = int(max(BLOCK_WORDS, min(smallest // 512, shard_words // 64), shard_words // 2048))
    blocks = np.maximum(1, (words + block_words // 2) // block_words)
    quota = np.zeros(len(of), np.int64)
    if len(of):
        n = len(wanted)
        blocks_of = np.bincount(of, blocks, n).astype(np.int64)
        mean = np.bincount(of, words, n) / np.maximum(1, blocks_of)  # words of a source's block
        ideal = np.divide(wanted, mean, out=np.zeros(n), where=mean > 0)
        seats = apportion(ideal, int(round(float(ideal.sum()))), blocks_of * most)
        first, count = np.unique(of, return_index=True, return_counts=True)[1:]
        one = first[count == 1]
        quota[one] = np.minimum(seats[of[one]], blocks[one] * most)
        for s, k in zip(first[count > 1].tolist(), count[count > 1].tolist()):  # sources of over a shard's words
            quota[s : s + k] = apportion(words[s : s + k], int(seats[of[s]]), blocks[s : s + k] * most)
    return Shards(of, number, words, blocks, quota)


def _dealt(sized: DataFrame, of_source: DataFrame, n: int, source: str, seed: int) -> DataFrame:
    """sized (with __d, a hash of the text) with its source's row and its shard."""
    dealt = sized.join(_sent(of_source, n), F.col(source).eqNullSafe(F.col("__source"))).drop("__source")
    return dealt.withColumn("__shard", F.pmod(F.xxhash64(F.lit(seed), F.col("__id"), F.col("__d")), F.col("__shards")))


def _table(df: DataFrame, columns: dict[str, np.ndarray], schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame(pa.table(columns), schema)


def _empty(df: DataFrame, kept: list[str], new: dict[str, str]) -> DataFrame:
    return df.select(*kept, *(F.lit(None).cast(t).alias(c) for c, t in new.items())).limit(0)


def mix(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (5, 2, 1), most: int = 3, seed: int = 7) -> DataFrame:
    """df without its text, with size, source_size, target and taken."""
    scratch = Scratch(df.sparkSession, "mixing")
    kept = [c for c in df.columns if c != text and c not in NEW]
    sized = scratch.write(df.select(*kept, F.col(doc_id).alias("__id"), F.xxhash64(text).alias("__d"), _size(text).alias("size")), "sized")
    of_source, n, wanted = quotas(sized, source, weights, most)
    if n == 0:
        return _empty(df, kept, {"size": "long", "source_size": "long", "target": "double", "taken": "long"})
    dealt = _dealt(sized, of_source, n, source, seed)
    s = shards_of(dealt, wanted, most)
    table = _table(df, {"__j": s.source, "__s": s.shard, "__words": s.words, "__blocks": s.blocks, "__each": s.quota // s.blocks, "__more": s.quota % s.blocks}, "__j long, __s long, __words long, __blocks long, __each long, __more long")
    block_hash = lambda b: F.xxhash64(F.lit(seed), F.col("__j"), F.col("__s"), b)
    ranked = F.sort_array(F.transform(F.sequence(F.lit(0).cast("long"), F.col("__blocks") - 1), block_hash))
    table = table.withColumn("__last", F.when(F.col("__more") > 0, F.get(ranked, (F.col("__more") - 1).cast("int"))))

    order = Window.partitionBy("__i", "__shard").orderBy("__id", "__d", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = dealt.where("size > 0").withColumn("__end", F.sum("size").over(order))
    placed = placed.join(_sent(table, len(s.source)), (F.col("__i") == F.col("__j")) & (F.col("__shard") == F.col("__s")))
    start, words_, blocks_ = F.col("__end") - F.col("size"), F.col("__words"), F.col("__blocks")
    block_of = lambda p: _div((p + 1) * blocks_ - 1, words_)
    edge = lambda b: _div(b * words_, blocks_)
    chosen = F.filter(F.sequence(block_of(start), block_of(F.col("__end") - 1)), lambda b: block_hash(b) <= F.col("__last"))
    more = F.aggregate(chosen, F.lit(0).cast("long"), lambda a, b: a + F.least(edge(b + 1), F.col("__end")) - F.greatest(edge(b), start))
    taken = F.col("__each") * F.col("size") + F.when(F.col("__more") > 0, more).otherwise(0)
    out = [*kept, "size", "source_size", "target"]
    return placed.select(*out, taken.cast("long").alias("taken")).unionByName(dealt.where("size = 0").select(*out, F.lit(0).cast("long").alias("taken")))


def _div(a, b):
    """Whole division of non-negative longs, without a detour through doubles."""
    return F.call_function("div", a, b)


def whole(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (5, 2, 1), most: int = 3, seed: int = 7) -> DataFrame:
    """df with copies, the times that the mix takes each document as a whole: 0 to most.

    A source's copied words are within one document of its target, if its largest shard has the
    room. Documents of size 0 have 0 copies.
    """
    scratch = Scratch(df.sparkSession, "mixing")
    kept = [c for c in df.columns if c != "copies"]
    known = [F.col(doc_id).alias("__id"), F.xxhash64(text).alias("__d"), _size(text).alias("size")]
    light = scratch.write(df.select(F.col(source).alias("__of"), *known), "sized")
    of_source, n, wanted = quotas(light, "__of", weights, most)
    if n == 0:
        return _empty(df, kept, {"copies": "int"})
    dealt = _dealt(light, of_source, n, "__of", seed)
    s = shards_of(dealt, wanted, most)
    order = Window.partitionBy("__i", "__shard").orderBy(F.xxhash64(F.lit(seed + 1), "__id", "__d"), "__id", "__d", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def placed(rows: DataFrame, quota: np.ndarray) -> DataFrame:
        """rows of the shards with copies; quota: words of each shard."""
        each = np.minimum(quota // s.words, most)
        table = _table(df, {"__j": s.source, "__s": s.shard, "__each": each.astype(np.int64), "__words": (quota - each * s.words).astype(np.int64)}, "__j long, __s long, __each long, __words long")
        run = rows.where("size > 0").withColumn("__middle", F.sum("size").over(order) - F.col("size") / 2)
        run = run.join(_sent(table, len(s.source)), (F.col("__i") == F.col("__j")) & (F.col("__shard") == F.col("__s")))
        return run.withColumn("copies", (F.col("__each") + F.when(F.col("__middle") < F.col("__words"), 1).otherwise(0)).cast("int")).drop("__each", "__words", "__j", "__s", "__middle")

    words = (s.quota * s.words) // np.maximum(1, s.blocks)
    got = placed(dealt, words).groupBy("__i", "__shard").agg(F.sum(F.col("copies") * F.col("size")).alias("n")).orderBy("__i", "__shard").toArrow()["n"].to_numpy()
    if len(words):
        missed = np.rint(wanted - np.bincount(s.source, got, n)).astype(np.int64)
        last = np.lexsort((s.words, s.source))  # the largest shard of each source comes last of its own
        largest = last[np.append(np.diff(s.source[last]) != 0, True)]
        words[largest] = np.clip(words[largest] + missed[s.source[largest]], 0, most * s.words[largest])
    full = _dealt(df.select(F.struct(*kept).alias("__row"), F.col(source).alias("__of"), *known), of_source, n, "__of", seed)
    return placed(full, words).select("__row.*", "copies").unionByName(df.where(_size(text) == 0).select(*kept, F.lit(0).alias("copies")))
