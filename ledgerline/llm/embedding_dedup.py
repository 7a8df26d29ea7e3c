"""Embedding near-dedup by counting collisions of sorted one-dimensional projections.

Vectors are scaled to length 1 and projected on seeded directions, in ``tables`` tables. In
each table the vectors are sorted by one projection within the cells of ``width`` others
(intervals of ``cell``, with seeded offsets); every vector is a query, and those in the window
of ``window`` either side of it collide with it. A pair's collisions are counted over the
tables, and pairs that reach ``count`` are verified by cosine in double precision. The cells
keep windows narrow: in a plain sorted projection a useful window holds a sixth or more of
all unrelated vectors, whatever their number, so that counting alone would grow with the square.

``plan`` chooses the numbers: so many tables that a pair at the threshold reaches the count
with probability ``RECALL`` (the difference of its projections is normal with variance
2 - 2 cosine, and directions are independent), and of such plans the one of least work, which is
that of meeting unrelated vectors in windows and of sending a vector to its tables. Nearer
pairs collide more often.

Equal vectors (scaled) are one class with a weight, so copies make no pairs. Windows are cut
into strips as wide as a window, and strips of many vectors into tiles of ``TILE``, whose pairs
are dealt over the tasks; no task gathers a cell or a strip. A vector's row carries its cells
and projections in all tables, so a task counts a pair's collisions in the tables before its own,
and the pair is verified once, where its count is reached. From a tile come, for each vector,
the weight that it links with and the root of what the tile's links connect: never a row for
each pair. Strips of one vector, nearly all, are dropped before vectors are fetched.

Defined results: vectors that are null, zero or empty, or hold null or non-finite components,
link with nothing and are components of their own. Vectors are compared with those of their own
length only; all lengths are. Rows that repeat a vec_id are one vector of several contents: it
joins their components, its n_links is the largest of theirs, and it counts once for each
content that a vector links with. Null vec_ids are left out. Other columns aren't read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, runs_of_keys
from .components import REACHED, components

TILE = 1024
#: Chance that a pair at the threshold is counted often enough.
RECALL = 0.99
#: Work of a meeting of two vectors, of a byte that is sent to a task, and of a table, in nanoseconds.
MEETING, BYTE, TABLE = 60.0, 5.0, 3000.0
#: Cells of pairs that are compared at once in numpy.
AT_ONCE = 1 << 22
#: Components of a vector that are projected at once.
PIECE = 4096


class Plan(NamedTuple):
    width: int
    tables: int
    count: int
    cell: float
    window: float


def together(interval: float, spread: float) -> float:
    """The chance that two values whose difference is normal with spread fall in one randomly placed interval."""
    x = np.linspace(0, interval, 2001)
    density = 2 / (spread * math.sqrt(2 * math.pi)) * np.exp(-((x / spread) ** 2) / 2)
    return float(np.trapezoid((1 - x / interval) * density, x))


def inside(window: float, spread: float) -> float:
    """The chance that a normal value of that spread is within the window."""
    return math.erf(window / spread / math.sqrt(2))


def fewer(tables: int, chance: float, count: int) -> float:
    """The chance of fewer than count collisions."""
    return sum(math.comb(tables, k) * chance**k * (1 - chance) ** (tables - k) for k in range(count))


def plan(n: int, threshold: float = 0.9, recall: float = RECALL) -> Plan:
    """The plan of least work for n vectors."""
    near, far = max(1e-3, math.sqrt(max(0.0, 2 - 2 * threshold))), math.sqrt(2)
    found = []
    for cell in (4 * near, 6 * near, 9 * near, 13 * near):
        one, other = together(cell, near), together(cell, far)
        for window in (near, 2 * near):
            for count in (2, 3, 4):
                for width in range(60):
                    hit, miss = one**width * inside(window, near), other**width * inside(window, far)
                    low, high = count, 2 * count
                    while fewer(high, hit, count) > 1 - recall and high < 1 << 13:
                        low, high = high, 2 * high
                    while low < high:
                        mid = (low + high) // 2
                        low, high = (low, mid) if fewer(mid, hit, count) <= 1 - recall else (mid + 1, high)
                    if low < 1 << 13:
                        work = n * miss * low * MEETING + low * (TABLE + (256 + 8 * low) * BYTE)
                        found.append((work, Plan(width, low, count, cell, window)))
    return min(found)[1]


@functools.lru_cache(4)
def _directions(dims: int, start: int, number: int, seed: int) -> np.ndarray:
    r = np.random.Generator(np.random.PCG64([seed, dims, start]))
    return r.normal(size=(min(PIECE, dims - start), number)).astype(np.float32)


def project(x: np.ndarray, p: Plan, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells (hashed to 32 bits) and sorted projections of vectors of length 1, in every table."""
    dims, number = x.shape[1], p.tables * (p.width + 1)
    out = np.zeros((len(x), number), np.float32)
    for start in range(0, dims, PIECE):
        out += x[:, start : start + PIECE].astype(np.float32) @ _directions(dims, start, number, seed)
    out = out.reshape(len(x), p.tables, p.width + 1)
    r = np.random.Generator(np.random.PCG64([seed, 1]))
    offset = r.uniform(0, p.cell, (p.tables, p.width)).astype(np.float32)
    mixers = r.integers(1, 1 << 62, (p.tables, p.width)) | 1
    key = (np.floor((out[:, :, 1:] + offset) / np.float32(p.cell)).astype(np.int64) * mixers).sum(2)
    key = (key ^ (key >> 29)) * 0x5851F42D4C957F2D
    return (key >> 32).astype(np.int32), np.ascontiguousarray(out[:, :, 0])


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def units(df: DataFrame, vector: str) -> DataFrame:
    """df (vec_id and the vector) with x, the vector as doubles of length 1, or null if it can't link.

    Scaled by its largest component first, so that squares neither overflow nor vanish. The
    length stands beside every component as an array, as within a lambda it would be worked
    out anew for each.
    """
    x = F.col(vector).cast("array<double>")
    fine = (F.size(x) > 0) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    one = df.withColumn("__x", F.when(fine, x)).withColumn("__top", F.greatest(F.array_max("__x"), -F.array_min("__x")))
    two = one.withColumn("__y", F.when(F.col("__top") > 0, F.zip_with("__x", F.array_repeat("__top", F.size("__x")), lambda v, t: v / t)))
    three = two.withColumn("__length", F.sqrt(F.aggregate("__y", F.lit(0.0), lambda a, v: a + v * v)))
    return three.withColumn("x", F.zip_with("__y", F.array_repeat("__length", F.size("__y")), lambda v, n: v / n + F.lit(0.0))).drop("__x", "__top", "__y", "__length")


def _flat(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False)


def _lists(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    ends = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(x.reshape(-1), kind))


def _projected(p: Plan, seed: int):
    """Rows of vectors with their cells and sorted projections in every table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for d in np.unique(dims):
                of = batch.filter(pa.array(dims == d))
                x = unit_rows(_flat(of.column(3)).astype(np.float64).reshape(-1, d))
                cells, values = project(x, p, seed)
                yield pa.RecordBatch.from_arrays([*of.columns, _lists(cells, pa.int32()), _lists(values, pa.float32())], names=["c", "d", "weight", "x", "cells", "at"])

    return run


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n numbers the smallest that links a-b connect it with."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _windows(group: np.ndarray, v: np.ndarray, window: float, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs i < j of rows, sorted by group and v, of one group and with v within the window of each other."""
    place = group * 4096.0 + v
    stop = np.searchsorted(place, place + (window + 1e-3), "right")
    n = stop - np.arange(len(v)) - 1
    total = np.cumsum(n)
    first = 0
    while first < len(v):
        last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + most, "right")))
        m = n[first:last]
        i = np.repeat(np.arange(first, last), m)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(m) - m, m)
        keep = (group[i] == group[j]) & (np.abs(v[j] - v[i]) <= np.float32(window))
        yield i[keep], j[keep]
        first = last


KEYS = ["d", "t", "cell", "strip", "i", "j"]


def _counted(p: Plan, threshold: float):
    """For each vector of a tile pair with links found here: the weight it links with, and its root."""

    def links(table: pa.Table, group: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
        x = unit_rows(_flat(table.column("x")).astype(np.float64).reshape(-1, d))
        cells, at = _flat(table.column("cells")).reshape(-1, p.tables), _flat(table.column("at")).reshape(-1, p.tables)
        t, tile, home = (table.column(k).to_numpy() for k in ("t", "tile", "home"))
        apart = table.column("i").to_numpy() != table.column("j").to_numpy()
        v = at[np.arange(len(t)), t]
        found = []
        for i, j in _windows(group, v, p.window, AT_ONCE // p.tables):
            keep = (home[i] | home[j]) & (~apart[i] | (tile[i] != tile[j]))
            i, j = i[keep], j[keep]
            before = np.arange(p.tables) < t[i][:, None]
            hits = (cells[i] == cells[j]) & (np.abs(at[i] - at[j]) <= np.float32(p.window)) & before
            reached = hits.sum(1) == p.count - 1
            i, j = i[reached], j[reached]
            close = np.einsum("ij,ij->i", x[i], x[j]) >= threshold
            found.append((i[close], j[close]))
        return tuple(np.concatenate(f) for f in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in runs_of_keys(batches, KEYS):
            group = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            dims = table.column("d").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(dims)) + 1), len(dims)]
            for s, e in zip(cuts, cuts[1:]):
                part = table.slice(s, e - s)
                a, b = links(part, group[s:e] - group[s], int(dims[s]))
                if len(a) == 0:
                    continue
                c, weight = part.column("c").to_numpy(), part.column("weight").to_numpy()
                ids, of = np.unique(c, return_inverse=True)  # sorted, so the smallest root is the smallest id
                a, b = of[a], of[b]
                w = np.zeros(len(ids), np.int64)
                w[of] = weight
                n = np.zeros(len(ids), np.int64)
                np.add.at(n, a, w[b])
                np.add.at(n, b, w[a])
                root, used = _roots(a, b, len(ids)), n > 0
                yield pa.RecordBatch.from_arrays([pa.array(ids[used]), pa.array(n[used]), pa.array(ids[root[used]])], names=["c", "others", "root"])

    return run


def link(df: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", threshold: float = 0.9, seed: int = 17) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector."""
    scratch = Scratch(df.sparkSession, "embeddings")
    named = df.where(F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("v"))
    rows = scratch.write(units(named, "v").withColumn("k", F.struct(F.xxhash64("x").alias("k1"), F.xxhash64(F.lit(1), F.col("x")).alias("k2"))), "unit")
    fine = rows.where("x is not null").select("vec_id", "v", F.size("x").alias("d"), "k")
    classes = fine.groupBy("d", "k").agg(F.countDistinct("vec_id").alias("weight"), F.min_by("v", "vec_id").alias("x"))
    classes = scratch.write(classes.withColumn("c", F.monotonically_increasing_id()), "classes")  # written, so numbers stay
    member = scratch.write(fine.select("vec_id", "d", "k").distinct().join(classes.select("d", "k", "c", "weight"), ["d", "k"]).select("vec_id", "c", "weight"), "members")
    p = plan(max(classes.count(), 2), threshold)
    vectors = classes.select("c", "d", "weight", "x")
    kind = dict(vectors.dtypes)["x"]
    vectors = scratch.write(vectors.mapInArrow(_projected(p, seed), f"c long, d int, weight long, x {kind}, cells array<int>, at array<float>"), "vectors")

    # strips of a table: a vector is at home in its own and seen from the next one
    spots = vectors.select("c", "d", F.posexplode(F.arrays_zip("cells", "at")).alias("t", "z")).select("c", "d", "t", F.col("z.cells").alias("cell"), F.floor(F.col("z.at") / F.lit(p.window * 1.001)).cast("int").alias("strip"))
    placed = spots.select("c", "d", "t", "cell", F.explode(F.array(F.struct("strip", F.lit(True).alias("home")), F.struct((F.col("strip") + 1).alias("strip"), F.lit(False).alias("home")))).alias("s")).select("c", "d", "t", "cell", "s.*")
    strip = ["d", "t", "cell", "strip"]
    filled = placed.groupBy(*strip).agg(F.count("*").alias("m"), F.max("home").alias("any")).where("any and m > 1").select(*strip, F.ceil(F.col("m") / TILE).cast("int").alias("tiles"))
    tiled = placed.join(filled, strip).withColumn("tile", F.pmod(F.xxhash64("c", "t"), F.col("tiles")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda k: F.struct(F.least("tile", k).alias("i"), F.greatest("tile", k).alias("j")))
    spread = scratch.write(tiled.select("c", *strip, "home", "tile", F.explode(others).alias("s")).select("c", *strip, "home", "tile", "s.*"), "spread")
    dealt = spread.join(vectors.drop("d"), "c").withColumn("v", F.get("at", F.col("t")))
    order = ["d", "t", "cell", "strip", "i", "j"]
    found = scratch.write(dealt.repartition(*order).sortWithinPartitions(*order, "v").mapInArrow(_counted(p, threshold), "c long, others long, root long"), "found")

    # a component is known by its smallest class, then by its smallest vec_id
    several = member.groupBy("vec_id").agg(F.min("c").alias("b"), F.max("c").alias("z")).where("b <> z").select("vec_id", "b")
    same = member.join(several, "vec_id").select(F.col("c").alias("a"), "b")
    of = components(found.select(F.col("c").alias("a"), F.col("root").alias("b")).unionByName(same).where("a <> b"), scratch)
    of = scratch.write(of, "components").withColumnRenamed("id", "c")
    degree = found.groupBy("c").agg(F.sum("others").alias("others"))
    each = scratch.write(member.join(degree, "c", "left").join(of, "c", "left").withColumn("component", F.coalesce("component", "c")), "each")
    least = each.groupBy("component").agg(F.min("vec_id").alias("least"))
    linked = each.join(least, "component").groupBy("vec_id").agg(F.max(F.col("weight") - 1 + F.coalesce("others", F.lit(0))).cast("long").alias("n_links"), F.min("least").alias("component_id"))
    out = rows.select("vec_id").distinct().join(linked, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def sql(threshold: float = 0.9) -> str:
    """link() of a table embeddings with distinct vec_ids, in DuckDB SQL, by all pairs."""
    return f"""
    with recursive v as (select vec_id, embedding::double[] as e from embeddings where vec_id is not null),
    fine as (select * from v where len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
    links as (select a.vec_id as a, b.vec_id as b from fine a join fine b on a.vec_id < b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= {threshold}),
    {REACHED}
    select vec_id, coalesce(c, 0)::bigint as n_links, least(vec_id, coalesce(m, vec_id)) as component_id, vec_id = least(vec_id, coalesce(m, vec_id)) as kept
    from v left join least_ on least_.a = vec_id left join (select a, count(*) as c from both_ group by a) d on d.a = vec_id
    """
