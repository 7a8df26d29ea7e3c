"""Connected components of links by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


#: What reaches what over links (a, b), and the smallest of it: in DuckDB SQL, for tests.
REACHED = """both_ as (select a, b from links union select b, a from links),
    reach(a, b) as (select a, b from both_ union select r.a, e.b from reach r join both_ e on r.b = e.a),
    least_ as (select a, min(b) as m from reach group by a)"""


def components(links: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(id, component): for every end of the links (a, b) the smallest id that links reach.

    Every step is a grouped minimum and a join on the node, written to the shared
    folder; a node of many links is only ever a partial minimum and a skewed join, never
    a gathered group. Steps end when a pass changes nothing.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    edges = scratch.write(edges, f"{name}-0")
    before, step = None, 0
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = scratch.write(large, f"{name}-{step}-large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        scratch.drop(f"{name}-{step}")
        step += 1
        edges = scratch.write(small, f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}-large")
        # every node's neighbours are known by counts and a sum of hashes that doesn't depend on order
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before or now[0] == 0:
            break
        before = now
    stars = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
