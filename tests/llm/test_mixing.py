import heapq

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerline.llm import mixing

DOCS = "doc_id long, source string, text string, size int"


def brute(weights, seats, limits):
    got = [0] * len(weights)
    heap = [(-w, i) for i, w in enumerate(weights) if w > 0 and limits[i] > 0]
    heapq.heapify(heap)
    while seats and heap:
        _, i = heapq.heappop(heap)
        got[i] += 1
        seats -= 1
        if got[i] < limits[i]:
            heapq.heappush(heap, (-weights[i] / (2 * got[i] + 1), i))
    return got


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 1000), st.integers(0, 40)), min_size=1, max_size=12), st.integers(0, 200))
def test_apportionment_by_highest_quotients(rows, seats):
    weights, limits = [float(w) for w, _ in rows], [n for _, n in rows]
    assert mixing.apportion(np.array(weights), seats, np.array(limits)).tolist() == brute(weights, seats, limits)


def test_targets_stop_at_three_times_the_size():
    got = mixing.targets([10, 1000, 90], [5, 2, 1])
    assert got[0] == 30 and abs(got.sum() - 1100) < 1e-9 and (got <= 3 * np.array([10, 1000, 90])).all()
    assert mixing.targets([0, 0], [5, 2]).tolist() == [0, 0]


def test_taken_words(spark):
    draw = np.random.Generator(np.random.PCG64(1))
    rows = [(i, ["b", "a", None, "c"][int(draw.integers(4))] if i % 3 else "a", " ".join(["w"] * int(draw.integers(0, 900))) or None, 7) for i in range(400)]
    rows.append(rows[5])
    df = spark.createDataFrame(rows, DOCS)
    out = mixing.mix(df).toPandas()
    assert len(out) == 401 and (out.taken <= 3 * out["size"]).all()
    by = out.assign(source=out.source.fillna("~")).groupby("source").agg(size=("size", "sum"), of=("source_size", "max"), target=("target", "max"), taken=("taken", "sum"))
    assert (by["size"] == by.of).all() and abs(by.target.sum() - by["size"].sum()) < 1e-6
    assert ((by.taken - by.target).abs() <= 3 * mixing.BLOCK_WORDS).all()
    again = mixing.mix(df.repartition(3)).toPandas()
    key = ["doc_id", "size", "taken"]
    assert sorted(map(tuple, again[key].fillna(-1).values)) == sorted(map(tuple, out[key].fillna(-1).values))


def test_blocks_are_taken_whole_and_by_quota(spark, monkeypatch):
    """Every word of a shard's block is taken equally often, quota // blocks times or once more, quota % blocks of them."""
    monkeypatch.setattr(mixing, "SHARD_WORDS", 900)
    draw = np.random.Generator(np.random.PCG64(3))
    rows = [(i, "ab"[i % 2], "w " * int(draw.integers(1, 200)), 0) for i in range(120)]
    df = spark.createDataFrame(rows, DOCS)
    sized = df.select("doc_id", "source", mixing.F.col("doc_id").alias("__id"), mixing.F.xxhash64("text").alias("__d"), mixing._size("text").alias("size"))
    of, n, wanted = mixing.quotas(sized, "source", (5, 2, 1), 3)
    dealt = mixing._dealt(sized, of, n, "source", 7)
    s = mixing.shards_of(dealt, wanted, 3)
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(df).collect()}
    where = dealt.toPandas().sort_values(["__i", "__shard", "__id", "__d"])
    seen = 0
    for j in range(len(s.words)):
        here = where[(where["__i"] == s.source[j]) & (where["__shard"] == s.shard[j])]
        words_, blocks, each, more = int(s.words[j]), int(s.blocks[j]), int(s.quota[j] // s.blocks[j]), int(s.quota[j] % s.blocks[j])
        edges = [b * words_ // blocks for b in range(blocks + 1)]
        hashed = {b: h for b, h in enumerate(spark.range(blocks).orderBy("id").selectExpr(f"xxhash64(7, cast({s.source[j]} as bigint), cast({s.shard[j]} as bigint), id) as h").toPandas().h)}
        once_more = set(sorted(hashed, key=hashed.get)[:more])
        of_word = np.concatenate([np.full(edges[b + 1] - edges[b], each + (b in once_more)) for b in range(blocks)])
        end = np.cumsum(here["size"].to_numpy())
        assert [int(of_word[e - z : e].sum()) for e, z in zip(end, here["size"])] == [taken[i] for i in here.doc_id]
        seen += len(here)
    assert seen == 120 and len(s.words) > 6


def test_whole_documents_are_within_one_of_the_target(spark, monkeypatch):
    for shard in (131_072, 3000):
        monkeypatch.setattr(mixing, "SHARD_WORDS", shard)
        draw = np.random.Generator(np.random.PCG64(2))
        rows = [(None if i % 9 == 0 else i // 2, ["a", "b", None, "c", "d"][min(4, int(draw.integers(0, 40)) // 4)], "w " * int(draw.integers(0, 300)) or None, i % 3) for i in range(900)]
        rows += [rows[4]] * 3
        df = spark.createDataFrame(rows, "doc_id long, source string, text string, size int")
        out = mixing.whole(df).toPandas()
        assert len(out) == len(rows) and out.copies.max() <= 3 and out["size"].max() == 2
        out["n"] = out.text.fillna("").str.split().map(len)
        by = out.assign(source=out.source.fillna("~")).groupby("source").apply(lambda g: (g.n.sum(), (g.n * g.copies).sum(), g.n.max()), include_groups=False).sort_index()
        want = mixing.targets([v[0] for v in by], np.resize([5, 2, 1], len(by)))
        for (size, got, most), target in zip(by, want):
            assert abs(got - target) <= most
        again = mixing.whole(df.repartition(5)).toPandas()
        assert sorted(again[["text", "copies"]].fillna("").itertuples(index=False, name=None)) == sorted(out[["text", "copies"]].fillna("").itertuples(index=False, name=None))


def test_a_very_long_text_beside_short_ones(spark):
    rows = [(1, "a", "w " * 400_000, 0)] + [(i, "ab"[i % 2], "w w w", 0) for i in range(2, 40)]
    df = spark.createDataFrame(rows, DOCS)
    out = mixing.mix(df).toPandas().set_index("doc_id")
    assert out["size"][1] == 400_000 and (out.taken <= 3 * out["size"]).all() and abs(out[out.source == "a"].taken.sum() - out[out.source == "a"].target.iloc[0]) < 2000
    assert mixing.whole(df).toPandas().set_index("doc_id").copies.max() <= 3


def test_more_sources_than_the_bound(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SOURCES", 2)
    df = spark.createDataFrame([(i, str(i), "w", 1) for i in range(3)], DOCS)
    with pytest.raises(ValueError, match="sources"):
        mixing.mix(df)


def test_empty_table(spark):
    for rows in ([], [(1, "a", None, 1), (None, None, " ", 2)]):
        df = spark.createDataFrame(rows, DOCS)
        assert mixing.mix(df).count() == mixing.whole(df).count() == len(rows)
