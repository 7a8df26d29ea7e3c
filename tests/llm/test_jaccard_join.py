import random

import numpy as np
import pyarrow as pa

from ledgerline.llm import jaccard_join, shingles
from ledgerline.llm.components import components
from ledgerline.llm.common import Scratch

from .texts import Union, corpus, prose, words


def shingle_set(text):
    w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in words(text)]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    groups = Union(sets)
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                groups.join(a, b)
    return {i: (len(sets[i]), groups.find(i)) for i in ids}


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.join(df).collect()}
    assert got == brute(rows)


def test_against_all_pairs(spark):
    check(spark, [(i, t) for i, t, _, _ in corpus()])


def test_chain_of_near_copies_and_a_frequent_passage(spark):
    draw = random.Random(3)
    hub, passage, rows = prose(draw, 120, 9000), prose(draw, 60, 9000), []
    for i in range(60):
        w = list(hub)
        for _ in range(draw.randint(0, 6)):
            w[draw.randrange(len(w))] = f"x{draw.randrange(10**6)}"
        rows.append((1000 - i, " ".join(w)))
        rows.append((2000 + i, " ".join(passage + prose(draw, draw.randint(5, 80), 9000))))
    check(spark, rows)


def test_repeated_ids_with_other_texts(spark):
    draw = random.Random(9)
    rows = [(draw.randrange(30), " ".join(prose(draw, draw.randint(0, 12), 3))) for _ in range(90)]
    rows += [(3, None), (3, ""), rows[0], rows[0], (5, "a b c d e f g"), (5, "a b c d e x y")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    hashed = df.distinct().selectExpr("doc_id", "text", "xxhash64(coalesce(text, '')) as hash").collect()
    chosen = {}
    for r in sorted(hashed, key=lambda r: -r["hash"]):
        chosen[r["doc_id"]] = r["text"]
    out = jaccard_join.join(df).collect()
    assert len(out) == len(chosen) and {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == brute(list(chosen.items()))


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b", "x", 2.0)], "doc_id long, text string, token string, g double")
    assert jaccard_join.join(df).count() == 1 and jaccard_join.join(df.limit(0)).count() == 0
    assert jaccard_join.join(spark.createDataFrame([(None, "a"), (3, "a"), (3, "a")], "doc_id long, text string")).count() == 1


def test_word_hashes_are_of_whole_words():
    texts = pa.array(["The cat\tsat", None, "", " the  CAT", "a" * (shingles.PIECE + 5), "é" * 3])
    rows = {}
    for first, h, bounds in shingles.texts(texts):
        for i, (a, b) in enumerate(zip(bounds, bounds[1:]), first):
            rows[i] = h[a:b].tolist()
    assert [len(rows[i]) for i in range(6)] == [3, 0, 0, 2, 1, 1] and rows[0][:2] == rows[3]
    assert len({*rows[0], *rows[4], *rows[5]}) == 5


def test_gaps_come_back():
    draw = np.random.Generator(np.random.PCG64(2))
    for low in range(6):
        for n in (0, 1, 400):
            x = np.unique(draw.integers(0, 1 << draw.integers(8, 50), n))
            if len(x) == 0 or x[-1] >> (8 * low) < 10**7:  # 255 carries on in one byte each
                assert (jaccard_join._places(*jaccard_join._gaps(x, low), low) == x).all()


def test_layout_grows_with_the_texts():
    small, large = jaccard_join.layout(10**8), jaccard_join.layout(10**14)
    for size, form in ((10**8, small), (10**14, large)):
        assert size / 6 / 2**form.range <= 2 * jaccard_join.RANGE_TOKENS and 2**form.key >= 16 * size / 6 and (1 << form.key) / jaccard_join.BLOCK_TOKENS / 256**form.low < 128
    assert jaccard_join.layout(0).key >= 24


def test_document_frequencies(spark):
    rows = [(i, t) for i, t, _, _ in corpus(4, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    form = jaccard_join.layout(10**6)
    keys, dfs = jaccard_join.frequent_tokens(df, form, Scratch(spark, "test"))
    count = {}
    for _, words_, bounds in shingles.texts(pa.array([t for _, t in rows], pa.string())):
        for a, b in zip(bounds, bounds[1:]):
            for k in set(jaccard_join._key(shingles.shingle_set(words_[a:b]), form.key).tolist()):
                count[k] = count.get(k, 0) + 1
    assert dict(zip(keys.tolist(), dfs.tolist())) == {k: n for k, n in count.items() if n >= jaccard_join.LEAST} and len(keys)


def test_components_of_random_links(spark):
    draw = random.Random(5)
    links = [(draw.randrange(200), draw.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1030)]
    groups = Union({x for p in links for x in p})
    for a, b in links:
        groups.join(a, b)
    got = components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "test"))
    got = {r["id"]: r["component"] for r in got.collect()}
    assert got == {x: groups.find(x) for a, b in links if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "test")).count() == 0
