import random
from collections import Counter

import numpy as np

from ledgerline.llm import quality_rules as q

from .texts import corpus, prose, words

DOCS = "doc_id long, text string, lang string, source string"


def test_base_counts(spark):
    rows = corpus(3) + [(9000, "a b c a b c\na b c\n\n#x <y>", "en", "s0"), (9001, "z " * 400, "en", None)]
    got = {r["doc_id"]: r for r in q.statistics(spark.createDataFrame(rows, DOCS)).collect()}
    for i, text, *_ in rows:
        w, c, hit = words(text), Counter(), set()
        c.update(zip(w, w[1:], w[2:]))
        for k in range(len(w) - 2):
            if c[tuple(w[k : k + 3])] > 1:
                hit |= {k, k + 1, k + 2}
        lines = [x for x in (text or "").split("\n") if words(x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(x in q.SYMBOLS for x in text or ""), len(lines) - len(set(lines)), len(hit)), i
        assert r["base_failed"] == (len(w) < 50 or 100 * len(hit) > 50 * len(w))


def brute_distances(groups):
    """Concentration steps as the operator states them, on a matrix for each group."""
    middle = lambda v: (np.sort(np.floor(v * q.FINE), axis=0)[(len(v) - 1) // 2] + 0.5) / q.FINE
    floor = np.diag(np.array(q.FLOORS) ** 2)
    places = [middle(x) for x in groups]
    covs = [np.diag((middle(np.abs(x - m)) * 1.4826) ** 2) + floor for x, m in zip(groups, places)]
    bins = lambda d: np.floor(np.log(d + 1e-9) * q.BINS)
    distances = lambda: [np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m) for x, m, c in zip(groups, places, covs)]
    for _ in range(q.STEPS):
        inside = [x[bins(d) <= np.sort(bins(d))[int(np.ceil(len(d) * q.KEEP)) - 1]] for x, d in zip(groups, distances())]
        places = [x.mean(0) for x in inside]
        spread = [len(x) * np.cov(x.T, bias=True) for x in inside]
        shared = sum(spread) / sum(map(len, inside))
        covs = [(v + q.SHARED * shared) / (len(x) + q.SHARED) + floor for v, x in zip(spread, inside)]
    out = []
    for d in distances():
        half = np.sort(bins(d))[int(np.ceil(len(d) * 0.5)) - 1]
        out.append(d / max(np.exp((half + 1) / q.BINS) / q.HALF, 1.0))
    return out


def test_distances_and_verdicts(spark):
    draw = random.Random(6)
    rows = [(i, " ".join(prose(draw, draw.randint(60, 300), 3000)), "en", "s") for i in range(300)]
    rows += [(1000 + i, " ".join(x.upper() + "!!" for x in prose(draw, 120, 3000)) + " # | $" * 30, "en", "s") for i in range(6)]
    rows += [(2000 + i, " ".join(prose(draw, 90, 3000)), None, "rare") for i in range(5)]
    df = spark.createDataFrame(rows, DOCS)
    got = {r["doc_id"]: r for r in q.judge(df).collect()}
    assert len(got) == len(rows) and all(got[i]["kept"] for i in range(300)) and not any(got[1000 + i]["kept"] for i in range(6))
    assert all(got[2000 + i]["kept"] for i in range(5))
    table = q.statistics(df).where("not base_failed").select("doc_id", "source", *(c.alias(n) for n, c in zip(q.X, q.vector()))).toPandas()
    parts = [table[table.source == s] for s in ("s", "rare")]
    for part, want in zip(parts, brute_distances([p[q.X].to_numpy() for p in parts])):
        assert np.allclose([got[i]["distance2"] for i in part.doc_id], want, rtol=1e-6)


def test_small_groups_are_judged_like_large_ones(spark):
    """Junk in a group of any size goes, beside groups of the same style; a document alone in its group stays."""
    draw = random.Random(16)
    rows = [(i, " ".join(prose(draw, draw.randint(60, 300), 3000)), "en", f"s{i % 3}") for i in range(600)]
    for k, size in enumerate((4, 12, 40, 99)):
        rows += [(1000 * (k + 1) + i, " ".join(prose(draw, draw.randint(60, 300), 3000)), "en", f"small{k}") for i in range(size)]
        rows.append((9000 + k, " ".join(x.upper() + "!!" for x in prose(draw, 120, 3000)) + " # | $" * 30, "en", f"small{k}"))
    rows.append((9100, rows[-1][1], "de", "alone"))
    got = {r["doc_id"]: r["kept"] for r in q.judge(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(kept == (i < 9000 or i == 9100) for i, kept in got.items())


def test_ties_long_texts_and_clashing_columns(spark):
    draw = random.Random(17)
    same = " ".join(prose(draw, 100, 3000))
    rows = [(i, same, "en", "s", 1.0, "x", 2) for i in range(40)] + [(50, " ".join(prose(draw, 200_000, 3000)), "en", "s", None, None, None)]
    df = spark.createDataFrame(rows, DOCS + ", distance2 double, kept string, n_words int")
    out = q.judge(df).toPandas().set_index("doc_id")
    assert out.distance2[list(range(40))].nunique() == 1 and out.kept[list(range(40))].all() and out.n_words[50] == 200_000 and list(out.columns).count("kept") == 1


def test_a_third_of_a_group_is_junk(spark):
    """Copies of one junk text, or varied junk, over a quarter of a group don't become the estimate."""
    draw = random.Random(8)
    junk = lambda: " ".join(x.upper() + "!!" for x in prose(draw, draw.randint(100, 160), 3000)) + " # | $" * 30
    one = junk()
    rows = [(i, " ".join(prose(draw, draw.randint(60, 300), 3000)), "en", s) for s, first in (("copies", 0), ("varied", 1000)) for i in range(first, first + 200)]
    rows += [(5000 + i, one, "en", "copies") for i in range(100)] + [(6000 + i, junk(), "en", "varied") for i in range(100)]
    got = {r["doc_id"]: r["kept"] for r in q.judge(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(kept == (i < 5000) for i, kept in got.items())


def test_defined_results(spark):
    rows = [(1, None, None, None), (1, None, None, None), (None, "a", "en", "s")]
    out = q.judge(spark.createDataFrame(rows, DOCS)).collect()
    assert len(out) == 3 and not any(r["kept"] for r in out)
    assert q.judge(spark.createDataFrame([], DOCS)).count() == 0
