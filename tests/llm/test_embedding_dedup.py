import numpy as np

from ledgerline.llm import embedding_dedup as e

from .texts import Union


def vectors(seed=1):
    r = np.random.Generator(np.random.PCG64(seed))
    x = r.normal(size=(400, 16))
    near = x[:60] + 0.35 * r.normal(size=(60, 16))
    copies = np.repeat(x[100:101], 5, 0) * np.array([[1], [2], [0.5], [4], [1]])
    return np.concatenate([x, near, copies]).astype(np.float32)


def test_against_all_pairs(spark):
    x = vectors()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r for r in e.link(df).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    links = u @ u.T >= 0.9
    groups = Union(range(len(x)))
    for i, j in zip(*np.nonzero(np.triu(links, 1))):
        groups.join(int(i), int(j))
    want = links.sum(1) - 1
    have = np.array([got[i]["n_links"] for i in range(len(x))])
    assert (have <= want).all() and have.sum() >= 0.9 * want.sum()  # the measured recall
    agree = np.mean([got[i]["component_id"] == groups.find(i) for i in range(len(x))])
    assert agree > 0.95 and all(got[i]["kept"] == (got[i]["component_id"] == i) for i in got)


def test_a_large_cell_is_cut_into_tiles(spark):
    r = np.random.Generator(np.random.PCG64(2))
    x = np.ones((600, 8)) + 0.05 * r.normal(size=(600, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    out = e.link(df).toPandas()
    assert out.n_links.min() >= 0.97 * 599 and (out.component_id == 0).all()


def test_all_lengths_and_repeated_ids(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (2, [2.0, 0.1, 0.0]), (3, [1.0, 0.0]), (4, [1.0, 0.1]), (5, [0.0, 1.0]), (6, [0.0, 1.0, 0.0]), (6, [0.0, 3.0]), (7, [0.0, 1.0, 0.1]), (6, [0.0, 1.0, 0.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, c string, d int")
    out = {r["vec_id"]: r for r in e.link(df).collect()}
    assert {i: out[i]["component_id"] for i in out} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 5, 7: 5} and [out[i]["n_links"] for i in range(1, 8)] == [1] * 7


def test_windows_give_every_pair_once():
    r = np.random.Generator(np.random.PCG64(4))
    group = np.sort(r.integers(0, 5, 300))
    v = r.normal(size=300).astype(np.float32)
    v = np.concatenate([np.sort(v[group == g]) for g in range(5)])
    got = [p for i, j in e._windows(group, v, 0.5, 100) for p in zip(i.tolist(), j.tolist())]
    want = [(i, j) for i in range(300) for j in range(i + 1, 300) if group[i] == group[j] and abs(v[i] - v[j]) <= np.float32(0.5)]
    assert sorted(got) == want


def test_recall_of_pairs_at_the_threshold(spark):
    """Pairs of cosine 0.9 to 0.905 among unrelated vectors, in a plan of many cells."""
    r = np.random.Generator(np.random.PCG64(6))
    x = r.normal(size=(2000, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    other = r.normal(size=x.shape)
    other -= (other * x).sum(1, keepdims=True) * x
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    cosine = r.uniform(0.9005, 0.905, (2000, 1))
    y = cosine * x + np.sqrt(1 - cosine**2) * other
    p = e.plan(51_282)
    (ka, va), (kb, vb) = e.project(x, p, 17), e.project(y, p, 17)
    assert p.width > 2 and ((((ka == kb) & (np.abs(va - vb) <= p.window)).sum(1) >= p.count).mean()) >= 0.97
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.concatenate([x, y]))], "vec_id long, embedding array<double>")
    out = {r["vec_id"]: r["component_id"] for r in e.link(df).collect()}
    assert np.mean([out[2000 + i] == i for i in range(2000)]) >= 0.97


def test_defined_results(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (9, [1.0, 0.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0])]
    out = {r["vec_id"]: r for r in e.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert len(out) == 9 and out[1]["n_links"] == out[2]["n_links"] == 1 and out[2]["component_id"] == 1 and not out[2]["kept"]
    assert all(out[i]["n_links"] == 0 and out[i]["kept"] for i in range(3, 10))
    assert e.link(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_plan_reaches_its_recall():
    for n in (2, 100, 10**4, 10**6, 10**9):
        p = e.plan(n, 0.9)
        hit = e.together(p.cell, 0.2**0.5) ** p.width * e.inside(p.window, 0.2**0.5)
        assert e.fewer(p.tables, hit, p.count) <= 1 - e.RECALL and p.count > 1
    assert e.plan(100, 1.0).tables < 10
