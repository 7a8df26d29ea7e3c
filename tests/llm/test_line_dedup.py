import random

from ledgerline.llm import line_dedup

from .texts import corpus, prose, words


def near(a, b):
    if max(len(a), len(b)) < line_dedup.MIN_WORDS or abs(len(a) - len(b)) > 1:
        return False
    s, t = sorted((a, b), key=len)
    i = next((i for i in range(len(s)) if s[i] != t[i]), len(s))
    return s[i + 1 :] == t[i + 1 :] if len(s) == len(t) else s[i:] == t[i + 1 :]


def brute(rows):
    seen, out = [], {}
    for i, text in sorted((r for r in rows), key=lambda r: r[0]):
        kept, gone = [], 0
        for line in (text or "").split("\n"):
            w = words(line)
            if w and any(w == o or near(w, o) for o in seen):
                gone += 1
            else:
                kept.append(line)
            if w:
                seen.append(w)
        out[i] = (gone, text if gone == 0 else "\n".join(kept))
    return out


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_removed"], r["text"]) for r in line_dedup.dedup(df).collect()}
    assert got == brute(rows)


def test_against_all_lines(spark):
    check(spark, [(i, t) for i, t, _, _ in corpus(2, 60)])


def test_single_edits_of_lines(spark):
    draw = random.Random(8)
    rows = []
    for i in range(80):
        w = prose(draw, draw.randint(6, 12), 6) if i % 2 else [f"k{k}" for k in range(draw.randint(7, 9))]
        for _ in range(draw.randint(0, 2)):
            at = draw.randrange(len(w))
            w[at : at + draw.randint(0, 1)] = [f"n{draw.randrange(40)}"] * draw.randint(0, 1)
        rows.append((i, " ".join(w)))
    check(spark, rows)


def test_repeated_and_null_ids_with_other_texts(spark):
    draw = random.Random(12)
    pool = [" ".join(prose(draw, draw.randint(1, 14), 9)) for _ in range(40)]
    rows = [(draw.choice([None, 1, 2, 3, 4]), "\n".join(draw.choice(pool) for _ in range(draw.randint(1, 5)))) for _ in range(60)]
    rows += [(2, "same line\nbeta"), (2, "only here stands this line of eight words\ngamma"), (1, "same line"), rows[0], rows[1], (3, None), (None, "same line")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    hashed = df.distinct().selectExpr("doc_id", "text", "xxhash64(doc_id is null, coalesce(text, '')) as hash").collect()
    ordered = sorted(hashed, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["hash"]))
    want = brute([(k, r["text"]) for k, r in enumerate(ordered)])
    of = {(r["doc_id"], r["text"]): want[k] for k, r in enumerate(ordered)}
    got = sorted(map(repr, ((r["doc_id"], r["n_removed"], r["text"]) for r in line_dedup.dedup(df).collect())))
    assert got == sorted(repr((i, *of[i, t])) for i, t in rows)


def test_long_line_and_clashing_columns(spark):
    w = [f"v{k}" for k in range(30_000)]
    rows = [(1, " ".join(w), 1, "a", True), (2, " ".join([*w[:500], "x", *w[501:]]), 2, "b", None), (3, " ".join(w[1:-1]), 3, "c", False)]
    df = spark.createDataFrame(rows, "doc_id long, text string, line_no int, doc string, emptied boolean")
    got = {r["doc_id"]: r for r in line_dedup.dedup(df).collect()}
    assert [got[i]["emptied"] for i in (1, 2, 3)] == [False, True, False] and got[2]["doc"] == "b" and got[3]["line_no"] == 3


def test_defined_results(spark):
    rows = [(1, "same line\n\nother", 5), (2, "same  line", 6), (3, None, None), (None, "same line", 1), (4, "", 2)]
    out = {r["doc_id"]: r for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string, n_lines long")).collect()}
    assert out[None]["emptied"] and out[None]["n_removed"] == 1
    assert out[2]["emptied"] and out[2]["n_removed"] == 1 and not out[3]["emptied"] and out[3]["text"] is None and out[4]["text"] == ""
    assert line_dedup.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
