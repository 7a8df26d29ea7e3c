"""Licence scan, language ID, substring dedup, quality classifier, the registry and the pipeline."""

import random
import re
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from ledgerline.llm import language_id, license_scan, mixing, quality_cnn, registry, substring_dedup

from .test_jaccard_join import brute as jaccard_brute
from .test_line_dedup import brute as line_brute
from .texts import corpus, prose, words

DATA = "/root/testdata/sf0.001"


# licences


def test_licences(spark):
    mit = "Copyright (c) 2019 Some Body\nAll rights reserved.\n\n" + license_scan.MIT.replace("sublicense", "sub-license").replace("COPYRIGHT HOLDERS", "copyright\nowners".upper())
    rows = [(1, mit), (2, "prose\nReleased under the MIT Licence!\nmore\nreleased under the MIT license"), (3, None), (4, "..."), (5, "Licensed under CC BY-NC 4.0. But not alone"), (None, "Licensed under CC BY-NC 4.0"), (2, "Licensed under CC BY 4.0.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in license_scan.scan(df).collect()}
    assert got == {1: ("MIT", 0, ""), 2: ("CC-BY-4.0", 3, "CC-BY-4.0,MIT"), 3: (None, 0, ""), 4: (None, 0, ""), 5: (None, 0, ""), None: ("CC-BY-NC-4.0", 1, "CC-BY-NC-4.0")}
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    assert {r[0]: tuple(r[1:]) for r in con.execute(license_scan.sql()).fetchall()} == got
    assert license_scan.scan(df.limit(0)).count() == 0


def test_whole_licences_in_other_dress(spark):
    """Whole texts as systems carry them, wrapped, cased, quoted and headed otherwise, are known; changed by a word they aren't."""
    folder, names = Path("/usr/share/common-licenses"), {"Apache-2.0": "Apache-2.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "GFDL-1.3": "GFDL-1.3"}
    texts = [(want, (folder / file).read_text(encoding="utf-8")) for file, want in names.items() if (folder / file).exists()]
    texts += [x for x in license_scan.TEXTS]
    rows = []
    for k, (_, text) in enumerate(texts):
        rows += [(4 * k, text), (4 * k + 1, "Copyright (c) 2031 Some Body\n\n" + text.upper().replace('"', "\u201c")), (4 * k + 2, re.sub(r"[ \t]+", "  ", text).replace("license", "licence").replace(",", " ;")), (4 * k + 3, text + " moreover")]
    got = {r["doc_id"]: r["license"] for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, (want, text) in enumerate(texts):
        assert [got[4 * k + i] for i in range(4)] == [want, want, want, None], (want, text[:60])


def test_notices_and_identifiers(spark):
    rows = ["Licensed under the BSD 3-Clause License", "released under GPL v2 or later.", "This project is licensed under the GNU Lesser General Public License, version 2.1.", "// SPDX-License-Identifier: LGPL-2.1+", "# SPDX-License-Identifier: Apache-2.0", "Distributed under the Mozilla Public Licence, version 2.0!", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "licensed under a licence of our own"]
    got = license_scan.scan(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["notices"] for r in got] == ["BSD-3-Clause", "GPL-2.0-or-later", "LGPL-2.1", "LGPL-2.1", "Apache-2.0", "MPL-2.0", "CC-BY-SA-4.0", ""]


def test_known_texts_as_a_table(spark):
    """Digests made by Spark are those made by Python; a table's ties go to the first name."""
    known = [*license_scan.TEXTS, ("Own", "Do what\nyou like, or not."), ("Another", "do what you like or NOT")]
    table = spark.createDataFrame(known, "name string, text string")
    python = license_scan.digests(known)
    native = {r["digest"]: r["name"] for r in license_scan.lookup(spark, table).collect()}
    assert set(native) == set(python) and native[license_scan.digest("do what you like or not")] == "Another"
    df = spark.createDataFrame([(1, "Do WHAT you like\nor not", "x", 1), (1, None, "y", 2), (2, "a " * 400_000, "", 3)], "doc_id long, text string, license string, n_notices int")
    assert [tuple(r) for r in license_scan.scan(df, known=table).orderBy("doc_id").collect()] == [(1, "Another", 0, ""), (2, None, 0, "")]


# languages


def test_language_evidence(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    text = {r["lang"]: r["text"] for r in docs.where("n_chars > 800" if "n_chars" in docs.columns else "length(text) > 800").collect()}
    page = lambda lang, body: f"<html lang='{lang}'><body><script>the and of</script><p>{body}</p></body></html>"
    rows = [(i, f"https://www.h{i % 3}.example.{'de' if i % 2 else 'com'}/x", page(x, text[x])) for i, x in enumerate(["en", "de", "fr", "es"] * 5)]
    rows += [(100, "https://only.example.fr/", page("fr", "")), (101, None, None), (102, "", ""), (103, "https://www.h1.example.com/", page("xx", text["en"])), (103, "https://www.h1.example.com/", page("xx", text["en"]))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = language_id.identify(df, docs).collect()
    got = {r["page_id"]: r for r in out}
    assert len(out) == 25 and all(got[i]["language"] == x for i, x in enumerate(["en", "de", "fr", "es"] * 5))
    assert got[100]["language"] == "fr" and got[103]["language"] == "en" and got[101]["language"] is not None
    assert all(0 < r["probability"] <= 1 for r in out)
    assert language_id.identify(df.limit(0), docs).count() == 0
    assert {r["language"] for r in language_id.identify(df, docs.limit(0)).collect()} == {None}


def test_every_language_is_learned(spark):
    rows = [(i, f"some words of language {i} here " + " long" * (5000 if i == 7 else 0), f"l{i:03}") for i in range(203)]
    docs = spark.createDataFrame(rows * 2 + [(900, "short", "zz"), (901, None, "zz"), (902, "of no language at all", None)], "doc_id long, text string, lang string")
    langs, logs = language_id.fit(docs)
    assert langs == [f"l{i:03}" for i in range(203)] and logs.shape == (203, language_id.BUCKETS)
    for i in (7, 50):
        counts = np.bincount(language_id.trigrams(rows[i][1].encode()), minlength=language_id.BUCKETS) + 0.2
        assert np.allclose(logs[i], np.log(counts / counts.sum()), atol=1e-5)


def test_more_languages_than_the_bound(spark, monkeypatch):
    monkeypatch.setattr(language_id, "LANGUAGES", 2)
    with pytest.raises(ValueError, match="languages"):
        language_id.fit(spark.createDataFrame([(i, "some text of twenty bytes", f"l{i}") for i in range(3)], "doc_id long, text string, lang string"))


def test_posterior_by_brute_force(spark):
    """Every page's posterior by plain sums over all pages, with a host, a suffix and a declared language that are hot."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    langs, logs = model = language_id.fit(docs)
    pool = {r["lang"]: r["text"].split() for r in docs.where("length(text) > 400").collect()}
    draw, rows = random.Random(8), []
    for i in range(160):
        mixed = [draw.choice(pool[draw.choice(langs)]) for _ in range(draw.randint(0, 6))]  # little text, so that all evidence counts
        host = draw.choice(["www.hot.example.com", "www.hot.example.com", f"h{draw.randrange(6)}.example.de", "x.org", ""])
        rows.append((i // 2, f"https://{host}/p" if host else draw.choice([None, "no address"]), f"<html lang='{draw.choice(['', 'en', 'de', 'xx', 'EN-gb'])}'><nav>{draw.choice(pool['en'])}</nav>{' '.join(mixed)}", "kept", 1.5))
    rows.append(rows[3])
    df = spark.createDataFrame(rows, "page_id long, url string, html string, language string, c double")
    got = sorted((r["page_id"], r["url"] or "", r["c"], r["language"], r["text_language"], r["declared"], round(r["probability"], 9)) for r in language_id.identify(df, docs, model=model).collect())
    seen = []
    for i, url, html, _, c in rows:
        t = language_id.trigrams(language_id.visible(html.encode()))
        e = logs[:, t].sum(1, dtype=float) if len(t) else np.zeros(len(langs))
        e = (e - e.max()) * language_id.PART
        e = e * language_id.RANGE / max(language_id.RANGE, -e.min())
        host = url[8:].split("/")[0] if (url or "").startswith("https") else ""
        seen.append((i, url or "", c, e, np.exp(e) / np.exp(e).sum(), host, ".".join(host.split(".")[-2:]), host.split(".")[-1], html[12:].split("'")[0][:2].lower()))
    every, want = sum(x[4] for x in seen), []
    for x in seen:
        prior = every - x[4] + 1
        prior = prior / prior.sum()
        for k in (7, 6, 5):
            own = np.maximum(sum(y[4] for y in seen if y[k] == x[k]) - x[4], 0)
            prior = (own + language_id.STRENGTH * prior) / (own.sum() + language_id.STRENGTH)
        said = np.maximum(sum(y[4] for y in seen if y[8] == x[8]) - x[4], 0)
        post = x[3] + np.log(prior + 1e-12) + (np.log((said + 0.5) / (np.maximum(every - x[4], 0) + 10)) if x[8] else 0)
        want.append((x[0], x[1], x[2], langs[int(post.argmax())], langs[int(x[4].argmax())], x[8], round(float(1 / np.exp(post - post.max()).sum()), 9)))
    assert [w[:6] for w in sorted(want)] == [g[:6] for g in got] and np.allclose([w[6] for w in sorted(want)], [g[6] for g in got])
    assert sum(w[3] != w[4] for w in want) > 10  # the fusion decides, not the text alone


def test_visible_text():
    assert language_id.visible(b"<p>a<!-- b --><STYLE>c</STYLE>d&amp;e</p><nav>f</nav>") == b"a d e"


def test_markup_is_read_in_one_pass():
    import time

    v = language_id.visible
    assert v(b"a<b>c</b> <script>x<y</script >d<!-- e > f -->g<NAV x>h</nav>i&amp;j") == b"a c d g i j"
    assert v(b"a<nav>b<p>c") == b"a b c" and v(b"a<!-- b<p>c") == b"a" and v(b"a < b") == b"a < b" and v(b"") == b"" and v(b"<script>a</script") == b"<script>a</script"
    assert language_id.declared_in(b"<p><HTML class=x LANG = 'De-at'>") == "de" and language_id.declared_in(b"<html lang=en") == ""
    began = time.perf_counter()
    for unit in (b"<nav>", b"<", b"<!--", b"<html lang", b"&a", b"<nav></script>", b"</nav", b"<p "):
        v(unit * (2_000_000 // len(unit))), language_id.declared_in(unit * (2_000_000 // len(unit)))
    assert time.perf_counter() - began < 30


# substrings


def test_passages(spark):
    draw = random.Random(9)
    passage = prose(draw, 80, 9000)
    fuzzy = list(passage)
    fuzzy[20], fuzzy[50:50] = "other", ["put", "in"]
    del fuzzy[65]
    own = lambda n: prose(draw, n, 9000)
    texts = {1: own(70) + passage + own(30), 2: own(40) + passage + own(90), 3: own(25) + fuzzy + own(60), 4: own(300), 5: own(20) + passage[:30] + own(50), 6: own(3), 7: []}
    rows = [(i, " ".join(w)) for i, w in texts.items()] + [(8, None), (None, " ".join(passage)), (9, "\n".join(texts[4]))]
    got = substring_dedup.passages(spark.createDataFrame(rows, "doc_id long, text string")).toPandas().set_index("doc_id")
    assert set(got.index) == {2, 3, 9} and (got.of_doc[[2, 3]] == 1).all() and got.of_doc[9] == 4
    assert abs(got.start_word[2] - 40) <= 2 and abs(got.end_word[2] - 120) <= 2 and got.identity[2] > 0.97
    assert abs(got.start_word[3] - 25) <= 2 and abs(got.end_word[3] - 106) <= 3 and 0.85 < got.identity[3] < 1
    assert got.n_words[9] == 300
    assert substring_dedup.passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_repeats_of_a_corpus(spark):
    """Every word of an exact repeat of 50 words, by brute force, is in a passage, but for few at its ends."""
    rows = sorted((i, t) for i, t, _, _ in corpus(4))
    seen, truth = set(), {}
    for i, t in rows:
        w = words(t)
        runs = [tuple(w[k : k + 50]) for k in range(len(w) - 49)]
        hit = {z for k, g in enumerate(runs) if g in seen for z in range(k, k + 50)}
        seen.update(runs)
        if hit:
            truth[i] = hit
    out = substring_dedup.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {i: {k for r in out if r["doc_id"] == i for k in range(r["start_word"], r["end_word"])} for i in truth}
    assert all(got[i] for i in truth)
    assert sum(len(truth[i] & got[i]) for i in truth) >= 0.97 * sum(map(len, truth.values()))


def test_passages_whose_parts_earlier_documents_have(spark):
    """Every exact repeat of 50 words is found, though other documents lead the seeds of its parts."""
    draw, rows, truth = random.Random(12), [], {}
    own = lambda n: prose(draw, n, 9000)
    for k in range(0, 400, 10):
        passage = own(draw.randint(50, 62))
        cuts = [passage[:draw.randint(40, 48)], passage[-draw.randint(40, 48):]] * 2 + [passage, passage]
        rows += [(k + i, " ".join(own(20) + part + own(20))) for i, part in enumerate(cuts)]
        truth[k + 5] = len(passage)
    out = substring_dedup.passages(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    for i, n in truth.items():
        got = out[out.doc_id == i]
        assert len(got) == 1 and got.start_word.iloc[0] <= 20 and got.end_word.iloc[0] >= 20 + n


def test_passages_twice_in_a_document(spark):
    """A shared passage is reported at both of its places, one of the document alone at the second."""
    draw = random.Random(13)
    own = lambda n: prose(draw, n, 9000)
    p, q = own(80), own(70)
    near = list(q)
    near[30] = "changed"
    texts = {1: p + own(40), 2: own(30) + p + own(200) + p, 3: q + own(100) + p[:8] + own(60) + q + own(90) + near, 4: ["z"] * 300}
    rows = [(i, " ".join(w)) for i, w in texts.items()]
    out = substring_dedup.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = sorted((r["doc_id"], r["start_word"], r["end_word"], r["of_doc"]) for r in out)
    want = [(2, 30, 110, 1), (2, 310, 390, 1), (3, 238, 308, 3), (3, 398, 468, 3), (4, 50, 300, 4)]
    assert len(got) == len(want) and all(g[0] == w[0] and g[3] == w[3] and abs(g[1] - w[1]) <= 2 and abs(g[2] - w[2]) <= 2 for g, w in zip(got, want))


def test_a_passage_among_many_shares_of_its_parts(spark):
    """Eleven later copies of 240 words are found whole, though 29 earlier documents lead its parts."""
    draw = random.Random(21)
    own = lambda n: prose(draw, n, 9000)
    for part in (13, 15, 30):
        p = own(240)
        rows = [(k, " ".join(own(20) + p[8 * k : 8 * k + part] + own(20))) for k in range(29)]
        rows += [(100 + k, " ".join(own(30) + p + own(30))) for k in range(12)]
        out = substring_dedup.passages(spark.createDataFrame(rows, "doc_id long, text string")).toPandas().set_index("doc_id")
        assert set(range(101, 112)) <= set(out.index) and (out.n_words[list(range(101, 112))] >= 239).all() and (out.start_word[list(range(101, 112))] <= 31).all()


def test_recall_of_fuzzy_passages(spark):
    """Words of passages with replaced, left out and put in words that are found, pair by pair against the edits that were made."""
    draw = random.Random(22)
    own = lambda n: prose(draw, n, 20_000)
    rates, rows, truth = (0.05, 0.1, 0.15, 0.18), [], {}
    for i in range(400):
        p, rate = own(draw.randint(60, 160)), rates[i % 4]
        fuzzy, edits = [], 0
        for w in p:
            if draw.random() < rate:
                edits += 1
                fuzzy += [[], [f"n{draw.randrange(20_000)}"], [w, f"n{draw.randrange(20_000)}"]][draw.choice([0, 1, 1, 1, 1, 2])]
            else:
                fuzzy.append(w)
        head = draw.randint(10, 60)
        rows += [(2 * i, " ".join(own(30) + p + own(30))), (2 * i + 1, " ".join(own(head) + fuzzy + own(30)))]
        if edits <= 0.2 * max(len(p), len(fuzzy)):  # others are below the operator's identity
            truth[2 * i + 1] = (rate, head, head + len(fuzzy))
    found = {r["doc_id"]: (r["start_word"], r["end_word"]) for r in substring_dedup.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    recall = {r: [] for r in rates}
    for i, (rate, start, stop) in truth.items():
        s, e = found.get(i, (0, 0))
        recall[rate].append(max(0, min(e, stop) - max(s, start)) / (stop - start))
    mean = {r: float(np.mean(v)) for r, v in recall.items()}
    print(mean)
    assert not [i for i in found if i % 2 == 0]
    assert mean[0.05] > 0.97 and mean[0.1] > 0.95 and mean[0.15] > 0.9 and mean[0.18] > 0.85


def test_passages_of_repeated_ids(spark):
    """Rows of one doc_id with other texts are documents each; equal rows are one."""
    draw = random.Random(23)
    own = lambda n: prose(draw, n, 9000)
    p, q = own(120), own(120)
    rows = [(1, " ".join(p + own(9))), (2, " ".join(q)), (5, " ".join(own(10) + p)), (5, " ".join(own(20) + q)), (7, " ".join(own(80))), (7, None)]
    rows += rows[2:3] * 3 + [(None, " ".join(p))]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id long, text string, seed string, pos int")
    out = substring_dedup.passages(df).toPandas()
    assert out.doc_id.tolist() == [5, 5] and sorted(out.of_doc) == [1, 2] and out.row.nunique() == 2 and (out.n_words >= 120).all()


def test_passages_of_very_long_texts(spark):
    draw = random.Random(44)
    long_, p = prose(draw, 150_000, 50_000), prose(draw, 90, 50_000)
    rows = [(1, " ".join(long_)), (2, " ".join(long_[70_000:70_300] + p)), (3, " ".join(["x"] * 30 + long_ + p))]
    out = sorted((r["doc_id"], r["start_word"], r["end_word"], r["of_doc"]) for r in substring_dedup.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert [o[0] for o in out] == [2, 3] and out[0][3] == 1 and abs(out[0][2] - 300) <= 3 and out[1][1] in range(28, 33) and out[1][2] == 150_120


def test_seeds_leave_no_window_without():
    draw = random.Random(1)
    for k in range(600):
        h = np.array([draw.choice([1, 2, 9, 8, 7, 6]) for _ in range(draw.randint(7, 60))] if k % 3 else [3, 4][: 1 + k % 2] * 20, np.uint64)
        held = np.zeros(len(h), bool)
        held[substring_dedup.minimizers(h)] = True
        assert all(held[i : i + substring_dedup.WINDOW].any() for i in range(len(h) - substring_dedup.WINDOW + 1))


def test_a_cover_has_the_same_places():
    draw = random.Random(1)
    for _ in range(1000):
        found = [(draw.randrange(60), draw.randrange(9), draw.randint(1, 20)) for _ in range(draw.randint(0, 12))]
        few = substring_dedup.cover(found)
        places = lambda of: {k for x, _, n in of for k in range(x, x + n)}
        assert places(few) == places(found) and set(few) <= set(found)


def test_alignment_of_pieces_by_brute_force():
    draw = random.Random(5)
    for _ in range(200):
        a = np.array([draw.randrange(3) for _ in range(draw.randint(0, 9))])
        b = np.array([draw.randrange(3) for _ in range(draw.randint(0, 9))])
        row = list(range(len(b) + 1))
        for i in range(len(a)):
            last, row[0] = row[0], i + 1
            for j in range(len(b)):
                last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (a[i] != b[j]))
        assert substring_dedup._edits(a, b) == row[-1]


def test_chains_are_the_best_by_brute_force():
    draw = random.Random(2)
    for _ in range(60):
        n = draw.randint(1, 12)
        x = np.sort(np.array([draw.randrange(60) for _ in range(n)]))
        y = np.array([draw.randrange(60) for _ in range(n)])
        best = [substring_dedup.GAIN] * n
        for i in range(n):
            for j in range(n):
                if x[j] < x[i] and y[j] < y[i]:
                    best[i] = max(best[i], substring_dedup.GAIN + best[j] - substring_dedup.COST * (x[i] - x[j] + y[i] - y[j]) / 2)
        chains = substring_dedup.chains_of(x, y)
        assert sorted(k for c in chains for k in c) == list(range(n))
        first = chains[0]
        if (np.diff(x[first]) <= substring_dedup.GAP).all() and len(chains) == 1:
            value = substring_dedup.GAIN * n - substring_dedup.COST * (x[-1] - x[0] + y[first[-1]] - y[first[0]]) / 2
            assert abs(value - max(best)) < 1e-9


# quality classifier


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = quality_cnn.classify(docs.select("doc_id", "text"), labels).join(labels, "doc_id", "left").toPandas()
    assert len(out) == docs.count() and out.score.between(0, 1).all() and (out.predicted == (out.score >= 0.3)).all()
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in out.doc_id]).all()
    test = out[out.held_out & out.quality.notna()]
    good, bad = test.score[test.quality == 1].to_numpy(), test.score[test.quality == 0].to_numpy()
    assert (good[:, None] > bad[None]).mean() > 0.9


def test_learning_from_repeated_and_long_rows(spark):
    """Reruns over repeated labels and texts learn one network, and texts beyond SAMPLE_BYTES are learned from."""
    draw = random.Random(41)
    good = lambda n: " ".join(prose(draw, n, 500))
    rows = [(i, good(4000) if i % 2 else "BUY!! NOW!! $$$ " * 2000, "x", 1.0) for i in range(30)]  # all over SAMPLE_BYTES
    rows += [(i, f"other text of {i}", "y", 2.0) for i in range(5)] + rows[:4] + [(None, "z", None, None), (99, None, None, None), (98, "", None, None)]
    labels = [(i, i % 2) for i in range(30)] + [(3, 1), (5, 0), (None, 1), (400, 1), (98, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, predicted string, score double")
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    one = quality_cnn.classify(docs.repartition(3), known.repartition(2)).toPandas()
    two = quality_cnn.classify(docs.repartition(5), known.repartition(4)).toPandas()
    key = ["doc_id", "score", "predicted"]
    assert sorted(map(repr, one[key].values.tolist())) == sorted(map(repr, two[key].values.tolist())) and len(one) == len(rows)
    assert one.score.between(0, 1).all() and one[one.doc_id == 7].score.iloc[0] > one[one.doc_id == 8].score.iloc[0]
    assert not one[one.doc_id.isna()].held_out.any()


def test_scores_by_tables_are_those_of_the_network():
    net = quality_cnn.train([(b"good text of words", 1), (b"BAD!! BAD!!", 0)] * 3, 0.5, epochs=2)
    tables = net.tables()
    for text in (b"", b"x", b"BAD!! " * 500, bytes(range(256)) * 40):
        data = np.frombuffer(text, np.uint8)
        padded = quality_cnn._padded(data)
        x = net.embed[net._windows(padded)].reshape(-1, quality_cnn.WIDTH * quality_cnn.EMBED)
        z = np.maximum(x @ net.conv + net.conv_bias, 0).reshape(-1, quality_cnn.HALF, quality_cnn.FILTERS)
        s, m = z.sum(1), z.max(1)
        pooled = np.concatenate([(s[:-1] + s[1:]) / (2 * quality_cnn.HALF), np.maximum(m[:-1], m[1:])], 1)
        h = np.tanh(pooled @ net.hidden + net.hidden_bias).max(0)
        want = 1 / (1 + np.exp(-(h @ net.out + net.out_bias[0] + net.shift)))
        assert abs(net.score(data, tables) - want) < 1e-4 and abs(net.score(data, tables, piece=64) - want) < 1e-4


def test_gradients_by_differences():
    net = quality_cnn.Network(1)
    for name in net.NAMES:
        setattr(net, name, getattr(net, name).astype(np.float64))
    data = np.frombuffer(b"some Text!! of | words and more of it " * 9, np.uint8)
    _, g = net.gradients(data, 1.0, 1.0)
    for name in net.NAMES:
        p = getattr(net, name)
        at = np.unravel_index(np.argmax(np.abs(g[name])), p.shape)
        p[at] += 1e-6
        up = net.gradients(data, 1.0, 1.0)[0]
        p[at] -= 2e-6
        down = net.gradients(data, 1.0, 1.0)[0]
        p[at] += 1e-6
        assert abs((up - down) / 2e-6 - g[name][at]) < 1e-3 * max(1, abs(g[name][at])), name


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a", 9.0), (1, None, 9.0), (None, "", None)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r["score"] for r in quality_cnn.classify(docs, none).collect()] == [0.5] * 3
    one = spark.createDataFrame([(2, 1), (3, 1), (4, 1), (None, 0), (5, None)], "doc_id long, quality int")
    assert {r["score"] for r in quality_cnn.classify(docs, one).collect()} == {1.0}


# all together


def test_every_query_has_its_table_columns(spark):
    names = registry.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    for name in ("op3_mix_sources", "op4_license_scan"):
        assert names[name](spark, DATA).count() == 200


def test_pipeline_stages(spark):
    """Each stage against what it must do to its own input."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality classifier" and len(corpus_pipeline.STAGES) == 5
    frames = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        rows = stage(spark, frames[-1], DATA).toPandas()
        if k < 4:
            assert list(rows.columns) == docs.columns
            frames.append(spark.createDataFrame(rows, docs.schema))
    # line dedup, near dedup, mix and tokens against brute force on their own inputs
    lines = line_brute([(r["doc_id"], r["text"]) for r in frames[1].collect()])
    kept = {i: t for i, (gone, t) in lines.items() if not gone or words(t)}
    assert {r["doc_id"]: r["text"] for r in frames[2].collect()} == kept and frames[2].count() == len(kept)
    groups = jaccard_brute([(r["doc_id"], r["text"]) for r in frames[2].collect()])
    assert sorted(r["doc_id"] for r in frames[3].collect()) == sorted(i for i, (_, c) in groups.items() if i == c)
    before = frames[3].toPandas()
    before["size"] = before.text.map(lambda t: len(words(t)))
    by = before.groupby("source")["size"].agg(["sum", "max"]).sort_index()
    after = frames[4].toPandas()
    after["size"] = after.text.map(lambda t: len(words(t)))
    taken = after.groupby("source")["size"].sum().reindex(by.index, fill_value=0)
    want = mixing.targets(by["sum"].tolist(), np.resize([5, 2, 1], len(by)))
    assert (np.abs(taken - want) <= by["max"]).all()
    per = after.groupby("doc_id").size()
    assert per.max() <= 3 and set(per.index) <= set(before.doc_id) and len(rows) == len(after) and (rows.n_tokens == rows.ids.map(len)).all()


def test_scratch_tables_go_at_the_end(spark):
    from ledgerline.llm import common

    outside = common.Scratch(spark, "outside")
    kept = outside.write(spark.range(3), "t")
    with common.passing():
        inside = common.Scratch(spark, "inside")
        n = inside.write(spark.range(5), "t").count()
    path = Path(inside.root.removeprefix("file://"))
    assert n == 5 and not path.exists() and kept.count() == 3
    outside.drop("t")


def test_near_dedup_of_repeated_ids(spark):
    """A text goes for its own near copy only, not for that of another row of its doc_id."""
    draw = random.Random(31)
    p, q = prose(draw, 60, 900), prose(draw, 60, 900)
    rows = [(1, " ".join(p)), (2, " ".join(p + ["end"])), (2, " ".join(q)), (3, " ".join(q + ["end"])), (3, " ".join(q + ["end"])), (None, " ".join(p)), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted(corpus_pipeline.dedup_near(spark, df, DATA).collect(), key=repr)
    assert out == sorted((r for r in df.collect() if (r["doc_id"], (r["text"] or "")[-3:]) not in ((2, "end"), (3, "end"))), key=repr)


def test_mix_keeps_rows_apart(spark):
    rows = [(1, "a b c", "en", "s", 5)] * 2 + [(2, None, None, None, None), (None, "d e f", None, None, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.mix_sources(spark, df, DATA).collect()
    assert sum(r["doc_id"] == 1 for r in out) >= 2 and {r["doc_id"] for r in out} <= {1, None} and mixing.mix(df).count() == 4
