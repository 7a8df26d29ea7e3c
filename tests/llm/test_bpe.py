import hashlib
import random

import pytest
from tokenizers import Tokenizer

from ledgerline.llm import bpe

PATH = bpe.default_vocabulary()


@pytest.fixture(scope="module")
def both():
    return Tokenizer.from_file(PATH), bpe.WordBPE(PATH)


def same(both, text):
    import numpy as np

    library, own = both
    want = library.encode(text or "", add_special_tokens=False).ids
    got = np.frombuffer(own.encode(text), np.int32)
    assert got.tolist() == want, text
    assert own.decode(got) == library.decode(want, skip_special_tokens=False)


def test_random_texts_as_the_library(both):
    pieces = ["a", "B", " ", "\n", "'s", "é", "é", "Σ", "İ", "漢", "1", " ", "\x1c", "\x85", "<|endoftext|>", "<|", "!!", "😀", "ﬁ", "\x00", "th", "ing", "क्"]
    draw = random.Random(4)
    for _ in range(3000):
        same(both, "".join(draw.choice(pieces) for _ in range(draw.randint(0, 14))))


def test_every_code_point_as_the_library(both):
    """Alone between letters and beside a digit, in batches; all planes but the surrogates."""
    import numpy as np

    library, own = both
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}b{c}{c}1 {c}" for c in points[:0x30000]] + ["".join(f"a{c}1" for c in points[i : i + 512]) for i in range(0x30000, len(points), 512)]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    wrong = [t[:8] for t, ids in zip(texts, want) if np.frombuffer(own.encode(t), np.int32).tolist() != ids]
    assert not wrong, (len(wrong), wrong[:20])


def test_special_tokens_of_other_looks(both, tmp_path):
    import json

    spec = json.load(open(PATH, encoding="utf-8"))
    for k, name in enumerate(("[stop]", "##")):
        spec["added_tokens"].append({**spec["added_tokens"][0], "id": 49408 + k, "content": name})
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    other = Tokenizer.from_file(str(path)), bpe.WordBPE(str(path))
    for text in ("x[stop]y", "## a ###", "<|endoftext|>##[stop]", "[stop", "A[STOP]"):
        same(other, text)


def test_edges_and_long_words(both):
    for text in (None, "", " \n ", "a" * 5000, "thing" * 2000, "ab" * 4000, "<|startoftext|>x<|endoftext|>"):
        same(both, text)


def test_fragments_put_together_are_the_word(both):
    _, own = both
    for word in ("thnttionshing", "žluťoučký", "éeauauxê"):
        symbols = word.encode().decode("latin-1").translate(own.symbols)
        assert "".join(own.cuts(symbols)) == symbols + bpe.END


def test_columns_nulls_and_repeats(spark):
    rows = [(1, "The thing", "x"), (1, "The thing", "x"), (2, None, None), (None, "", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.digests(bpe.round_trip(df)).collect()
    assert len(out) == 4 and {r["doc_id"] for r in out} == {1, 2, None}
    empty = hashlib.sha256(b"").hexdigest()
    assert all(r["ids_sha256"] == empty and r["n_tokens"] == 0 for r in out if r["doc_id"] != 1)
    assert bpe.round_trip(df.limit(0)).count() == 0


def test_decode_undoes_encode(spark):
    df = spark.createDataFrame([("hello world",), (None,)], "text string")
    got = {r["text"]: r["decoded"] for r in bpe.decode(bpe.encode(df)).collect()}
    assert got == {"hello world": "hello</w> world</w>", None: ""}
