"""BPE encoding and decoding by forced-boundary splitting.

Two neighbouring symbols that stand side by side in no token of the vocabulary
can't end up in one token, whatever the merges do, so there is a certain cut
between them. A word falls into fragments at these cuts; each is encoded alone,
and the ids are put together in order. Fragments recur far more often than words
or texts, so a worker keeps the ids of those it has seen lately.

The vocabulary file is one of the ``tokenizers`` kind with word ends: canonical
composition, white space dropped, lower case, byte symbols, ``</w>`` after the last
symbol of a word. White space is in no token either, so what stands between two
white spaces is looked up as a whole first.

Defined results: a null or empty text has no ids and decodes to the empty text.
Texts of any length are taken whole; a fragment's merges take n log n steps.
Repeated rows and rows of the same text are encoded each for itself. Columns
other than the text are kept as they are; new columns replace ones of the same
name. A special token's own string in a text becomes its id.
"""

from __future__ import annotations

import functools
import heapq
import json
import os
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Regex, normalizers

#: Entries of each of the two generations of a worker's memory of chunks.
MEMORY = 200_000
#: Bytes of output after which a batch is handed over.
BATCH_BYTES = 16 << 20
END = "</w>"

#: All code points that a text may have.
POINTS = [*range(0xD800), *range(0xE000, 0x110000)]


def _ranges(points: list[int]) -> str:
    """Rising code points as the inside of a pattern's class."""
    p = np.array(points)
    cut = np.flatnonzero(np.diff(p) > 1)
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(p[[0, *(cut + 1)]].tolist(), p[[*cut, -1]].tolist()))


def _class(name: str) -> str:
    """The code points that the vocabulary's library has in a general category.

    Python, the regex package and the library each have the tables of another version of
    Unicode, so the library itself is asked once which of all code points it drops.
    """
    kept = normalizers.Replace(Regex(rf"[^\p{{{name}}}]+"), "").normalize_str("".join(map(chr, POINTS)))
    return _ranges([ord(c) for c in kept])


# The endings that are words of their own, and the pattern that the vocabulary file states.
ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
WORDS = regex.compile(rf"{ENDINGS}|[\p{{L}}]+|[\p{{N}}]|[^\s\p{{L}}\p{{N}}]+")


@functools.cache
def words_pattern() -> regex.Pattern:
    """The same pattern with the library's letters and numbers, for words with code points that are new to Python's tables."""
    letter, number = _class("L"), _class("N")
    return regex.compile(rf"{ENDINGS}|[{letter}]+|[{number}]|[^\s{letter}{number}]+")


@functools.cache
def unknown_pattern() -> regex.Pattern:
    """Code points that Python's tables don't have: the library normalises and splits them by its own."""
    return regex.compile(f"[{_ranges([c for c in POINTS if unicodedata.category(chr(c)) == 'Cn'])}]")


#: All code points below are in every version.
OLD = "\u0378"
#: What the vocabulary file states for normalising, but for white space, which is gone by then.
NORMAL = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
#: Python's str.split also splits at these four, which Unicode has not as white space.
SEPARATORS = regex.compile("[\x1c-\x1f]")
SPACE = regex.compile(r"\p{White_Space}+")


def byte_symbols() -> list[str]:
    """The printable character for each byte: its own where it has one, else 256 and up in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class WordBPE:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.symbols = dict(enumerate(byte_symbols()))
        self.ranks = {(a, b): i for i, (a, b) in enumerate(map(self._pair, model["merges"]))}
        names = {**{i: t for t, i in self.vocab.items()}, **{i: t for t, i in self.special.items()}}
        self.names = np.array([names.get(i, "") for i in range(max(names) + 1)], dtype=object)
        self.joined = self._inside()
        self.special_re = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        #: What every special token begins with: a text without it has none of them.
        self.mark = os.path.commonprefix(list(self.special))
        self.find_words, self.find_unknown = words_pattern().findall, unknown_pattern().search
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.fragments: dict[str, list[int]] = {}

    @staticmethod
    def _pair(merge) -> tuple[str, str]:
        a, b = merge.split(" ") if isinstance(merge, str) else merge
        return a, b

    @staticmethod
    def _symbols_of(token: str) -> list[str]:
        if token.endswith(END) and len(token) > len(END):
            body = token[: -len(END)]
            return [*body[:-1], body[-1] + END]
        return list(token)

    def _inside(self) -> set[tuple[str, str]]:
        """Pairs of symbols that stand side by side inside some token."""
        return {pair for token in self.vocab for s in (self._symbols_of(token),) for pair in zip(s, s[1:])}

    def cuts(self, symbols: str) -> list[str]:
        """The fragments of a word's symbols between the certain cuts; the last ends in END."""
        whole = symbols[-1:] + END
        if len(symbols) == 1:
            return [whole]
        joined, out, start = self.joined, [], 0
        for i, pair in enumerate(zip(symbols, symbols[1:-1]), 1):
            if pair not in joined:
                out.append(symbols[start:i])
                start = i
        if (symbols[-2], whole) not in joined:
            out.append(symbols[start:-1])
            start = len(symbols) - 1
        out.append(symbols[start:] + END)
        return out

    def merge(self, parts: list[str]) -> list[str]:
        """Merges by rank, leftmost first, until none applies."""
        rank = self.ranks.get
        none = 1 << 30
        if len(parts) <= 48:
            found = [rank(p, none) for p in zip(parts, parts[1:])]
            while found:
                best = min(found)
                if best == none:
                    break
                i = found.index(best)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                del found[i]
                if i:
                    found[i - 1] = rank((parts[i - 1], parts[i]), none)
                if i < len(found):
                    found[i] = rank((parts[i], parts[i + 1]), none)
            return parts
        ranks = self.ranks
        n = len(parts)
        after, before, alive = [*range(1, n), -1], [-1, *range(n - 1)], [True] * n
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j < 0 or parts[i] != a or parts[j] != b:
                continue
            parts[i], alive[j], after[i] = a + b, False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left in (before[i], i):
                if left >= 0 and after[left] >= 0 and (r := ranks.get((parts[left], parts[after[left]]))) is not None:
                    heapq.heappush(heap, (r, left, parts[left], parts[after[left]]))
        return [p for p, live in zip(parts, alive) if live]

    def word(self, word: str) -> list[int]:
        ids: list[int] = []
        for fragment in self.cuts(word.encode().decode("latin-1").translate(self.symbols)):
            known = self.fragments.get(fragment)
            if known is None:
                known = [self.vocab[t] for t in self.merge(self._symbols_of(fragment))]
                if len(fragment) <= 32:
                    if len(self.fragments) >= MEMORY // 2:
                        self.fragments.clear()
                    self.fragments[fragment] = known
            ids += known
        return ids

    def _chunk(self, chunk: str) -> bytes:
        """The ids of what stands between white space, as 32-bit integers."""
        found = self.old.get(chunk)
        if found is None:
            ids = array("i")
            known = not chunk or max(chunk) < OLD or not self.find_unknown(chunk)
            for w in WORDS.findall(chunk) if known else self.find_words(NORMAL.normalize_str(chunk)):
                ids.extend(self.word(w))
            found = ids.tobytes()
        if len(chunk) <= 64:
            if len(self.new) >= MEMORY:
                self.old, self.new = self.new, {}
            self.new[chunk] = found
        return found

    def _plain(self, text: str) -> bytes:
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            text = text.replace("Σ", "σ")  # a final sigma is lower-cased like any other
        text = text.lower()
        chunks = SPACE.split(text) if SEPARATORS.search(text) else text.split()
        get, out = self.new.get, []
        for c in chunks:
            out.append(get(c) or self._chunk(c))
        return b"".join(out)

    def encode(self, text: str | None) -> bytes:
        """The ids as 32-bit integers in the machine's order."""
        if not text:
            return b""
        if self.special_re is None or self.mark not in text:
            return self._plain(text)
        out, at = [], 0
        for m in self.special_re.finditer(text):
            out += [self._plain(text[at : m.start()]), array("i", [self.special[m[0]]]).tobytes()]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def decode(self, ids: np.ndarray) -> str:
        """The tokens' strings with a space between, as a file without a decoder has them."""
        return " ".join(self.names.take(ids).tolist())


_loaded: dict[str, WordBPE] = {}


def loaded(path: str) -> WordBPE:
    """One for each worker, which tasks share."""
    if path not in _loaded:
        _loaded[path] = WordBPE(path)
    return _loaded[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _with_columns(df: DataFrame, columns: dict[str, T.DataType], function) -> DataFrame:
    """df with columns that function makes from each of its Arrow batches, in bounded pieces."""
    kept = [c for c in df.columns if c not in columns]
    schema = T.StructType([*(df.schema[c] for c in kept), *(T.StructField(c, t) for c, t in columns.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, arrays in function(batch):
                part = batch.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in kept), *arrays], names=[*kept, *columns])

    return df.mapInArrow(run, schema)


def _id_lists(pieces: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(p) // 4 for p in pieces)], dtype=np.int32)
    values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(pieces))])
    return pa.ListArray.from_arrays(pa.array(ends), values)


def encode(df: DataFrame, text: str = "text", *, ids: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """df with the ids of each text."""
    path = vocabulary or default_vocabulary()

    def run(batch):
        bpe, pieces, size, start = loaded(path), [], 0, 0
        for i, value in enumerate(batch.column(batch.schema.get_field_index(text))):
            pieces.append(bpe.encode(value.as_py()))
            size += len(pieces[-1])
            if size > BATCH_BYTES:
                yield start, i + 1, [_id_lists(pieces)]
                pieces, size, start = [], 0, i + 1
        if start < batch.num_rows:
            yield start, batch.num_rows, [_id_lists(pieces)]

    return _with_columns(df, {ids: T.ArrayType(T.IntegerType())}, run)


def decode(df: DataFrame, ids: str = "ids", *, text: str = "decoded", vocabulary: str | None = None) -> DataFrame:
    """df with the text that each list of ids stands for; null ids: the empty text."""
    path = vocabulary or default_vocabulary()

    def run(batch):
        bpe, out, size, start = loaded(path), [], 0, 0
        lists = batch.column(batch.schema.get_field_index(ids))
        values, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        for i in range(batch.num_rows):
            out.append(bpe.decode(values[ends[i] : ends[i + 1]]) if lists[i].is_valid else "")
            size += len(out[-1])
            if size > BATCH_BYTES:
                yield start, i + 1, [pa.array(out, pa.string())]
                out, size, start = [], 0, i + 1
        if start < batch.num_rows:
            yield start, batch.num_rows, [pa.array(out, pa.string())]

    return _with_columns(df, {text: T.StringType()}, run)


def round_trip(df: DataFrame, text: str = "text", *, ids: str = "ids", decoded: str = "decoded", vocabulary: str | None = None) -> DataFrame:
    """encode() and decode() in one pass over the texts."""
    path = vocabulary or default_vocabulary()

    def run(batch):
        bpe, pieces, out, size, start = loaded(path), [], [], 0, 0
        for i, value in enumerate(batch.column(batch.schema.get_field_index(text))):
            pieces.append(bpe.encode(value.as_py()))
            out.append(bpe.decode(np.frombuffer(pieces[-1], np.int32)))
            size += len(pieces[-1]) + len(out[-1])
            if size > BATCH_BYTES:
                yield start, i + 1, [_id_lists(pieces), pa.array(out, pa.string())]
                pieces, out, size, start = [], [], 0, i + 1
        if start < batch.num_rows:
            yield start, batch.num_rows, [_id_lists(pieces), pa.array(out, pa.string())]

    return _with_columns(df, {ids: T.ArrayType(T.IntegerType()), decoded: T.StringType()}, run)


def digests(df: DataFrame, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """df with n_tokens and the SHA-256 of ids and text in place of the two."""
    line = F.array_join(F.col(ids).cast("array<string>"), " ")
    return df.select(
        *(c for c in df.columns if c not in (ids, decoded, "n_tokens", "ids_sha256", "decoded_sha256")),
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(line.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col(decoded).cast("binary"), 256).alias("decoded_sha256"),
    )
