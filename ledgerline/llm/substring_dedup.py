"""Substring dedup by collinear chaining of shared k-mer seeds.

1. A document's seeds are the minimizers of its runs of ``K`` words: the least hash of every
   ``WINDOW`` consecutive ones, so any run of K + WINDOW - 1 words that two documents share has a
   seed in both. Every place of a seed counts. Seeds that occur once go.
2. Every place of a seed is matched with the seed's earliest place, found by a grouped minimum, so
   matches grow with the seeds and not with the square of how many documents share one.
3. Where no document leads seeds on both sides of a place (on one diagonal, no more than ``COVER``
   words from one to the next), the runs of 2, 4, 8, 16 and 32 seeds over that place (with the
   distances between them) are keys of their own, matched with the earliest place of the whole run.
   So every stretch of a passage is matched with a document that has as much of it in a row,
   whatever others share less. Elsewhere the leader's chain covers the run, and nothing is sent.
4. Matches of two documents are chained in the order of both by dynamic programming with
   gap costs over a Fenwick tree of prefix maxima, apart where gaps of over ``GAP`` words or shifts
   of over ``SHIFT`` divide them, and chains are cut at such gaps and shifts. A chain has two matches at least. Runs that overlap on one
   diagonal are a chain of their own, too.
5. Chains are aligned on the words, in pieces of one ``BLOCK`` of words of each side: equal stretches
   word by word, an edit distance between matches where they shift, and extension over both ends
   while it pays. Blocks are cut when the texts are read, so no text moves, and a piece is of bounded
   size whatever the texts. Chains of at least ``IDENTITY`` over all their pieces are kept.
6. Spans of a document that touch are one passage; those of ``min_words`` words or more
   are returned, with the share of their words that the spans match. ``n_others`` counts
   the documents that they were matched with, not all that have the passage.

Keys that over 1 in ``common.HOT`` of all places share, fewer than that in any table, meet their
earliest place by broadcast, and so do blocks that as many pieces ask for: a passage that a third
of all documents have stays dealt out.

Defined results: null and empty texts, and those under K words, have no seeds. Places count
words (runs of other than space and the controls 9 to 13; A-Z count as a-z). The first
document, by doc_id, that has a passage keeps it; later ones are reported. Within a document
the first place keeps it, and a later one is reported if the two don't overlap; ``of_doc``
is then the document itself, and each span counts only if it has ``min_words`` words. Rows that repeat a doc_id with other texts are documents of their own,
in the order of their texts' hashes, which ``row`` names (null where a doc_id has one text); rows
that are equal in both are one. Null doc_ids are left out. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shingles
from .common import Scratch, meet, numbered, runs_of_keys

K, WINDOW = 5, 6
#: Words between seeds that are kept where one seed comes again and again.
TIED = 3
#: Seeds of the runs that are keys.
RUNS = (2, 4, 8, 16, 32)
#: What a match earns and a word of gap costs in a chain, and the longest gap.
GAIN, COST, GAP = 8.0, 0.1, 64
#: Words between two seeds on one diagonal that a chain is taken to cover when runs are chosen.
COVER = 32
#: Words put in or left out between two matches of a chain at most.
SHIFT = 24
#: Words looked at beyond both ends of a chain, and words of a block.
REACH, BLOCK = 24, 128
IDENTITY = 0.8
#: Words of a chain, and of a passage, at least.
MIN_CHAIN, MIN_WORDS = 16, 50
U = np.uint64


def minimizers(h: np.ndarray) -> np.ndarray:
    """Places of the least hash of every WINDOW consecutive ones; of equal ones in a row no more than TIED apart."""
    if len(h) <= WINDOW:
        return np.array([int(h.argmin())]) if len(h) else np.zeros(0, np.int64)
    v = np.lib.stride_tricks.sliding_window_view(h, WINDOW)
    at = np.unique(v.argmin(1) + np.arange(len(v)))
    tied = (h[at[1:]] == h[at[:-1]]) & (np.diff(at) < WINDOW)
    if not tied.any():
        return at
    keep = np.ones(len(at), bool)
    kept = 0
    for i in np.flatnonzero(tied).tolist():  # at[i] and at[i + 1] are equal: words that come again and again
        if i == 0 or not tied[i - 1]:
            kept = at[i]
        # at[i + 1] may go if the one after it is near enough to the last kept, too
        if i + 1 < len(tied) and tied[i + 1] and at[i + 2] - kept <= TIED:
            keep[i + 1] = False
        else:
            kept = at[i + 1]
    return at[keep]


def seeds_of(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seeds of a text and their places."""
    h = shingles.runs(words, K)
    at = minimizers(h)
    return h[at].view(np.int64), at.astype(np.int32)


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, pos, seed, null) for every seed, and (doc, number, null, words) for every block, as 16 bits a word with what stands around it."""
    names = ["doc", "pos", "seed", "words"]
    for batch in batches:
        ids = batch.column(0).to_numpy()
        for first, words, bounds in shingles.texts(batch.column(1)):
            short = (words >> U(48)).astype(np.uint16)
            found, blocks = [], []
            for a, b in zip(bounds, bounds[1:]):
                found.append(seeds_of(words[a:b]))
                of = short[a:b]
                blocks.append([of[max(0, s - REACH) : s + BLOCK + GAP + K + REACH].tobytes() for s in range(0, len(of), BLOCK)] if len(found[-1][0]) else [])
            n, m = [len(s) for s, _ in found], [len(x) for x in blocks]
            docs = ids[first : first + len(n)]
            if sum(n):
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(docs, n)), pa.array(np.concatenate([p for _, p in found])), pa.array(np.concatenate([s for s, _ in found])), pa.nulls(sum(n), pa.binary())], names=names)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(docs, m)), pa.array(np.concatenate([np.arange(x, dtype=np.int32) for x in m])), pa.nulls(sum(m), pa.int64()), pa.array([x for block in blocks for x in block], pa.binary())], names=names)


def reach(doc: np.ndarray, pos: np.ndarray, of: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each seed (sorted by doc, pos) the last seed that one leader's seeds, no more than COVER words apart, cover together with it."""
    n = len(doc)
    order = np.lexsort((np.arange(n), at.astype(np.int64) - pos, of, doc))
    d, p, o, lean = doc[order], pos[order], of[order], (at.astype(np.int64) - pos)[order]
    new = np.ones(n, bool)
    new[1:] = (d[1:] != d[:-1]) | (o[1:] != o[:-1]) | (lean[1:] != lean[:-1]) | (np.diff(p) > COVER)
    first = np.flatnonzero(new)
    last = np.append(first[1:], n) - 1
    out = np.arange(n)
    np.maximum.at(out, order[first], order[last])
    return np.maximum.accumulate(out)  # a cover never ends in a later document


def _uneven(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, doc, pos, len) of the runs of neighbouring seeds (sorted by doc, pos) that no leader covers."""
    steps = shingles.mix(np.arange(1, 2 * max(RUNS) + 1, dtype=U)) | U(1)
    for table, bounds in runs_of_keys(batches, ["doc"]):
        doc, pos, seed, of, at = (table.column(c).to_numpy() for c in ("doc", "pos", "seed", "of", "at"))
        gap = np.diff(pos.astype(np.int64), append=0)
        apart = np.ones(len(doc), bool)  # from the place before: another document, or too far to be one run
        apart[1:] = (doc[1:] != doc[:-1]) | (gap[:-1] > GAP)
        before, cover = np.cumsum(apart), reach(doc, pos, of, at)
        h = shingles.mix(seed.view(U))
        for n in RUNS:
            m = len(doc) - n + 1
            if m <= 0:
                break
            i = np.flatnonzero((before[n - 1 :] == before[:m]) & (cover[:m] < np.arange(n - 1, len(doc))))
            if len(i) == 0:
                continue
            key = np.full(len(i), n, U)
            for k in range(n):
                key += h[i + k] * steps[2 * k]
                if k < n - 1:
                    key += gap[i + k].astype(U) * steps[2 * k + 1]
            yield pa.RecordBatch.from_arrays([pa.array(shingles.mix(key).view(np.int64)), pa.array(doc[i]), pa.array(pos[i]), pa.array((pos[i + n - 1] - pos[i] + K).astype(np.int32))], names=["seed", "doc", "pos", "len"])


def chains_of(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Indices of the matches (x ascending) of each chain, the best first, before cuts at wide gaps.

    f(i) = GAIN + max over j before i in both of f(j) - COST x gaps; with COST by the sum of
    both coordinates, the maximum is one prefix query over ranks of y.
    """
    n = len(x)
    ranks = np.searchsorted(np.unique(y), y) + 1
    size = int(ranks.max()) + 1
    best, who = [-1e300] * (size + 1), [-1] * (size + 1)
    score, back = np.empty(n), np.full(n, -1)
    place = COST * (x.astype(float) + y) / 2
    i = 0
    while i < n:
        same = i
        while same < n and x[same] == x[i]:  # none of one place of x follows another
            top, at, r = -1e300, -1, int(ranks[same]) - 1
            while r > 0:
                if best[r] > top:
                    top, at = best[r], who[r]
                r -= r & -r
            link = top - place[same]
            if at >= 0 and link > 0:
                score[same], back[same] = GAIN + link, at
            else:
                score[same] = GAIN
            same += 1
        for k in range(i, same):
            r, v = int(ranks[k]), score[k] + place[k]
            while r <= size:
                if v > best[r]:
                    best[r], who[r] = v, k
                r += r & -r
        i = same
    used, out = np.zeros(n, bool), []
    for k in np.argsort(-score, kind="stable"):
        chain = []
        while k >= 0 and not used[k]:
            used[k] = True
            chain.append(k)
            k = back[k]
        if chain:
            out.append(np.array(chain[::-1]))
    return out


def segments(x: np.ndarray, y: np.ndarray, length: np.ndarray) -> list[tuple[int, int, int]]:
    """(x, y, words) of what matches that overlap or touch on one diagonal cover together."""
    order = np.lexsort((x, x - y))
    x, y, stop = x[order], y[order], x[order] + length[order]
    out: list[list[int]] = []
    for p, q, e in zip(x.tolist(), y.tolist(), stop.tolist()):
        if out and out[-1][0] - out[-1][1] == p - q and p <= out[-1][2]:
            out[-1][2] = max(out[-1][2], e)
        else:
            out.append([p, q, e])
    return [(p, q, e - p) for p, q, e in out]


def cover(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """As few of the segments, (x, y, words), as cover the same places x."""
    out, end, best = [], -1, None
    for one in sorted(found):
        if best is not None and one[0] > end:
            out.append(best)
            end, best = best[0] + best[2], None
        if one[0] + one[2] > end and (best is None or one[0] + one[2] > best[0] + best[2]):
            if one[0] > end:  # nothing before it reaches here
                end = one[0]
            best = one
    return [*out, best] if best is not None else out


def apart(x: np.ndarray, y: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Matches in groups, x ascending, that no chain can cross: by shifts of over SHIFT, then by gaps of over GAP."""
    lean = x - y
    if lean.max() - lean.min() > SHIFT:
        order = np.lexsort((y, x, lean))
        cut = np.flatnonzero(np.diff(lean[order]) > SHIFT) + 1
        bands = [g[np.lexsort((y[g], x[g]))] for g in np.split(order, cut)]
    else:
        bands = [np.arange(len(x))]
    out = []
    for g in bands:
        cut = np.flatnonzero(np.diff(x[g]) > GAP + K) + 1
        out += [(x[i], y[i]) for i in (np.split(g, cut) if len(cut) else [g]) if len(i) > 1]
    return out


def steady(x: np.ndarray, y: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """A chain without single matches off the diagonal of both their neighbours, cut at wide gaps and shifts."""
    lean = x - y
    if len(x) > 2:
        off = (np.abs(lean[1:-1] - lean[:-2]) > 4) & (np.abs(lean[1:-1] - lean[2:]) > 4) & (np.abs(lean[2:] - lean[:-2]) <= 4)
        if off.any():
            keep = np.concatenate([[True], ~off, [True]])
            x, y, lean = x[keep], y[keep], lean[keep]
    wide = (np.diff(x) > GAP + K) | (np.diff(y) > GAP + K) | (np.abs(np.diff(lean)) > SHIFT)
    if not wide.any():
        return [(x, y)]
    at = np.flatnonzero(wide) + 1
    return list(zip(np.split(x, at), np.split(y, at)))


def _cut(px: np.ndarray, py: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pieces of chains that stand one after the other and begin at starts: (chain, first match, matches, is first, is last)."""
    block = (px // BLOCK) * (1 << 31) + py // BLOCK
    new = np.zeros(len(px), bool)
    new[starts] = True
    opens = new.copy()
    opens[1:] |= block[1:] != block[:-1]
    i = np.flatnonzero(opens)
    stop = np.append(i[1:], len(px))
    last = np.append(new[i[1:]], True)
    return np.cumsum(new)[i] - 1, i, stop - i + ~last, new[i], last  # a piece ends with the match that the next one begins with


def _pieces(d: np.ndarray, o: np.ndarray, no: np.ndarray, px: np.ndarray, py: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
    """The pieces of chains, of d, o and no each, whose matches px, py stand one after the other."""
    chain, i, n, first, last = _cut(px, py, starts)
    ends = np.concatenate([[0], np.cumsum(n)])
    flat = np.arange(ends[-1]) + np.repeat(i - ends[:-1], n)
    lists = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(p[flat].astype(np.int32))) for p in (px, py)]
    plain = [d[chain], o[chain], no[chain].astype(np.int32), (px[i] // BLOCK).astype(np.int32), (py[i] // BLOCK).astype(np.int32), first, last]
    return pa.RecordBatch.from_arrays([*map(pa.array, plain), *lists], names=["doc", "of", "no", "x", "y", "first", "last", "xs", "ys"])


def _tangled(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The chains of matches of two documents: runs on one diagonal, and the best chains of all matches."""
    found = []
    if (long_ := n > K).any():
        runs = cover(segments(x[long_], y[long_], n[long_]))
        spread = [np.minimum(np.arange(0, z - K + 16, 16), z - K) for _, _, z in runs]
        found = [(p + m, q + m) for (p, q, z), m in zip(runs, spread) if z >= MIN_CHAIN]
        x, y = np.concatenate([x, *(p + m for (p, _, _), m in zip(runs, spread))]), np.concatenate([y, *(q + m for (_, q, _), m in zip(runs, spread))])
        both = np.unique(x * (1 << 31) + y)
        x, y = both >> 31, both & ((1 << 31) - 1)
    for gx, gy in apart(x, y):
        straight = ((np.diff(gx) > 0) & (np.diff(gy) > 0)).all()
        found += [part for c in ([np.arange(len(gx))] if straight else chains_of(gx, gy)) for part in steady(gx[c], gy[c])]
    return [f for f in found if len(f[0]) > 1]


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chains of matches (sorted by doc, of, pos, at), in pieces of one block of each side; a piece ends where the next begins.

    Matches of two documents that are one chain as they stand, by far the most, are cut all at once.
    """
    for table, bounds in runs_of_keys(batches, ["doc", "of"]):
        d, o = table.column("doc").to_numpy(), table.column("of").to_numpy()
        x, y, n = (table.column(c).to_numpy().astype(np.int64) for c in ("pos", "at", "len"))
        starts, sizes = bounds[:-1], np.diff(bounds)
        dx, dy = np.diff(x, prepend=0), np.diff(y, prepend=0)
        odd = (dx <= 0) | (dy <= 0) | (dx > GAP + K) | (dy > GAP + K) | (np.abs(dx - dy) > 4)
        odd[starts] = False
        odd = np.add.reduceat(odd | (n > K), starts) > 0
        plain = ~odd & (sizes > 1)
        if plain.any():
            rows = np.repeat(plain, sizes)
            heads = starts[plain]
            yield _pieces(d[heads], o[heads], np.zeros(len(heads), np.int32), x[rows], y[rows], np.concatenate([[0], np.cumsum(sizes[plain])[:-1]]))
        found = [(d[s], o[s], no, px, py) for s, e in zip(starts[odd], bounds[1:][odd]) for no, (px, py) in enumerate(_tangled(x[s:e], y[s:e], n[s:e]))]
        if found:
            di, oi, no, px, py = zip(*found)
            yield _pieces(np.array(di), np.array(oi), np.array(no), np.concatenate(px), np.concatenate(py), np.cumsum([0, *map(len, px)])[:-1])


PIECES = "doc long, of long, no int, x int, y int, first boolean, last boolean, xs array<int>, ys array<int>"


def _edits(a: np.ndarray, b: np.ndarray) -> int:
    """Edit distance of two short runs of words."""
    if len(a) == len(b) and (a == b).all():
        return 0
    if len(a) == 0 or len(b) == 0:
        return max(len(a), len(b))
    row = np.arange(len(b) + 1)
    for i in range(len(a)):
        step = np.minimum(row[1:] + 1, row[:-1] + (b != a[i]))
        row = np.minimum.accumulate(np.concatenate([[i + 1], step]) - np.arange(len(b) + 1)) + np.arange(len(b) + 1)
    return int(row[-1])


def _extend(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Words of both beyond an end that it pays to take (1 for an equal pair, -2 for another, put in or left out), and the unequal ones."""
    x, y = a.tolist(), b.tolist()
    i = j = wrong = 0
    while True:
        best = (0, 0, 0, 0)
        for p, q in ((0, 0), (1, 0), (0, 1), (2, 0), (0, 2)):
            n = min(len(x) - i - p, len(y) - j - q)
            paid, unequal = -2 * (p + q), p + q
            for k in range(n):  # REACH words at most
                if x[i + p + k] == y[j + q + k]:
                    paid += 1
                    if paid > best[0]:
                        best = (paid, p + k + 1, q + k + 1, unequal)
                else:
                    paid -= 2
                    unequal += 1
        if best[0] <= 0:
            return i, j, wrong
        i, j, wrong = i + best[1], j + best[2], wrong + best[3]


def _between(a: np.ndarray, b: np.ndarray) -> int:
    """Edits between two runs of words, word by word where that makes few."""
    if len(a) == len(b):
        unequal = int((a != b).sum())
        return unequal if unequal <= 2 else min(unequal, _edits(a, b))
    return _edits(a, b)


def align(xs: np.ndarray, ys: np.ndarray, first: bool, last: bool, a: np.ndarray, a0: int, b: np.ndarray, b0: int) -> tuple[int, int, int, int, int]:
    """(start, stop) in both texts and the words between that don't match; a: words from a0 on.

    A piece reaches from its first match to its last, which the next piece begins with, and
    beyond the matches where the chain begins or ends.
    """
    x, y = xs - a0, ys - b0
    start, other, stop, until = int(x[0]), int(y[0]), int(x[-1]), int(y[-1])
    if last:
        stop, until = stop + K, until + K
    edits = int((a[start:stop] != b[other:until]).sum()) if stop - start == until - other else 3
    if edits > 2:
        edits = sum(_between(a[p:q], b[r:t]) for p, q, r, t in zip(x, x[1:], y, y[1:]))
        edits += int((a[x[-1] : stop] != b[y[-1] : until]).sum())
    if last:
        more, there, wrong = _extend(a[stop : stop + REACH], b[until : until + REACH])
        stop, until, edits = stop + more, until + there, edits + wrong
    if first:
        less, there, wrong = _extend(a[max(0, start - REACH) : start][::-1], b[max(0, other - REACH) : other][::-1])
        start, other, edits = start - less, other - there, edits + wrong
    return a0 + start, a0 + stop, b0 + other, b0 + until, edits


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        c = {n: batch.column(n) for n in batch.schema.names}
        plain = [c[n].to_numpy(zero_copy_only=False) for n in ("x", "y", "first", "last")]
        words = [c[n].to_pylist() for n in ("a", "b")]
        lists = [(c[n].values.to_numpy(), c[n].offsets.to_numpy()) for n in ("xs", "ys")]
        rows = []
        for i in range(batch.num_rows):
            xs, ys = (v[o[i] : o[i + 1]] for v, o in lists)
            x, y, first, last = (p[i] for p in plain)
            rows.append(align(xs, ys, first, last, np.frombuffer(words[0][i], np.uint16), max(0, int(x) * BLOCK - REACH), np.frombuffer(words[1][i], np.uint16), max(0, int(y) * BLOCK - REACH)))
        cols = list(zip(*rows)) if rows else [()] * 5
        yield pa.RecordBatch.from_arrays([c["doc"], c["of"], c["no"], *(pa.array(v, pa.int32()) for v in cols)], names=["doc", "of", "no", "start", "stop", "other_start", "other_stop", "edits"])


def earliest(rows: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """rows (seed, doc, pos and others) of seeds that have two places or more, with the earliest: of, at."""
    counts = scratch.write(rows.groupBy("seed").agg(F.min("doc").alias("of"), F.count("*").alias("c")).where("c > 1"), f"{name}-counts")
    total = rows.count()
    met = scratch.write(meet(rows, counts, ["seed"], total), f"{name}-met")
    place = scratch.write(met.where("doc = of").groupBy("seed").agg(F.min("pos").alias("at")).join(counts.select("seed", "c"), "seed"), f"{name}-first")
    out = scratch.write(meet(met, place, ["seed"], total), name)
    for done in ("counts", "met", "first"):
        scratch.drop(f"{name}-{done}")
    return out


def with_blocks(pieces: DataFrame, blocks: DataFrame, doc: str, number: str, words: str, scratch: Scratch) -> DataFrame:
    """pieces with the words of the block that doc and number name."""
    key = [doc, number]
    one = blocks.select(F.col("doc").alias(doc), F.col("pos").alias(number), F.col("words").alias(words))
    asked = scratch.write(pieces.groupBy(*key).agg(F.count("*").alias("c")).join(one, key), f"blocks-{words}")
    return meet(pieces, asked, key, pieces.count())


def earlier(length: Column) -> Column:
    """Is (of, at) a place of an earlier document, or before doc and pos in the same?"""
    return (F.col("of") < F.col("doc")) | ((F.col("of") == F.col("doc")) & (F.col("at") + length <= F.col("pos")))


def spans(docs: DataFrame, scratch: Scratch, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, of, start, stop, other_start, other_stop, identity): aligned chains of a document (doc, text) with an earlier one."""
    marks = scratch.write(docs.where(F.octet_length("text") > 2 * K - 2).mapInArrow(_marks, "doc long, pos int, seed long, words binary"), "marks")
    seeds = earliest(marks.where("seed is not null").select("seed", "doc", "pos"), scratch, "seeds")
    blocks = scratch.write(marks.where("words is not null").select("doc", "pos", "words"), "blocks")
    scratch.drop("marks")  # most of it are seeds that occur once
    runs = scratch.write(seeds.repartition("doc").sortWithinPartitions("doc", "pos").mapInArrow(_uneven, "seed long, doc long, pos int, len int"), "runs")
    longer = earliest(runs, scratch, "runs-placed")
    both = seeds.select("doc", "of", "pos", "at", F.lit(K).alias("len")).unionByName(longer.select("doc", "of", "pos", "at", "len"))
    # places of a document that are nearer to each other than min_words can't be of two passages
    matches = both.where(earlier(F.greatest("len", F.lit(min_words))))
    order = ["doc", "of", "pos", "at"]
    pieces = scratch.write(matches.repartition("doc", "of").sortWithinPartitions(*order).mapInArrow(_chains, PIECES), "pieces")
    for done in ("seeds", "runs", "runs-placed"):
        scratch.drop(done)
    left = scratch.write(with_blocks(pieces, blocks, "doc", "x", "a", scratch), "left")
    full = with_blocks(left, blocks, "of", "y", "b", scratch).select("doc", "of", "no", "x", "y", "first", "last", "xs", "ys", "a", "b")
    aligned = full.mapInArrow(_aligned, "doc long, of long, no int, start int, stop int, other_start int, other_stop int, edits int")
    ends = [F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("other_start").alias("other_start"), F.max("other_stop").alias("other_stop")]
    whole = aligned.groupBy("doc", "of", "no").agg(*ends, F.sum("edits").alias("edits")).drop("no")
    length = F.greatest(F.col("stop") - F.col("start"), F.col("other_stop") - F.col("other_start"))
    whole = whole.withColumn("identity", 1 - F.col("edits") / length).drop("edits")
    # a span and the earlier place in its own document, both extended, are cut back to where they don't overlap
    over = F.when(F.col("doc") == F.col("of"), F.greatest(F.col("other_stop") - F.col("start"), F.lit(0))).otherwise(0)
    whole = whole.withColumn("over", over).withColumns({c: F.col(c) - F.col("over") for c in ("stop", "other_stop")}).drop("over")
    least = F.when(F.col("doc") == F.col("of"), min_words).otherwise(min(MIN_CHAIN, min_words))
    return whole.where((F.col("identity") >= IDENTITY) & (F.col("stop") - F.col("start") >= least))


def passages(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, row, start_word, end_word, n_words, of_doc, n_others, identity): passages that an earlier document has."""
    scratch = Scratch(df.sparkSession, "substrings")
    docs, names = numbered(df, scratch, doc_id, text)
    found = scratch.write(spans(docs, scratch, min_words), "spans")
    # spans that overlap or touch within a document; its spans are as many as its seeds at most
    order = Window.partitionBy("doc").orderBy("start", "stop", "of")
    before = found.withColumn("reach", F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    run = before.withColumn("run", F.sum(F.when(F.col("start") <= F.col("reach"), 0).otherwise(1)).over(order))
    size = F.col("stop") - F.col("start")
    merged = run.groupBy("doc", "run").agg(
        F.min("start").alias("start_word"), F.max("stop").alias("end_word"), F.min("of").alias("of"), F.countDistinct("of").alias("n_others"),
        (F.sum(F.col("identity") * size) / F.sum(size)).alias("identity"),
    ).withColumn("n_words", F.col("end_word") - F.col("start_word")).where(F.col("n_words") >= min_words)
    if names is None:
        out = merged.withColumns({"doc_id": F.col("doc"), "row": F.lit(None).cast("long"), "of_doc": F.col("of")})
    else:
        of = names.select("doc", "doc_id", F.when(~F.col("only"), F.col("row")).alias("row"))
        out = merged.join(of, "doc").join(names.select(F.col("doc").alias("of"), F.col("doc_id").alias("of_doc")), "of")
    return out.select("doc_id", "row", "start_word", "end_word", "n_words", "of_doc", "n_others", "identity")
