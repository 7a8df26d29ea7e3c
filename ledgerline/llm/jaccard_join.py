"""N-gram Jaccard join with a token-group matrix.

Documents with the same set of shingles are one class, and classes are joined. A set is
ordered by rising document frequency; two sets that link share one of the first
n - ceil(0.8 n) + 1 tokens of either (the prefix), so only prefixes are joined.

1. Document frequencies: fingerprints of all tokens, packed and counted by blocks, meet by range
   and are counted. Ranges and the bits of a fingerprint grow with the bytes of all texts, so a
   range holds about ``RANGE_TOKENS`` tokens and few tokens share a fingerprint at any size; a
   token of very many documents is one entry of each block. The ``FREQUENT`` most frequent ones (a
   bounded list) are known to every task. They decide on the order only, never on the result.
2. Groups: classes that agree in a band of two minimum hashes are compared with the most
   typical one of the band, and verified links make groups of similar documents.
3. Token-group matrix: (token, group) for every token of the union of a group's prefixes that
   another group has. Of the whole union only these can bring a link, so the matrix leaves out the
   rest of it, and the bound adds for each side what its prefix leaves out. A class of another group
   counts the tokens it shares with a group and bounds the overlap with any member; only groups
   that can still reach the threshold are opened.
4. Opened groups' members are counted and bounded one by one, in chunks of members that are
   joined by group and chunk, and what is left is verified on the whole sets. Classes of one group are connected already and need no comparing, so a
   large group of near copies makes no rows by the square of its size.

Links of both steps give the components. Nothing is capped: pruning is by bounds that no
linked pair fails.

Defined results: a null or empty text, or one of white space, has the empty set, links with
nothing and is its own component. Equal texts are linked, whatever their number. Rows that
repeat a doc_id are one document, whose text is the one of the smallest hash; the other texts of
that doc_id aren't compared. Null doc_ids are left out, as they can't be named. Columns other
than id and text aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shingles
from .common import Scratch, meet, one_each, shuffle_partitions
from .components import REACHED, components

WIDTH = 5
#: Tokens of a range, and of a block that is packed at once, about; bytes of a text to a token.
RANGE_TOKENS, BLOCK_TOKENS, TOKEN_BYTES = 1 << 21, 1 << 21, 6
#: Bits of a fingerprint beyond those that number the tokens.
SPARE_BITS = 5
#: The least frequency that is looked up, and the most tokens that are.
LEAST, FREQUENT = 12, 1 << 20
#: Bands of two minimum hashes for the first grouping.
BANDS = 6
#: Members of a group that are opened in one row.
CHUNK = 32
#: Bits of the filter of documents that a verification needs: 8 MB.
FILTER_BITS = 26
U = np.uint64


class Layout(NamedTuple):
    """Bits of a fingerprint, and how many of the first ones name its range."""

    key: int
    range: int

    @property
    def low(self) -> int:
        """Whole bytes of the gaps between the fingerprints of a block; what is above them is 127 or less on average."""
        return max(0, -(-(self.key - BLOCK_TOKENS.bit_length() + 1 - 7) // 8))


def layout(size: int) -> Layout:
    """The layout for texts of so many bytes in all."""
    tokens = max(1, size // TOKEN_BYTES)
    return Layout(min(62, max(24, tokens.bit_length() + SPARE_BITS)), max(3, (tokens // RANGE_TOKENS).bit_length()))


def _gaps(places: np.ndarray, low: int) -> tuple[bytes, bytes]:
    """Rising numbers as their gaps: what is above so many low bytes, where 255 carries on, and the low bytes."""
    gap = np.diff(places, prepend=0).astype("<u8")
    high = (gap >> U(8 * low)).astype(np.int64)
    carries = high // 255
    out = np.full(len(high) + int(carries.sum()), 255, np.uint8)
    out[np.cumsum(carries + 1) - 1] = high % 255
    return out.tobytes(), gap.view(np.uint8).reshape(-1, 8)[:, :low].tobytes()


def _places(high: bytes, rest: bytes, low: int) -> np.ndarray:
    h = np.frombuffer(high, np.uint8)
    ends = h != 255
    gap = np.diff(np.cumsum(h.astype(np.int64))[ends], prepend=0) << (8 * low)
    for k, b in enumerate(np.frombuffer(rest, np.uint8).reshape(len(gap), low).T):
        gap += b.astype(np.int64) << (8 * k)
    return np.cumsum(gap)


def _key(tokens: np.ndarray, bits: int) -> np.ndarray:
    return (tokens >> U(64 - bits)).astype(np.int64)


def _packed(form: Layout):
    """(range, gaps, rest, at, more): a block's distinct fingerprints of a range, and which of them it has more than once, and how often."""

    def out(held: list[np.ndarray]) -> pa.RecordBatch:
        keys, counts = np.unique(_key(np.concatenate(held), form.key), return_counts=True)
        low = form.key - form.range
        cut = np.searchsorted(keys, np.arange((1 << form.range) + 1) << low)
        rows = []
        for r in np.flatnonzero(np.diff(cut)):
            k, n = keys[cut[r] : cut[r + 1]], counts[cut[r] : cut[r + 1]]
            more = np.flatnonzero(n > 1)
            rows.append((int(r), *_gaps(k - (int(r) << low), form.low), more.astype(np.int32).tobytes(), n[more].astype(np.int32).tobytes()))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[i] for r in rows], pa.binary()) for i in range(1, 5))], names=["range", "gaps", "rest", "at", "more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for _, words, bounds in shingles.texts(batch.column(1)):
                for a, b in zip(bounds, bounds[1:]):
                    held.append(shingles.shingle_set(words[a:b], WIDTH))
                    size += len(held[-1])
                    if size > BLOCK_TOKENS:
                        yield out(held)
                        held, size = [], 0
        if size:
            yield out(held)

    return run


def _frequent_of(form: Layout):
    def run(table: pa.Table) -> pa.Table:
        places, counts = [], []
        for gaps, rest, at, more in zip(*(table.column(c).to_pylist() for c in ("gaps", "rest", "at", "more"))):
            places.append(_places(gaps, rest, form.low))
            n = np.ones(len(places[-1]), np.int64)
            n[np.frombuffer(at, np.int32)] = np.frombuffer(more, np.int32)
            counts.append(n)
        value, of = np.unique(np.concatenate(places), return_inverse=True)
        df = np.bincount(of, np.concatenate(counts)).astype(np.int64)
        hot = df >= LEAST
        keys = (np.int64(table.column("range")[0].as_py()) << (form.key - form.range)) + value[hot]
        return pa.table({"key": pa.array(keys, pa.int64()), "df": pa.array(df[hot], pa.int64())})

    return run


def frequent_tokens(docs: DataFrame, form: Layout, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """Sorted fingerprints of the most frequent tokens and their document frequencies."""
    packed = docs.mapInArrow(_packed(form), "range int, gaps binary, rest binary, at binary, more binary")
    found = scratch.write(packed.groupBy("range").applyInArrow(_frequent_of(form), "key long, df long"), "frequent")
    level = F.floor(F.log2("df") * 8)
    counts = sorted(((r["level"], r["n"]) for r in found.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()), reverse=True)  # at most 8 x 64 rows
    least, total = None, 0
    for of, n in counts:
        total += n
        if total > FREQUENT:
            break
        least = of
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kept = found.where(level >= least).toPandas().sort_values("key")  # at most FREQUENT rows
    return kept["key"].to_numpy(), kept["df"].to_numpy()


def need(n: int) -> int:
    """The least overlap of a set of n tokens with one that it links with."""
    return -(-4 * n // 5)


_SEEDS = np.random.Generator(np.random.PCG64(5)).integers(1, 1 << 63, 2 * BANDS, dtype=np.uint64) * U(2) + U(1)

PREFIX = "doc_id long, n long, d1 long, d2 long, rest long, last_df long, last_token long, typical double, bands array<long>, prefix array<long>"


def _prefixes(docs: DataFrame, form: Layout, keys: np.ndarray, dfs: np.ndarray) -> DataFrame:
    known = docs.sparkSession.sparkContext.broadcast((keys, dfs))  # at most FREQUENT of each

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, dfs = known.value
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows: list[tuple] = []
            for first, words, bounds in shingles.texts(batch.column(1)):
                for i, (a, b) in enumerate(zip(bounds, bounds[1:]), first):
                    t = shingles.shingle_set(words[a:b], WIDTH)
                    n = len(t)
                    if n == 0:
                        rows.append((ids[i], 0, 0, 0, 0, 0, 0, 0.0, [], []))
                        continue
                    df = np.zeros(n, np.int64)
                    if len(keys):
                        k = _key(t, form.key)
                        at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
                        df = np.where(keys[at] == k, dfs[at], 0)
                    signed = t.view(np.int64)
                    size = n - need(n) + 1
                    order = np.lexsort((signed, df))[:size]
                    low = (t[:, None] * _SEEDS).min(axis=0) if n <= 4096 else np.array([(t * s).min() for s in _SEEDS])
                    bands = shingles.mix(shingles.mix(low[0::2]) + low[1::2] + np.arange(BANDS, dtype=U)).view(np.int64)
                    with np.errstate(over="ignore"):
                        d1, d2 = shingles.mix(t).sum(), shingles.mix(t ^ U(0x5851F42D4C957F2D)).sum()
                    rows.append((ids[i], n, d1.astype(np.int64), d2.astype(np.int64), n - size, df[order[-1]], signed[order[-1]], float((df > 0).mean()), bands, signed[order]))
                if len(rows) > 2000:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    return docs.mapInArrow(run, PREFIX)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows))
    arrays = [pa.array(c, pa.int64()) for c in cols[:7]] + [pa.array(cols[7], pa.float64())]
    for c in cols[8:]:
        ends = np.cumsum([0, *map(len, c)], dtype=np.int32)
        values = np.concatenate([np.asarray(x, np.int64) for x in c]) if ends[-1] else np.zeros(0, np.int64)
        arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(values)))
    return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n", "d1", "d2", "rest", "last_df", "last_token", "typical", "bands", "prefix"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = []
        for name in ("ta", "tb"):
            of = []
            for _, words, bounds in shingles.texts(batch.column(batch.schema.get_field_index(name))):
                of += [shingles.shingle_set(words[a:b], WIDTH) for a, b in zip(bounds, bounds[1:])]
            sets.append(of)
        keep = []
        for x, y in zip(*sets, strict=True):
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(both > 0 and 100 * both >= 80 * (len(x) + len(y) - both))
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def verify(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets link.

    Documents that no pair names are left out before their texts move, by a filter of
    fixed size.
    """
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << FILTER_BITS))
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    bits = ids.select(slot.alias("slot")).groupBy(F.shiftright("slot", 15).alias("__bucket")).agg(F.bitmap_construct_agg(F.col("slot") % 32768).alias("__bits"))
    byte = F.conv(F.hex(F.substring(F.col("__bits"), (F.col("__at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    here = docs.withColumn("__slot", slot).withColumn("__at", (F.col("__slot") % 32768).cast("int"))
    here = here.join(F.broadcast(bits), F.shiftright("__slot", 15) == F.col("__bucket")).where(byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), (F.col("__at") % 8).cast("int"))) != 0)
    here = here.select("doc_id", "text")
    one = pairs.join(here.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
    two = one.join(here.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
    return two.select("a", "b", "ta", "tb").mapInArrow(_verified, "a long, b long").distinct()


def _ceil(x, y):
    return F.ceil(x / F.lit(float(y))).cast("long")


def join(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id): class_id is the smallest doc_id of the same set."""
    spark: SparkSession = df.sparkSession
    scratch = Scratch(spark, "jaccard")
    docs = df.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    docs, size = one_each(docs, scratch)
    form = layout(size)
    sets = scratch.write(_prefixes(docs, form, *frequent_tokens(docs, form, scratch)), "sets")
    light = ["doc_id", "n", "d1", "d2"]
    filled = sets.where("n > 0").select(*light)
    of_class = scratch.write(filled.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("c")), "of-class")
    classed = scratch.write(meet(filled, of_class, ["n", "d1", "d2"], filled.count()).select("doc_id", "n", "class_id"), "classes")
    reps = classed.where("doc_id = class_id").select("doc_id")
    heads = scratch.write(sets.where("n > 0").drop("d1", "d2", "prefix").join(reps, "doc_id", "left_semi"), "heads")

    # groups: links with the most typical document of a band
    banded = heads.select("doc_id", "n", "typical", F.explode("bands").alias("band"))
    lead = banded.groupBy("band").agg(F.max(F.struct("typical", (-F.col("doc_id")).alias("id"), "n")).alias("lead"), F.count("*").alias("c")).where("c > 1")
    starred = banded.join(lead, "band").select(F.col("doc_id").alias("a"), (-F.col("lead.id")).alias("b"), "n", F.col("lead.n").alias("m"))
    starred = starred.where((F.col("a") != F.col("b")) & (F.col("n") * 5 >= F.col("m") * 4) & (F.col("m") * 5 >= F.col("n") * 4)).select("a", "b").distinct()
    links = scratch.write(verify(scratch.write(starred, "starred"), docs), "star-links")
    grouped = scratch.write(components(links, scratch, "groups"), "grouped")
    size = grouped.groupBy("component").agg(F.count("*").alias("members"))
    member = grouped.join(size, "component").select(F.col("id").alias("doc_id"), F.col("component").alias("g"), "members")
    heads = heads.drop("typical", "bands").join(member, "doc_id", "left").withColumn("g", F.coalesce("g", "doc_id")).withColumn("members", F.coalesce("members", F.lit(1)))
    heads = scratch.write(heads, "members")

    # prefix tokens that more than one class has
    n_parts = max(shuffle_partitions(spark), 1)
    tokens = sets.where("n > 0").join(reps, "doc_id", "left_semi").select("doc_id", F.explode("prefix").alias("token"))
    tokens = tokens.repartition(n_parts, "token")
    common = tokens.groupBy("token").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y")).where("x != y").select("token")
    shared = scratch.write(tokens.join(common, "token", "left_semi"), "shared")
    # of these, tokens that more than one group has
    placed = shared.join(heads, "doc_id")
    apart = placed.groupBy("token").agg(F.min("g").alias("x"), F.max("g").alias("y")).where("x != y").select("token")
    entries = scratch.write(placed.join(apart, "token", "left_semi"), "entries")

    # the matrix, and the groups that a class may link into; of two groups the smaller one asks
    matrix = entries.groupBy("token", "g").agg(F.max("members").alias("members"))
    group = entries.groupBy("g").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("rest").alias("rest"), F.ceil(F.max("members") / CHUNK).alias("chunks"))
    ask = entries.select("token", F.col("doc_id").alias("q"), F.col("g").alias("qg"), F.col("members").alias("qm"))
    met = ask.join(matrix, "token").where((F.col("qm") < F.col("members")) | ((F.col("qm") == F.col("members")) & (F.col("qg") < F.col("g"))))
    met = met.groupBy("q", "g").agg(F.count("*").alias("c"))
    head = heads.select(F.col("doc_id").alias("q"), F.col("n").alias("qn"), F.col("rest").alias("qrest"), F.col("last_df").alias("qdf"), F.col("last_token").alias("qlast"))
    bounded = met.join(group, "g").join(head, "q")
    least = F.greatest("low", _ceil(F.col("qn") * 4, 5))
    most = F.col("c") + F.greatest("qrest", "rest")
    opened = bounded.where((F.col("high") * 5 >= F.col("qn") * 4) & (F.col("low") * 4 <= F.col("qn") * 5) & (most * 9 >= (F.col("qn") + least) * 4))
    opened = scratch.write(opened.select("q", "g", "chunks", "qn", "qrest", "qdf", "qlast"), "opened")

    # members of opened groups: the shared tokens of a class and of up to CHUNK members, counted row by row
    own = scratch.write(entries.groupBy("doc_id").agg(F.max("g").alias("g"), F.max("members").alias("members"), *(F.max(x).alias(x) for x in ("n", "rest", "last_df", "last_token")), F.collect_list("token").alias("tokens")), "own")
    chunk = F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("members") / CHUNK))
    theirs = own.groupBy("g", chunk.alias("chunk")).agg(F.collect_list(F.struct(F.col("doc_id").alias("s"), "n", "rest", "last_df", "last_token", "tokens")).alias("of"))
    asked = opened.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    ours = asked.join(own.select(F.col("doc_id").alias("q"), F.col("tokens").alias("qt")), "q")

    def reaches(s):
        """Whether member s may link with the class of the row: sizes, and the bound by whose prefix ends first."""
        first = F.struct(F.col("qdf").alias("last_df"), F.col("qlast").alias("last_token")) <= F.struct(s["last_df"].alias("last_df"), s["last_token"].alias("last_token"))
        c = F.size(F.array_intersect(s["tokens"], F.col("qt"))) + F.when(first, F.col("qrest")).otherwise(s["rest"])
        return (s["n"] * 5 >= F.col("qn") * 4) & (s["n"] * 4 <= F.col("qn") * 5) & (c * 9 >= (F.col("qn") + s["n"]) * 4)

    both = ours.join(theirs, ["g", "chunk"]).select("q", F.explode(F.transform(F.filter("of", reaches), lambda s: s["s"])).alias("s"))
    pairs = scratch.write(both.select(F.col("q").alias("a"), F.col("s").alias("b")), "pairs")
    more = scratch.write(verify(pairs, docs), "links")

    stars = links.unionByName(more)
    found = scratch.write(components(stars, scratch, "all"), "components")
    named = classed.join(found.select(F.col("id").alias("class_id"), "component"), "class_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "class_id").alias("component_id"), "class_id")
    empty = sets.where("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.col("doc_id").alias("class_id"))
    return named.unionByName(empty)


def sql() -> str:
    """join() of a table documents with distinct doc_ids, in DuckDB SQL, by all shared shingles."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
    with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x20\\x09-\\x0D]+') as w from documents where doc_id is not null),
    s as (select doc_id, case when len(w) = 0 then [] when len(w) < {WIDTH} then [array_to_string(w, ' ')]
      else list_distinct(list_transform(range(1, len(w) - {WIDTH} + 2), lambda i: array_to_string(w[i:i + {WIDTH - 1}], ' '))) end as s from w),
    t as (select doc_id, unnest(s) as t from s),
    n as (select doc_id, len(s) as n, list_sort(s) as k from s),
    pairs as (select a.doc_id as a, b.doc_id as b, count(*) as c from t a join t b on a.t = b.t and a.doc_id < b.doc_id group by 1, 2),
    links as (select a, b from pairs join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
    {REACHED}
    select doc_id, n::bigint as n_shingles, least(doc_id, coalesce(m, doc_id)) as component_id,
      case when n = 0 then doc_id else min(doc_id) over (partition by k) end as class_id
    from n left join least_ on a = doc_id
    """
