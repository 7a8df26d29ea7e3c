"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only.

Two lines are the same if their words are equal, or differ by one edit (a word put in, left
out or replaced) that is at most one in ``min_words`` of the longer line's words. The rate is
part of what "same" means: one edit in a line of two words leaves another line. Every
line that is the same as an earlier one goes; the earliest stays. "Same" isn't carried on: a
line goes for an earlier one within the bound, whether or not that one stays.

Lines are ordered by doc_id, row and line number. A row is known by its doc_id and a hash of its
text, so rows that repeat a doc_id with other texts are documents of their own, in the order of
these hashes.

1. Lines become 128-bit digests; a grouped minimum finds each one's earliest place. Lines that are
   over 1 in ``common.HOT`` of all, fewer than that in any table, meet theirs by broadcast, so
   their copies stay where they are.
2. Of two lines within the bound, either the first or the second half of the words is
   untouched, so a line whose halves (cut as for its own length and for one word less)
   are shared with no other is left out here, losing nothing.
3. The rest emit the hashed key of each variant with one word deleted, and their own. A key is a sum
   over pairs of neighbouring words, so it costs the same for any length of line. Keys of one
   line go. Lines with equal keys at the same place differ in the word there: each is compared
   with the group's earliest only. A full line with the key of a longer line's variant is that
   line with a word left out.
4. Every pair that a key brings is verified word by word.

Keys of 61 to 64 bits can collide by chance: a false pair is refused by the check, and the chance
that one hides a true pair is of the order of lines x words / 2^61.

Defined results: lines without a word, and null texts, are kept as they are. Rows of one
doc_id with different texts each lose what an earlier row has, and nothing else; rows of one
doc_id with the same text can't be told apart and are one document, kept alike. Rows of a null
doc_id come after all others and lose lines like them. A document all of whose lines with words
went is reported with ``emptied`` true. Other columns are kept; n_lines, n_removed and emptied
replace ones of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, Scratch, meet, words

MIN_WORDS = 8
BREAK = "\n"


#: What a line's place is made of, in order: the row's doc_id and hash, and the number of the line.
ROW = ["id", "row"]
PLACE = [*ROW, "line_no"]


def _row(doc_id: str, text: str) -> list[Column]:
    """What a row is known by, in the order of rows: null doc_ids last, rows of a doc_id by their texts' hashes."""
    one = F.col(doc_id).cast("long")
    return [F.coalesce(one, F.lit((1 << 63) - 1)).alias("id"), F.xxhash64(one.isNull(), F.coalesce(F.col(text), F.lit(""))).alias("row")]


def _lines(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The place, words with one space between (c) and their number (n) of every line that has a word."""
    cut = df.select(*_row(doc_id, text), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), BREAK)).alias("line_no", "line"))
    flat = F.col("line")
    for blank in BLANKS.replace(" ", "").replace(BREAK, ""):
        flat = F.replace(flat, F.lit(blank), F.lit(" "))
    bare = cut.select(*PLACE, F.trim(flat).alias("c")).where("c <> ''")
    wide = F.array_join(F.array_remove(F.split("c", " "), ""), " ")
    one = bare.withColumn("c", F.when(F.instr("c", "  ") > 0, wide).otherwise(F.col("c")))
    return one.withColumn("n", F.octet_length("c") - F.octet_length(F.replace(F.col("c"), F.lit(" "))) + 1)


def _halves() -> Column:
    """Hashes of both halves of a line of n words c, as such and as the longer one of n - 1."""
    parts = []
    for less in (0, 1):
        short = F.col("n") - less
        first = F.floor(short / 2).cast("int")
        parts.append(F.xxhash64(short, F.lit(0), F.call_function("substring_index", "c", F.lit(" "), first)))
        parts.append(F.xxhash64(short, F.lit(1), F.call_function("substring_index", "c", F.lit(" "), first - short)))
    return F.array(*parts)


#: Keys are sums modulo 2^61, so that none overflows.
MASK = (1 << 61) - 1


def _keys(lines: DataFrame) -> DataFrame:
    """lines (a place, w, n) with full, the key of the line, and cut, those of its variants.

    A key is the sum of hashes of neighbouring words, with a mark before the first and after
    the last; a variant's takes two of them away and adds the one of the words that meet.
    """
    mark = F.array(F.lit(0).cast("long"))
    one = lines.withColumn("__h", F.concat(mark, F.transform("w", lambda x: F.xxhash64(x)), mark))
    masked = lambda x: x.bitwiseAND(F.lit(MASK))
    pairs = F.zip_with(F.slice("__h", F.lit(1), F.col("n") + 1), F.slice("__h", F.lit(2), F.col("n") + 1), lambda a, b: masked(F.xxhash64(a, b)))
    over = F.zip_with(F.slice("__h", F.lit(1), F.col("n")), F.slice("__h", F.lit(3), F.col("n")), lambda a, b: masked(F.xxhash64(a, b)))
    two = one.select(*PLACE, "w", "n", pairs.alias("__p"), over.alias("__o"))
    three = two.withColumn("full", F.aggregate("__p", F.lit(0).cast("long"), lambda a, x: masked(a + x)))
    taken = F.zip_with("__o", "__p", lambda o, p: o - p)
    cut = F.zip_with(taken, F.slice("__p", F.lit(2), F.col("n")), lambda a, p: masked(F.col("full") + a - p + F.lit(MASK + 1)))
    return three.withColumn("cut", cut).drop("__p", "__o")


def _within_one(a: Column, b: Column) -> Column:
    """Whether arrays a and b differ by one edit at most: what follows the first difference is equal."""
    short, long_ = F.when(F.size(a) <= F.size(b), a).otherwise(b), F.when(F.size(a) <= F.size(b), b).otherwise(a)
    at = F.array_position(F.zip_with(short, long_, lambda x, y: x.eqNullSafe(y)), F.lit(False)).cast("int")
    tail = lambda w, start: F.slice(w, start, F.greatest(F.size(w) - start + 1, F.lit(0)))
    at = F.greatest(at, F.lit(1))
    same = F.size(a) == F.size(b)
    return F.when(same, tail(a, at + 1) == tail(b, at + 1)).when(F.abs(F.size(a) - F.size(b)) == 1, tail(short, at) == tail(long_, at + 1)).otherwise(F.lit(False))


def repeats(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(id, row, line_no) of every line that goes, first: the place of an earlier one, and exact. See _row for id and row."""
    scratch = Scratch(df.sparkSession, "line-dedup")
    place = F.struct(*PLACE)
    lines = _lines(df, doc_id, text)
    digest = lines.select(*PLACE, F.xxhash64("c").alias("k1"), F.xxhash64(F.lit(1), F.col("c")).alias("k2"), F.when(F.col("n") >= min_words - 1, _halves()).alias("halves"))
    digest = scratch.write(digest, "digest")
    key = ["k1", "k2"]
    first = scratch.write(digest.groupBy(*key).agg(F.min(place).alias("first"), F.count("*").alias("c")).where("c > 1"), "first")
    equal = meet(digest.select(*PLACE, *key), first, key, digest.count()).where(place != F.col("first"))
    equal = scratch.write(equal.select(*PLACE, "first"), "equal")

    # distinct lines that share a half with another one
    gone = equal.select(*PLACE)
    alone = digest.where(F.col("halves").isNotNull()).join(gone, PLACE, "left_anti").select(*PLACE, F.explode("halves").alias("h"))
    shared = alone.groupBy("h").count().where("count > 1").select("h")
    near = scratch.write(alone.join(shared, "h", "left_semi").select(*PLACE).distinct(), "near")
    wanted = near.groupBy(*ROW).agg(F.collect_set("line_no").alias("__wanted"))
    texts = df.select(*_row(doc_id, text), F.col(text).alias("text")).join(wanted.hint("shuffle_hash"), ROW)
    # a line is taken by its number from a column, so a text of many lines costs no search for each
    cut = texts.withColumn("parts", F.split(F.coalesce("text", F.lit("")), BREAK)).where(F.size("parts") > 0)
    cut = cut.select(*ROW, F.explode(F.transform("__wanted", lambda i: F.struct(i.alias("line_no"), F.get("parts", i).alias("line")))).alias("l"))
    found = cut.select(*ROW, "l.line_no", words(F.col("l.line")).alias("w")).dropDuplicates(PLACE)
    keyed = scratch.write(_keys(found.withColumn("n", F.size("w"))), "keyed")

    # equal variants: replaced words meet at the same place, a word left out meets the full line
    whole = keyed.select(*PLACE, F.lit(-1).alias("i"), F.xxhash64("n", "full").alias("key"))
    variants = keyed.select(*PLACE, F.posexplode(F.transform("cut", lambda k: F.xxhash64(F.col("n") - 1, k))).alias("i", "key"))
    every = whole.unionByName(variants)
    line = F.xxhash64(*PLACE)  # a line of equal words has one key many times
    shared = every.groupBy("key").agg(F.min(line).alias("x"), F.max(line).alias("z")).where("x <> z").select("key")
    met = scratch.write(every.join(shared, "key", "left_semi"), "met")
    starred = met.where("i >= 0").groupBy("key", "i").agg(F.min(place).alias("first"))
    replaced = met.join(starred, ["key", "i"]).where(place != F.col("first")).select(place.alias("a"), F.col("first").alias("b"))
    full = met.where("i < 0").select(place.alias("a"), "key")
    longer = met.where("i >= 0").select(place.alias("b"), "key")
    left_out = full.join(longer, "key").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    pairs = scratch.write(replaced.unionByName(left_out).distinct(), "pairs")
    w = keyed.select(place.alias("p"), "w", "n")
    checked = pairs.join(w.select(F.col("p").alias("a"), F.col("w").alias("wa"), F.col("n").alias("na")), "a").join(w.select(F.col("p").alias("b"), F.col("w").alias("wb"), F.col("n").alias("nb")), "b")
    checked = checked.where((F.greatest("na", "nb") >= min_words) & _within_one(F.col("wa"), F.col("wb")))
    fuzzy = scratch.write(checked.groupBy("a").agg(F.min("b").alias("b")), "fuzzy")

    # a line goes for its equal earlier one, or as its earliest equal one goes for a still earlier line
    exact = equal.select(*PLACE, F.col("first"), F.lit(True).alias("exact"))
    alike = fuzzy.select("a.*", F.col("b").alias("first"), F.lit(False).alias("exact"))
    return exact.unionByName(alike)


def dedup(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """df with its text without the lines that go, and n_lines, n_removed and emptied."""
    gone = repeats(df, doc_id=doc_id, text=text, min_words=min_words)
    by_row = gone.groupBy(F.col("id").alias("__i"), F.col("row").alias("__r")).agg(F.collect_set("line_no").alias("__gone"))
    of, row = _row(doc_id, text)
    joined = df.withColumns({"__id": of, "__row": row}).join(by_row.hint("shuffle_hash"), (F.col("__id") == F.col("__i")) & (F.col("__row") == F.col("__r")), "left")
    joined = joined.withColumn("__parts", F.when(F.col("__gone").isNotNull(), F.split(F.col(text), BREAK)))
    stay = F.transform(F.array_except(F.sequence(F.lit(0), F.size("__parts") - 1), "__gone"), lambda i: F.get("__parts", i))
    kept = [c for c in df.columns if c not in (text, "n_lines", "n_removed", "emptied")]
    out = joined.select(*kept, F.when(F.col("__gone").isNull(), F.col(text)).otherwise(F.array_join(stay, BREAK)).alias(text), F.when(F.col(text).isNull(), 0).otherwise(F.length(F.col(text)) - F.length(F.replace(F.col(text), F.lit(BREAK))) + 1).cast("long").alias("n_lines"), F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_removed"))
    empty = (F.col("n_removed") > 0) & (F.length(F.translate(F.col(text), " \t\n\x0b\x0c\r", "")) == 0)
    return out.withColumn("emptied", F.coalesce(empty, F.lit(False)))


def sql(min_words: int = MIN_WORDS) -> str:
    """dedup() of a table documents with distinct doc_ids, in DuckDB SQL."""
    gap = r"[\x20\x09-\x0D]+"
    half = lambda n: f"{{'n': {n}, 'side': 0, 'w': w[:({n}) // 2]}}, {{'n': {n}, 'side': 1, 'w': w[n - (({n}) - ({n}) // 2) + 1:]}}"
    return f"""
    with cut as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no from documents),
    w as (select doc_id, line_no, list_filter(regexp_split_to_array(line, '{gap}'), lambda x: x <> '') as w from cut),
    l as (select doc_id, line_no, w, len(w) as n, {{'d': doc_id, 'l': line_no}} as p from w where len(w) > 0),
    first as (select w, n, min(p) as p from l group by w, n),
    keys as (select p, w, unnest([{half('n')}, {half('n - 1')}]) as k from first where n >= {min_words - 1}),
    pairs as (select distinct a.p as p, a.w as a, b.w as b from keys a join keys b on a.k = b.k and b.p < a.p where greatest(len(a.w), len(b.w)) >= {min_words}),
    sides as (select p, case when len(a) <= len(b) then a else b end as s, case when len(a) <= len(b) then b else a end as t from pairs),
    near as (select distinct p from sides where
      case len(t) - len(s) when 0 then len(list_filter(range(1, len(s) + 1), lambda i: s[i] <> t[i])) <= 1
        when 1 then list_bool_or(list_transform(range(1, len(t) + 1), lambda i: list_concat(t[:i - 1], t[i + 1:]) = s)) else false end),
    gone as (select l.doc_id, l.line_no from l join first using (w) where l.p <> first.p union select p.d, p.l from near),
    marked as (select c.*, g.doc_id is not null as went from cut c left join gone g on c.doc_id = g.doc_id and c.line_no = g.line_no),
    out as (select doc_id, count(*) as n_lines, count(*) filter (where went) as n_removed, coalesce(string_agg(line, chr(10) order by line_no) filter (where not went), '') as kept from marked group by doc_id),
    whole as (select d.doc_id, coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_removed, 0)::bigint as n_removed, case when coalesce(n_removed, 0) = 0 then text else kept end as text from documents d left join out o on d.doc_id = o.doc_id)
    select doc_id, n_lines, n_removed, n_removed > 0 and regexp_replace(coalesce(text, ''), '{gap}', '', 'g') = '' as emptied, sha256(coalesce(text, '')) as text_sha256, text from whole
    """
