"""Quality rules with robust multivariate outliers, in DataFrame functions only.

Base rules count words, symbols, repeated lines and repeated words of each whole text.
What passes them becomes a vector of transformed statistics; for each language and
source the minimum covariance determinant estimate of place and spread is made by
concentration steps from coordinate-wise medians, and a vector is rejected whose
Mahalanobis distance is beyond the cut.

Everything by group is a grouped sum or count with partial aggregation: medians are read from
histograms, and the subset of a concentration step is cut at a bin of a histogram of distances, so
no group's rows are sorted or gathered, whatever its share. Covariances are factored (Cholesky) in
columns of the small table of groups.

A group's covariance counts with its rows, and that of all groups about their own places with
``SHARED`` rows beside it, so a group of any size has an estimate and a small one leans on the others;
its place is always its own. So a document that is alone in its group is kept, and there is no size
from which on groups are treated otherwise.

Defined results: a null text has no words. Null language and source are values of their own. Each
statistic's spread has a floor (``FLOORS``), so one that is constant in a group doesn't reject
the first document that differs a little. Equal rows have equal results, and rows at the same
distance go into a subset together. Repeated rows count each for itself. Reruns agree but for the
rounding of sums in another order. Other columns are kept and new columns replace ones of the same
name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, words

SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ"
#: Rows that the covariance of all groups counts for beside a group's own.
SHARED = 30
STEPS = 4
#: Bins to a unit of a statistic when medians are read.
FINE = 64
#: Part of a group's rows that a concentration step keeps: half, so that up to nearly half may be junk.
KEEP = 0.5
#: Bins of a factor e of squared distance.
BINS = 64
#: The least standard deviation of each transformed statistic.
FLOORS = (0.5, 0.1, 0.2, 0.7, 1.0, 0.25)
#: Chi-square with six degrees of freedom at one half, and squared distance beyond which a vector is rejected.
HALF, CUT = 5.348, 50.0
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
P = len(FLOORS)


def statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """df without its text, with the base counts, n_capitals, n_lines and base_failed."""
    kept = [c for c in df.columns if c not in (text, "n_capitals", "n_lines", *BASE)]
    body = F.coalesce(F.col(text), F.lit(""))
    bare = F.translate(body, " \t\n\x0b\x0c\r", "")
    full = F.filter(F.split(body, "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0)
    without = lambda s: F.length(body) - F.length(F.translate(body, s, ""))
    one = df.select(*kept, words(body).alias("__w"), full.alias("__l"), F.length(bare).cast("long").alias("word_chars"), without(SYMBOLS).cast("long").alias("n_symbols"), without(CAPITALS).cast("long").alias("n_capitals"))
    two = one.select(
        *kept, "word_chars", "n_symbols", "n_capitals", F.size("__w").cast("long").alias("n_words"), F.size("__l").cast("long").alias("n_lines"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("__w") >= 3, F.transform(F.sequence(F.lit(0), F.size("__w") - 3), lambda i: F.xxhash64(F.get("__w", i), F.get("__w", i + 1), F.get("__w", i + 2)))).alias("__h"),
    )
    # where windows recur, sort them by hash: those beside an equal one recur
    three = two.withColumn("__s", F.when(F.size(F.array_distinct("__h")) < F.size("__h"), F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("__h")
    twice = F.filter("__s", lambda x, i: (F.get("__s", i - 1)["h"] == x["h"]) | (F.get("__s", i + 1)["h"] == x["h"]))
    four = three.withColumn("__p", F.sort_array(F.transform(twice, lambda x: x["i"]))).drop("__s")
    covered = F.aggregate(
        "__p", F.struct(F.lit(-10).alias("at"), F.lit(0).alias("n")),
        lambda a, x: F.struct(x.alias("at"), (a["n"] + F.least(F.lit(3), x - a["at"])).alias("n")), lambda a: a["n"],
    )
    five = four.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("__p")
    return five.withColumn("base_failed", (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50))


def vector() -> list[Column]:
    """The transformed statistics: length, word length, symbols, repeated lines, repeated words, capitals."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [
        F.log(n),
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n),
        F.log1p(F.col("n_symbols") * 20 / n),
        F.log1p(F.col("n_dup_lines") * 10 / F.greatest(F.col("n_lines"), F.lit(1))),
        F.log1p(F.col("n_repeat_words") * 20 / n),
        F.log1p(F.col("n_capitals") * 20 / F.greatest(F.col("word_chars"), F.lit(1))),
    ]


X = [f"__x{i}" for i in range(P)]
M = [f"__m{i}" for i in range(P)]
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
L = {(i, j): f"__l{i}_{j}" for i, j in PAIRS}


def _distance(df: DataFrame) -> DataFrame:
    """df with __d2 of its vector from its group's place by its group's factor."""
    for i in range(P):
        rest = F.col(X[i]) - F.col(M[i])
        for j in range(i):
            rest = rest - F.col(L[i, j]) * F.col(f"__y{j}")
        df = df.withColumn(f"__y{i}", rest / F.col(L[i, i]))
    total = sum((F.col(f"__y{i}") * F.col(f"__y{i}") for i in range(1, P)), F.col("__y0") * F.col("__y0"))
    return df.withColumn("__d2", total).drop(*(f"__y{i}" for i in range(P)))


def _factor(moments: DataFrame) -> DataFrame:
    """Per group the place and the Cholesky factor of the covariance, its diagonal at the floors at least."""
    df = moments
    for i in range(P):
        df = df.withColumn(M[i], F.col(f"__s{i}") / F.col("__n"))
    for i, j in PAIRS:
        df = df.withColumn(f"__v{i}_{j}", F.col(f"__q{i}_{j}") - F.col(M[i]) * F.col(M[j]) * F.col("__n"))
    every = df.agg(*((F.sum(f"__v{i}_{j}") / F.sum("__n")).alias(f"__p{i}_{j}") for i, j in PAIRS))
    df = df.crossJoin(F.broadcast(every))  # one row
    for i, j in PAIRS:
        cov = (F.col(f"__v{i}_{j}") + F.col(f"__p{i}_{j}") * SHARED) / (F.col("__n") + SHARED)
        df = df.withColumn(f"__c{i}_{j}", cov + F.lit(FLOORS[i] ** 2) if i == j else cov)
    for i in range(P):
        for j in range(i + 1):
            rest = F.col(f"__c{i}_{j}")
            for k in range(j):
                rest = rest - F.col(L[i, k]) * F.col(L[j, k])
            df = df.withColumn(L[i, j], F.sqrt(F.greatest(rest, F.lit(1e-6))) if i == j else rest / F.col(L[j, j]))
    return df.select("__g", *M, *L.values())


def _moments(df: DataFrame) -> DataFrame:
    sums = [F.sum(X[i]).alias(f"__s{i}") for i in range(P)]
    return df.groupBy("__g").agg(F.count("*").alias("__n"), *sums, *(F.sum(F.col(X[i]) * F.col(X[j])).alias(f"__q{i}_{j}") for i, j in PAIRS))


def _bin() -> Column:
    return F.floor(F.log(F.col("__d2") + 1e-9) * BINS).cast("int")


def _cut_at(df: DataFrame, part: float) -> DataFrame:
    """Per group the first bin up to which part of its rows lie."""
    counts = df.groupBy("__g", _bin().alias("__b")).agg(F.count("*").alias("__k"))
    w = Window.partitionBy("__g").orderBy("__b")
    run = counts.withColumn("__run", F.sum("__k").over(w)).withColumn("__all", F.sum("__k").over(Window.partitionBy("__g")))
    return run.where(F.col("__run") >= F.col("__all") * part).groupBy("__g").agg(F.min("__b").alias("__cut"))


def _medians(df: DataFrame, values: list[Column], names: list[str]) -> DataFrame:
    """Per group the medians of values, to a bin of 1 / FINE, by names."""
    bins = F.array(*(F.struct(F.lit(i).alias("__k"), F.floor(v * FINE).cast("int").alias("__b")) for i, v in enumerate(values)))
    counts = df.select("__g", F.explode(bins).alias("__z")).groupBy("__g", "__z.__k", "__z.__b").agg(F.count("*").alias("__c"))
    of = Window.partitionBy("__g", "__k")
    run = counts.withColumn("__run", F.sum("__c").over(of.orderBy("__b"))).withColumn("__all", F.sum("__c").over(of))
    at = run.where(F.col("__run") * 2 >= F.col("__all")).groupBy("__g", "__k").agg(((F.min("__b") + 0.5) / FINE).alias("__m"))
    return at.groupBy("__g").agg(*(F.max(F.when(F.col("__k") == i, F.col("__m"))).alias(n) for i, n in enumerate(names)))


def robust(df: DataFrame, scratch: Scratch, steps: int = STEPS) -> DataFrame:
    """df, which has __g and the vector, with __d2 scaled to a chi-square's median."""
    middle = scratch.write(_medians(df, [F.col(x) for x in X], M), "middle")
    away = _medians(df.join(middle, "__g"), [F.abs(F.col(X[i]) - F.col(M[i])) for i in range(P)], [f"__a{i}" for i in range(P)])
    start = middle.join(away, "__g")
    for i, j in PAIRS:
        start = start.withColumn(L[i, j], F.sqrt((F.col(f"__a{i}") * 1.4826) ** 2 + FLOORS[i] ** 2) if i == j else F.lit(0.0))
    groups = scratch.write(start.select("__g", *M, *L.values()), "step0")
    for step in range(steps):
        near = _distance(df.join(groups, "__g"))
        cuts = scratch.write(_cut_at(near, KEEP), f"cuts{step}")
        inside = near.join(cuts, "__g").where(_bin() <= F.col("__cut"))
        groups = scratch.write(_factor(_moments(inside)), f"step{step + 1}")
    near = _distance(df.join(groups, "__g"))
    half = scratch.write(_cut_at(near, 0.5), "half")
    scale = F.greatest(F.exp((F.col("__cut") + 1) / BINS) / HALF, F.lit(1.0))
    return near.join(half, "__g").withColumn("__d2", F.col("__d2") / scale).drop("__cut", *M, *L.values())


def judge(df: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", cut: float = CUT) -> DataFrame:
    """df without its text, with the base counts, base_failed, distance2 (null: not measured) and kept."""
    scratch = Scratch(df.sparkSession, "quality-rules")
    base = statistics(df, text)
    kept = [c for c in base.columns if c not in ("distance2", "kept")]
    base = scratch.write(base.select(*kept), "base")
    group = F.to_json(F.struct(F.col(lang).alias("l"), F.col(source).alias("s")))  # nulls are left out, so they are values of their own
    ok = base.where(~F.col("base_failed")).select(*kept, group.alias("__g"), *(x.alias(n) for n, x in zip(X, vector(), strict=True)))
    measured = robust(ok, scratch).select(*kept, F.col("__d2").alias("distance2"))
    failed = base.where("base_failed").withColumn("distance2", F.lit(None).cast("double"))
    return measured.unionByName(failed).withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance2") <= cut, F.lit(True)))
