"""Whether two results are the same, and how steady repeated answers are."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Difference:
    """Rows, counted as often as they occur, that only one of the results has."""

    left: int
    right: int
    reason: str = ""

    @property
    def same(self) -> bool:
        return not (self.left or self.right or self.reason)


def _plain(field: T.StructField, digits: int) -> Column:
    """A value as text that doesn't depend on the kind of number: 2, 2.0 and 2.00 are alike."""
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.NumericType):
        return F.format_string(f"%.{digits}f", F.round(c.cast("double"), digits) + F.lit(0.0))
    if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return c.cast("string")


def keyed(df: DataFrame, digits: int = 4) -> DataFrame:
    """(row, n): each row as one text by the order of its columns, whatever their names, and how often it occurs."""
    cells = [F.coalesce(F.concat(F.lit("="), _plain(f, digits)), F.lit("null")) for f in df.schema.fields]
    return df.select(F.to_json(F.array(*cells)).alias("row")).groupBy("row").agg(F.count("*").alias("n"))


def difference(left: DataFrame, right: DataFrame, *, digits: int = 4) -> Difference:
    """Compares results as bags of rows, by a grouped count of both: nothing is gathered or sorted."""
    if len(left.columns) != len(right.columns):
        return Difference(0, 0, f"{len(left.columns)} and {len(right.columns)} columns")
    both = keyed(left, digits).withColumn("by", F.lit(1)).unionByName(keyed(right, digits).withColumn("by", F.lit(-1)))
    more = both.groupBy("row").agg(F.sum(F.col("n") * F.col("by")).alias("d"))
    found = more.agg(*(F.coalesce(F.sum(F.greatest(F.col("d") * s, F.lit(0))), F.lit(0)).alias(f"s{i}") for i, s in enumerate((1, -1)))).first()
    return Difference(int(found[0]), int(found[1]))


def in_order(left: DataFrame, right: DataFrame, *, digits: int = 4, longest: int = 10_000) -> bool:
    """Whether two short ordered results, as top-k reports are, agree row by row."""
    rows = [[tuple(r) for r in df.select(*(_plain(f, digits) for f in df.schema.fields)).limit(longest + 1).collect()] for df in (left, right)]
    if max(map(len, rows)) > longest:
        raise ValueError(f"over {longest} rows")
    return rows[0] == rows[1]


def result_key(df: DataFrame, *, digits: int = 4) -> str:
    """One text for equal results, whatever the order of rows."""
    row = keyed(df, digits).agg(F.coalesce(F.sum("n"), F.lit(0)), *(F.coalesce(F.bit_xor(F.xxhash64(F.lit(i), "row", "n")), F.lit(0)) for i in (1, 2))).first()
    return f"{len(df.columns)}-{row[0]}-{row[1] & (1 << 64) - 1:016x}{row[2] & (1 << 64) - 1:016x}"


def steadiness(runs: DataFrame, *, question: str = "question", key: str = "key", correct: str = "correct", refused: str = "refused") -> DataFrame:
    """For each question its runs, how many were right or refused, its different results, and the share of pairs of runs that agree.

    A run that was refused agrees with none. Counted by (question, key) first, so no question's runs are gathered.
    """
    flag = lambda c: F.sum(F.when(F.col(c), 1).otherwise(0))
    by_key = runs.groupBy(question, key).agg(F.count("*").alias("n"), flag(correct).alias("right"), flag(refused).alias("no"))
    answered = F.col("n") - F.col("no")
    out = by_key.groupBy(question).agg(
        F.sum("n").alias("runs"), F.sum("right").alias("correct"), F.sum("no").alias("refused"),
        F.count(F.when(answered > 0, 1)).alias("results"), F.sum(answered * (answered - 1)).alias("agree"),
    )
    pairs = F.col("runs") * (F.col("runs") - 1)
    return out.select(question, "runs", "correct", "refused", "results", F.when(pairs > 0, F.col("agree") / pairs).alias("agreement"))
