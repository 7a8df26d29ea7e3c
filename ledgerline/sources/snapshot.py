"""Tables as they are: a digest of their contents, and answers that are kept for it."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table_digest(df: DataFrame) -> str:
    """The same for the same rows in any order; one pass with partial aggregation, columns by name."""
    columns = sorted(df.columns)
    types = dict(df.dtypes)
    hashes = [F.xxhash64(F.lit(salt), *(F.col(f"`{c}`") for c in columns)) for salt in (1, 2)]
    row = df.agg(F.count("*"), *(F.bit_xor(h) for h in hashes), F.sum(F.pmod(hashes[0], F.lit(1 << 20)))).first()
    return hashlib.sha256(repr(([(c, types[c]) for c in columns], tuple(row))).encode()).hexdigest()[:16]


class Snapshot:
    """Views of a session over some tables. Answers are kept by the tables' digest, the statement and its parameters."""

    def __init__(self, spark: SparkSession, tables: Callable[[str], DataFrame], names: set[str], *, longest: int = 10_000) -> None:
        self.spark, self.tables, self.names, self.longest = spark, tables, frozenset(names), longest
        self._digest: str | None = None
        self._kept: dict[tuple, tuple[tuple, ...]] = {}

    @property
    def digest(self) -> str:
        if self._digest is None:
            self._digest = hashlib.sha256("".join(f"{n}:{table_digest(self.tables(n))};" for n in sorted(self.names)).encode()).hexdigest()[:16]
        return self._digest

    def renew(self) -> None:
        """Look at the tables again: answers are given anew if they have changed."""
        self._digest = None

    def has(self, table: str) -> bool:
        return table.lower() in {n.lower() for n in self.names}

    def frame(self, sql: str, **parameters) -> DataFrame:
        for n in self.names:
            self.tables(n).createOrReplaceTempView(n)
        return self.spark.sql(sql, args=parameters or None)

    def rows(self, sql: str, **parameters) -> tuple[tuple, ...]:
        """The rows of a short answer; a longer one than ``longest`` is refused, as it would be gathered here."""
        key = (self.digest, sql, tuple(sorted(parameters.items())))
        if key not in self._kept:
            found = self.frame(sql, **parameters).limit(self.longest + 1).collect()
            if len(found) > self.longest:
                raise ValueError(f"over {self.longest} rows; use frame()")
            self._kept[key] = tuple(map(tuple, found))
        return self._kept[key]
