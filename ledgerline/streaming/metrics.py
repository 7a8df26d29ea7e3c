"""Metrics over a stream: windows of event time with a bound on lateness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import aggregate
from ..plans.model import PlanError


def windowed(stream: DataFrame, *, time: str, every: str, late: str, keys: list[str], measures: dict[str, tuple[str, str]], decimals: int | None = None) -> DataFrame:
    """One row for each window and keys, with measures name: (op, column).

    Rows later than late behind the newest are left out, and state is kept for no longer.
    Distinct counts need all values of a window, so they are refused. A batch frame gives
    what the stream gives once it has ended.
    """
    if any(op == "count_distinct" for op, _ in measures.values()):
        raise PlanError("no distinct counts over a stream")
    rows = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, every), *keys)
    out = rows.agg(*(aggregate(op, F.col(c), decimals if op in ("sum", "avg") else None).alias(n) for n, (op, c) in measures.items()))
    return out.select(F.col("window.start").alias("window_start"), *keys, *measures)
