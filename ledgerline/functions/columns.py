"""Column functions with the semantics that plans promise."""

from __future__ import annotations

import calendar
import datetime
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.model import PlanError


def divide(a: Column, b: Column) -> Column:
    """Real division; null where the divisor is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def coerce(value: Any, type_: str) -> Any:
    """A literal as an attribute's type; what isn't one is refused, before the data are touched."""
    if value is None or isinstance(value, (list, tuple)):
        return value if value is None else [coerce(v, type_) for v in value]
    try:
        if type_ in ("numeric", "integer"):
            if isinstance(value, bool):
                raise ValueError
            number = float(value)
            return int(value) if type_ == "integer" and number.is_integer() else number
        if type_ == "boolean":
            if not isinstance(value, bool):
                raise ValueError
            return value
        if type_ == "date" and not isinstance(value, datetime.date):
            return datetime.date.fromisoformat(str(value)[:10])
        if type_ == "datetime" and not isinstance(value, datetime.datetime):
            return datetime.datetime.fromisoformat(str(value))
    except ValueError as e:
        raise PlanError(f"{value!r} is no {type_}") from e
    return str(value) if type_ == "string" else value


def predicate(column: Column, op: str, value: Any, type_: str = "string") -> Column:
    """One comparison with literals. LIKE doesn't mind case; equality with null means is null."""
    if type_ == "date":
        column = F.to_date(column)
    if op == "LIKE":
        return column.cast("string").ilike(str(value))
    value = coerce(value, type_)
    if op == "IN":
        return column.isin(list(value))
    if op == "BETWEEN":
        return column.between(F.lit(value[0]), F.lit(value[1]))
    if value is None and op in ("=", "!="):
        return column.isNull() if op == "=" else column.isNotNull()
    right = F.lit(value)
    return {"=": column == right, "!=": column != right, "<": column < right, "<=": column <= right, ">": column > right, ">=": column >= right}[op]


def period(text: str) -> tuple[datetime.date, datetime.date]:
    """First and last day of a year, a month (2024-02) or a day."""
    try:
        parts = [int(x) for x in str(text).split("-")]
        if len(parts) == 1:
            return datetime.date(parts[0], 1, 1), datetime.date(parts[0], 12, 31)
        if len(parts) == 2:
            return datetime.date(*parts, 1), datetime.date(*parts, calendar.monthrange(*parts)[1])
        return datetime.date(*parts), datetime.date(*parts)
    except (ValueError, TypeError, calendar.IllegalMonthError) as e:
        raise PlanError(f"no period: {text}") from e


def aggregate(op: str, value: Column, decimals: int | None = None) -> Column:
    """One aggregate. With decimals, sums and means are exact and don't depend on order."""
    exact = value if decimals is None else value.cast(f"decimal(18,{decimals})")
    if op == "sum":
        return F.sum(exact).cast("double") if decimals is not None else F.sum(value)
    if op == "avg":
        return divide(F.sum(exact), F.count(value))
    return {"count": F.count, "min": F.min, "max": F.max, "count_distinct": F.count_distinct}[op](value)


def combine(op: str, parts: list[Column]) -> Column:
    if op == "divide":
        return divide(*parts)
    out = parts[0]
    for p in parts[1:]:
        out = out + p if op == "add" else out - p if op == "subtract" else out * p
    return out
