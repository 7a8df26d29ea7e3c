"""The plan: what is asked, over concepts, before anything is joined."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field, replace
from typing import Any

from .graph import Path
from .model import COMBINES, OPERATIONS, Model, PlanError

COMPARISONS = ("=", "!=", "<", "<=", ">", ">=", "LIKE", "IN", "BETWEEN")


@dataclass(frozen=True)
class Projection:
    #: Index of a path of the plan, or null for the subject itself.
    path: int | None = None
    attribute: str | None = None


@dataclass(frozen=True)
class Measure:
    """A governed metric, an aggregation of an attribute, or a combination of measures."""

    metric: str | None = None
    aggregation: str | None = None
    attribute: str | None = None
    combine: str | None = None
    parts: tuple[Measure, ...] = ()
    path: int | None = None
    over: str | None = None

    def __post_init__(self) -> None:
        if sum(map(bool, (self.metric, self.aggregation, self.combine))) != 1:
            raise PlanError("a measure is a metric, an aggregation or a combination")
        if self.aggregation and self.aggregation not in OPERATIONS:
            raise PlanError(f"no aggregation {self.aggregation}")
        if self.combine and (self.combine not in COMBINES or len(self.parts) < 2 or (self.combine in ("subtract", "divide") and len(self.parts) != 2)):
            raise PlanError(f"{self.combine} of {len(self.parts)} measures")
        if self.over and (self.over not in OPERATIONS or self.over == "count_distinct"):
            raise PlanError(f"over {self.over}")


@dataclass(frozen=True)
class Filter:
    attribute: str
    op: str
    value: Any
    path: int | None = None

    def __post_init__(self) -> None:
        if self.op not in COMPARISONS:
            raise PlanError(f"no comparison {self.op}")
        if self.op == "IN" and not self.value:
            raise PlanError("IN an empty list")
        if self.op == "BETWEEN" and (not isinstance(self.value, (list, tuple)) or len(self.value) != 2):
            raise PlanError("BETWEEN two bounds")


@dataclass(frozen=True)
class Having:
    measure: int
    op: str
    value: Any

    def __post_init__(self) -> None:
        if self.op not in COMPARISONS[:7]:
            raise PlanError(f"no comparison of measures: {self.op}")


@dataclass(frozen=True)
class Top:
    limit: int | None = None
    projection: int | None = None
    measure: int | None = None
    descending: bool = True

    def __post_init__(self) -> None:
        if (self.projection is None) == (self.measure is None):
            raise PlanError("order by one projection or one measure")


@dataclass(frozen=True)
class Plan:
    subject: str
    paths: tuple[Path, ...] = ()
    projections: tuple[Projection, ...] = ()
    measures: tuple[Measure, ...] = ()
    filters: tuple[Filter, ...] = ()
    having: tuple[Having, ...] = ()
    top: Top | None = None
    set_op: str | None = None
    other: Plan | None = field(default=None)

    def __post_init__(self) -> None:
        if (self.set_op is None) != (self.other is None) or self.set_op not in (None, "union", "intersect", "except"):
            raise PlanError(f"set operation {self.set_op}")
        if not self.projections and not self.measures:
            raise PlanError("nothing is asked for")


def _structure(x: Any) -> Any:
    if hasattr(x, "__dataclass_fields__"):
        return {k: _structure(getattr(x, k)) for k in x.__dataclass_fields__ if getattr(x, k) not in (None, (), "")}
    return [_structure(v) for v in x] if isinstance(x, (list, tuple)) else x


def _place(m: Measure) -> tuple:
    """What measures are ordered by: what they are, where, and their parts."""
    return (m.metric or "", m.aggregation or "", m.attribute or "", m.combine or "", m.over or "", -1 if m.path is None else m.path, tuple(map(_place, m.parts)))


def _ordered(measure: Measure) -> Measure:
    """A measure with the parts of sums and products in one order."""
    parts = [_ordered(p) for p in measure.parts]
    return replace(measure, parts=tuple(sorted(parts, key=_place) if measure.combine in ("add", "multiply") else parts))


def canonicalise(plan: Plan, model: Model | None = None) -> Plan:
    """One form of plans that mean the same: paths once each, displays named, sums and products ordered."""
    paths = tuple(dict.fromkeys(plan.paths))
    at = {i: paths.index(p) for i, p in enumerate(plan.paths)}
    move = lambda x: replace(x, path=None if x.path is None else at[x.path])

    def measure(m: Measure) -> Measure:
        return replace(move(m), parts=tuple(map(measure, m.parts)))

    def projection(p: Projection) -> Projection:
        if model is not None and p.attribute is None:
            end = plan.subject
            if p.path is not None:
                for s in plan.paths[p.path].steps:
                    end = model.edges[s.edge].target if s.forward else model.edges[s.edge].source
            p = replace(p, attribute=model.concepts[end].display)
        return move(p)

    return replace(plan, paths=paths, projections=tuple(map(projection, plan.projections)), measures=tuple(_ordered(measure(m)) for m in plan.measures), filters=tuple(map(move, plan.filters)), other=plan.other and canonicalise(plan.other, model))


def canonical_key(plan: Plan, model: Model | None = None) -> str:
    """32 hex digits; plans of one key have one result."""
    return hashlib.sha256(json.dumps(_structure(canonicalise(plan, model)), sort_keys=True, default=str).encode()).hexdigest()[:32]
