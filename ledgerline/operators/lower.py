"""Lowering of plans to DataFrames.

A plan's routes become a tree of aliases. Each measure is grouped where its rows are: the
joins that its operand, the dimensions and the filters need, reduced to one row for each
group, measured instance and operand row, then grouped. Where declared fan-out already says
that an operand row meets one row at most of every other alias, nothing can be counted twice
and the reduction is left out: a single aggregation, without a shuffle of its own. Measures
over the same rows share one aggregation. Filters on routes that nothing else uses are left
semi joins, so they never multiply rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import aggregate, combine, predicate
from ..plans.graph import MAX_HOPS, Graph, Path
from ..plans.ir import Filter, Measure, Plan
from ..plans.layout import Layout
from ..plans.model import Attribute, GrainError, Metric, Model, PlanError

Tables = Callable[[str], DataFrame]
#: Columns of a key that are shuffled as they are.
WIDE = 3


@dataclass(frozen=True)
class Leaf:
    op: str
    alias: str
    attribute: Attribute
    #: Aliases whose keys name one counted row: what it is measured over, and its operand.
    grain: tuple[str, ...]
    label: str


@dataclass(frozen=True)
class Composite:
    combine: str
    parts: tuple
    label: str
    #: Aggregate over instances of an alias, of the combination for each.
    over: str | None = None
    per: str | None = None


@dataclass
class Satellite:
    """Leaves that share joined rows."""

    aliases: frozenset[str]
    grain: tuple[str, ...]
    per: str | None
    leaves: list[Leaf] = field(default_factory=list)


class Compiler:
    def __init__(self, model: Model, graph: Graph, tables: Tables, *, elide: bool = True) -> None:
        self.model, self.graph, self.tables, self.elide = model, graph, tables, elide

    # scans and joins

    def _scan(self, layout: Layout, alias: str) -> DataFrame:
        node = layout.nodes[alias]
        df = self.tables(node.table)
        if node.where:
            df = df.where(F.col(node.where[0]) == F.lit(node.where[1]))
        for table, pairs in node.markers:
            marker = self.tables(table).select(*(F.col(b).alias(f"__{b}") for _, b in pairs))
            on = [F.col(a) == F.col(f"__{b}") for a, b in pairs]
            df = df.join(marker, on, "left_semi")
        extra = []
        if node.concept:
            extra = [F.expr(a.expression).alias(f"{alias}__{a.name}") for a in self.model.concepts[node.concept].attributes.values() if a.expression]
        return df.select(*(F.col(c).alias(f"{alias}__{c}") for c in df.columns), *extra)

    def _column(self, alias: str, a: Attribute) -> Column:
        return F.col(f"{alias}__{a.column or a.name}")

    def _on(self, layout: Layout, alias: str) -> list[Column]:
        node = layout.nodes[alias]
        return [F.col(f"{node.parent}__{p}") == F.col(f"{alias}__{c}") for p, c in node.on]

    def _tree(self, layout: Layout, top: str, needed: set[str], filters: dict[str, list[Column]]) -> DataFrame:
        """The inner joins of needed aliases from top down, in the order they were found; other filters as semi joins."""
        df = self._scan(layout, top)
        for c in filters.get(top, ()):
            df = df.where(c)
        for child in [a for a, n in layout.nodes.items() if n.parent == top]:
            below = {a for a in [*needed, *filters] if child in layout.ancestry(a)}
            if not below:
                continue
            kept = any(a in needed for a in below)
            df = df.join(self._tree(layout, child, needed if kept else below, filters), self._on(layout, child), "inner" if kept else "left_semi")
        return df

    def _joined(self, layout: Layout, aliases: set[str], filters: dict[str, list[Column]]) -> DataFrame:
        return self._tree(layout, layout.root, layout.closure(aliases | {layout.root}), filters)

    # measures

    def _route(self, plan: Plan, m: Measure) -> Path:
        if m.path is None:
            return Path(plan.subject)
        return plan.paths[m.path]

    def _expand(self, layout: Layout, plan: Plan, m: Measure) -> Leaf | Composite:
        if m.combine:
            parts = tuple(self._expand(layout, plan, p) for p in m.parts)
            joint = {"add": "_plus_", "subtract": "_minus_", "multiply": "_times_", "divide": "_per_"}[m.combine]
            if m.over:
                raise PlanError("over needs a metric that is formed per concept")
            return Composite(m.combine, parts, joint.join(p.label for p in parts))
        if m.aggregation:
            if m.over:
                raise PlanError("over is for composed metrics")
            return self._raw(layout, plan, m)
        metric = self.model.metrics.get(m.metric)
        if metric is None:
            raise PlanError(f"no metric {m.metric}")
        out = self._governed(layout, plan, metric, self._route(plan, m), m.path is not None)
        if m.over:
            if metric.combine is None or metric.per is None:
                raise PlanError(f"{metric.name} isn't formed per concept")
            per = {leaf.grain[0] for leaf in leaves(out)}
            if len(per) != 1:
                raise PlanError(f"{metric.name}: its parts are measured over different aliases")
            return Composite(out.combine, out.parts, f"{m.over}_{metric.name}", m.over, per.pop())
        return out

    def _raw(self, layout: Layout, plan: Plan, m: Measure) -> Leaf:
        at = layout.walk(self.graph.govern(self._route(plan, m)))
        alias, a = layout.attribute(at, m.attribute)
        concept = self.model.concepts[layout.nodes[alias].concept]
        if layout.may_revisit(alias):
            raise GrainError(f"rows of {alias} may be met twice, and {m.aggregation} of {a.name} is no governed metric")
        if layout.fans_out(alias):
            if m.aggregation == "avg":
                raise GrainError(f"an average of {a.name} over rows that a route multiplies")
            if m.aggregation == "count_distinct" and a.column not in concept.key:
                raise GrainError(f"{a.name} doesn't identify {concept.name}, and a route multiplies its rows")
        if m.aggregation in ("sum", "avg") and a.type not in ("numeric", "integer"):
            raise PlanError(f"{m.aggregation} of {a.name}, which is no number")
        self._keyed(alias, layout)
        return Leaf(m.aggregation, alias, a, (alias,), f"{m.aggregation}_{a.name}")

    def _keyed(self, alias: str, layout: Layout) -> None:
        concept = layout.nodes[alias].concept
        if not self.model.concepts[concept].key:
            raise GrainError(f"{concept} has no key, so its rows can't be told apart")

    def _governed(self, layout: Layout, plan: Plan, metric: Metric, route: Path, given: bool) -> Leaf | Composite:
        if metric.combine:
            over = self.model.measured_over(metric.name)
            if given and len(over) > 1:
                raise GrainError(f"{metric.name} is measured over {', '.join(over)}; it takes no route")
            parts = tuple(self._governed(layout, plan, self.model.metrics[c], route, given) for c in metric.components)
            return Composite(metric.combine, parts, metric.name)
        o, over = metric.operand, self.model.measured_over(metric.name)[0]
        path = self._leaf_route(plan, metric, route, given)
        at = layout.walk(self.graph.govern(path))
        alias, a = layout.attribute(at, o.attribute)
        measured = next(x for x in layout.ancestry(at)[::1] if layout.nodes[x].concept == over) if o.via else at
        self._keyed(alias, layout)
        self._keyed(measured, layout)
        return Leaf(metric.op, alias, a, tuple(dict.fromkeys((measured, alias))), metric.name)

    def _leaf_route(self, plan: Plan, metric: Metric, route: Path, given: bool) -> Path:
        """The route to a leaf's operand: its own edge is the last step where it has one."""
        o, over = metric.operand, self.model.measured_over(metric.name)[0]
        arrives = lambda p: not o.via or (p.steps and p.steps[-1].edge == o.via)
        if given:
            if self.graph.target(route) == o.concept and arrives(route):
                return route
            if o.via and self.graph.target(route) == over:
                return self.graph.extend(route, o.via)
            raise GrainError(f"{metric.name}: {route} neither arrives by {o.via or o.concept} nor at {over}")
        if plan.subject == o.concept and not o.via:
            return Path(plan.subject)
        if o.via and plan.subject == over:
            return self.graph.extend(Path(plan.subject), o.via)
        declared = [p for p in dict.fromkeys(plan.paths) if self.graph.target(p) == o.concept and arrives(p)]
        if len(declared) == 1:
            return declared[0]
        stems = [p for p in dict.fromkeys(plan.paths) if o.via and self.graph.target(p) == over]
        if len(stems) == 1:
            return self.graph.extend(stems[0], o.via)
        fit = [p for p in self.graph.paths(plan.subject, o.concept, MAX_HOPS) if arrives(p)]
        least = [p for p in fit if len(p.steps) == len(fit[0].steps)] if fit else []
        if len(least) != 1:
            raise PlanError(f"{metric.name}: {len(least)} shortest routes from {plan.subject}; state one")
        return least[0]

    # the plan

    def compile(self, plan: Plan) -> DataFrame:
        df = self._one(plan)
        if plan.other is None:
            return df
        other = self.compile(plan.other)
        if len(df.columns) != len(other.columns):
            raise PlanError(f"{plan.set_op} of {len(df.columns)} and {len(other.columns)} columns")
        other = other.toDF(*df.columns)
        if plan.set_op == "union":
            return df.union(other).distinct()
        return df.intersect(other) if plan.set_op == "intersect" else df.subtract(other)

    def _one(self, plan: Plan) -> DataFrame:
        layout = Layout(self.graph, plan.subject)
        ends = [layout.walk(self.graph.govern(p)) for p in plan.paths]
        end = lambda x: layout.root if x.path is None else ends[x.path]
        dims = [layout.attribute(end(p), p.attribute) for p in plan.projections]
        filters: dict[str, list[Column]] = {}
        for f in plan.filters:
            self._filter(layout, end(f), f, filters)
        measures = [self._expand(layout, plan, m) for m in plan.measures]
        names = _labels([a.name for _, a in dims] + [m.label for m in measures])
        layout.certify_rows([alias for alias, _ in dims])
        keys = [self._column(alias, a).alias(n) for (alias, a), n in zip(dims, names, strict=False)]
        dim_names = names[: len(dims)]
        if not measures:
            df = self._joined(layout, {a for a, _ in dims}, filters)
            repeats = any(layout.may_revisit(a) for a, _ in dims)
            identity = [] if repeats else [F.col(f"{layout.root}__{k}").alias(f"__id{i}") for i, k in enumerate(self.model.concepts[plan.subject].key)]
            df = df.select(*keys, *(identity if plan.top else []))
            df = df.distinct() if repeats else df
            return self._finish(plan, df, dim_names, [], [f"__id{i}" for i in range(len(identity))] if plan.top else [])
        df = self._grouped(layout, measures, dims, keys, dim_names, filters)
        df = df.select(*dim_names, *(c.alias(n) for c, n in zip(self._values(measures), names[len(dims) :], strict=True)))
        return self._finish(plan, df, dim_names, names[len(dims) :], [])

    def _filter(self, layout: Layout, at: str, f: Filter, filters: dict[str, list[Column]]) -> None:
        alias, a = layout.attribute(at, f.attribute)
        filters.setdefault(alias, []).append(predicate(self._column(alias, a), f.op, f.value, a.type))

    def _grouped(self, layout, measures, dims, keys, names, filters) -> DataFrame:
        """One row for each group with a column for each leaf and each aggregate over instances."""
        satellites: dict[tuple, Satellite] = {}
        overs = [c for m in measures for c in _overs(m)]
        inside = {id(leaf): c.per for c in overs for leaf in leaves(c)}
        self.leaf_names: dict[int, str] = {}
        for m in measures:
            for leaf in leaves(m):
                per = inside.get(id(leaf))
                aliases = frozenset({a for a, _ in dims} | {leaf.alias} | set(leaf.grain))
                sat = satellites.setdefault((aliases, leaf.grain, per), Satellite(aliases, leaf.grain, per))
                if leaf not in sat.leaves:
                    sat.leaves.append(leaf)
        at = 0
        frames: list[DataFrame] = []
        by_per: dict[tuple, list[tuple[DataFrame, Satellite]]] = {}
        for sat in satellites.values():
            for leaf in sat.leaves:
                for m in measures:
                    for x in leaves(m):
                        if x == leaf and inside.get(id(x)) == sat.per:
                            self.leaf_names[id(x)] = f"__v{at}"
                at += 1
            df = self._satellite(layout, sat, keys, names, filters, at - len(sat.leaves))
            if sat.per is None:
                frames.append(df)
            else:
                by_per.setdefault((sat.per,), []).append((df, sat))
        self.over_names: dict[int, str] = {}
        for k, c in enumerate(overs):
            frames.append(self._over(layout, c, dims, keys, names, filters, [d for d, _ in by_per[(c.per,)]], f"__o{k}"))
            self.over_names[id(c)] = f"__o{k}"
        out = frames[0]
        for df in frames[1:]:
            out = out.join(df, names, "inner") if names else out.crossJoin(F.broadcast(df))  # without groups, one row each
        return out

    def _instance(self, layout: Layout, alias: str) -> list[Column]:
        concept = self.model.concepts[layout.nodes[alias].concept]
        return [F.col(f"{alias}__{k}").alias(f"__p{i}") for i, k in enumerate(concept.key)]

    def _row_key(self, layout: Layout, alias: str) -> list[Column]:
        """What tells the rows of an alias apart: its key, or 128 bits of a key that is wider than these."""
        key = [F.col(f"{alias}__{k}") for k in self.model.concepts[layout.nodes[alias].concept].key]
        if len(key) <= WIDE:
            return key
        told = [x for c in key for x in (c, c.isNull())]  # a hash passes over nulls
        return [F.xxhash64(*told), F.xxhash64(F.lit(1), *told)]

    def _satellite(self, layout, sat: Satellite, keys, names, filters, first: int) -> DataFrame:
        df = self._joined(layout, set(sat.aliases), filters)
        per = self._instance(layout, sat.per) if sat.per else []
        per_names = [f"__p{i}" for i in range(len(per))]
        values = [self._column(leaf.alias, leaf.attribute).alias(f"__x{i}") for i, leaf in enumerate(sat.leaves)]
        inner = layout.closure(set(sat.aliases))
        if not (self.elide and layout.one_row_each(sat.leaves[0].alias, inner)):
            grain = [c.alias(f"__k{i}_{j}") for i, a in enumerate(sat.grain) for j, c in enumerate(self._row_key(layout, a))]
            df = df.select(*keys, *per, *grain, *values).distinct()
        else:
            df = df.select(*keys, *per, *values)
        for n in names:  # groups meet by equality, so a null group has no partner
            df = df.where(F.col(n).isNotNull())
        aggs = [aggregate(leaf.op, F.col(f"__x{i}"), self._decimals(leaf.attribute)).alias(f"__v{first + i}") for i, leaf in enumerate(sat.leaves)]
        return df.groupBy(*names, *per_names).agg(*aggs)

    def _decimals(self, a: Attribute) -> int | None:
        return (self.model.value_types.get(a.value_type) or {}).get("decimals") if a.value_type else None

    def _over(self, layout, c: Composite, dims, keys, names, filters, frames: list[DataFrame], name: str) -> DataFrame:
        """An aggregate of the combination for each instance; an instance without rows of a part has 0 of it."""
        per = self._instance(layout, c.per)
        on = [*names, *(f"__p{i}" for i in range(len(per)))]
        df = self._joined(layout, {a for a, _ in dims} | {c.per}, filters).select(*keys, *per).distinct()
        for n in names:
            df = df.where(F.col(n).isNotNull())
        for f in frames:
            df = df.join(f, on, "left")
        value = self._value(Composite(c.combine, c.parts, c.label), lambda x: F.coalesce(x, F.lit(0)))
        return df.groupBy(*names).agg(aggregate(c.over, value).alias(name))

    def _value(self, m: Leaf | Composite, wrap=lambda x: x) -> Column:
        if isinstance(m, Leaf):
            return wrap(F.col(self.leaf_names[id(m)]))
        if m.over:
            return F.col(self.over_names[id(m)])
        return combine(m.combine, [self._value(p, wrap) for p in m.parts])

    def _values(self, measures) -> list[Column]:
        return [self._value(m) for m in measures]

    def _finish(self, plan: Plan, df: DataFrame, dims: list[str], measures: list[str], identity: list[str]) -> DataFrame:
        for h in plan.having:
            if not 0 <= h.measure < len(measures):
                raise PlanError(f"having names measure {h.measure}")
            df = df.where(predicate(F.col(measures[h.measure]), h.op, h.value, "string" if h.op == "LIKE" else "numeric"))
        if plan.top:
            t = plan.top
            of, i = (dims, t.projection) if t.measure is None else (measures, t.measure)
            if not 0 <= i < len(of):
                raise PlanError(f"order by column {i} of {len(of)}")
            main = F.col(of[i])
            df = df.orderBy(main.desc_nulls_last() if t.descending else main.asc_nulls_last(), *(F.col(c).asc_nulls_last() for c in [*dims, *identity]))
            if t.limit is not None:
                df = df.limit(t.limit)
        return df.drop(*identity)


def leaves(m: Leaf | Composite) -> list[Leaf]:
    return [m] if isinstance(m, Leaf) else [x for p in m.parts for x in leaves(p)]


def _overs(m: Leaf | Composite) -> list[Composite]:
    if isinstance(m, Leaf):
        return []
    return [m] if m.over else [c for p in m.parts for c in _overs(p)]


def _labels(names: list[str]) -> list[str]:
    out: list[str] = []
    for n in names:
        k, base = 1, n
        while n in out:
            k += 1
            n = f"{base}_{k}"
        out.append(n)
    return out


__all__ = ["Compiler", "Composite", "Leaf", "leaves"]
