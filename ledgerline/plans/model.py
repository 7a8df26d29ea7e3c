"""The semantic and physical model: two YAML layers joined, typed and validated."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

TYPES = ("string", "numeric", "integer", "date", "datetime", "boolean")
NUMBERS = ("numeric", "integer")
OPERATIONS = ("sum", "count", "avg", "min", "max", "count_distinct")
COMBINES = ("add", "subtract", "multiply", "divide")
CARDINALITIES = ("one_to_one", "one_to_many", "many_to_one", "many_to_many")
FAN_OUTS = ("none", "bounded", "multiplicative")


class ModelError(ValueError):
    """A model that can't be used."""


class PlanError(ValueError):
    """A plan that names what the model hasn't."""


class GrainError(PlanError):
    """A plan whose numbers can't be certified."""


@dataclass(frozen=True)
class Attribute:
    name: str
    type: str
    column: str | None = None
    #: A SQL expression over the concept's columns in place of a column.
    expression: str | None = None
    via: str | None = None
    attribute: str | None = None
    value_type: str | None = None
    label: str | None = None
    aliases: tuple[str, ...] = ()
    searchable: bool = False


@dataclass(frozen=True)
class Concept:
    name: str
    table: str
    key: tuple[str, ...]
    attributes: dict[str, Attribute]
    display: str | None = None
    grain: str | None = None
    implements: str | None = None
    role: str | None = None
    #: (column, value): the part of the table that is this concept.
    backed_where: tuple[str, Any] | None = None
    description: str = ""


@dataclass(frozen=True)
class Edge:
    name: str
    source: str
    target: str
    cardinality: str
    fan_out: str = "bounded"
    fan_out_reverse: str = "bounded"
    join: tuple[tuple[str, str], ...] = ()
    via_table: str | None = None
    from_join: tuple[tuple[str, str], ...] = ()
    to_join: tuple[tuple[str, str], ...] = ()
    predicate: tuple[str, Any] | None = None
    restrict_table: str | None = None
    restrict_columns: tuple[tuple[str, str], ...] = ()
    role: str | None = None
    evidence: str = ""
    description: str = ""

    @property
    def backing(self) -> str:
        return "junction" if self.via_table else "restricted" if self.restrict_table else "direct"


@dataclass(frozen=True)
class Operand:
    concept: str
    attribute: str
    via: str | None = None


@dataclass(frozen=True)
class Metric:
    name: str
    op: str | None = None
    operand: Operand | None = None
    combine: str | None = None
    components: tuple[str, ...] = ()
    per: str | None = None
    description: str = ""


@dataclass(frozen=True)
class Link:
    name: str
    predicate: str
    source: str
    target: str
    backed_by: tuple[str, ...]
    description: str = ""


@dataclass(frozen=True)
class Phrases:
    phrases: tuple[str, ...]
    metric: str | None = None
    link: str | None = None


@dataclass(frozen=True)
class Model:
    domain: str
    concepts: dict[str, Concept]
    edges: dict[str, Edge]
    metrics: dict[str, Metric]
    links: tuple[Link, ...] = ()
    glossary: tuple[Phrases, ...] = ()
    roles: dict[str, str] = field(default_factory=dict)
    value_types: dict[str, dict] = field(default_factory=dict)

    def measured_over(self, name: str) -> tuple[str, ...]:
        """The concepts that a metric is a quantity of, in order, each once."""
        metric = self.metrics[name]
        if metric.op:
            if not metric.operand.via:
                return (metric.operand.concept,)
            edge = self.edges[metric.operand.via]
            return (edge.source if edge.target == metric.operand.concept else edge.target,)
        return tuple(dict.fromkeys(c for part in metric.components for c in self.measured_over(part)))

    def summands(self, name: str) -> set[str]:
        """Metrics that are added into this one, directly or through other sums."""
        metric, out = self.metrics[name], set()
        for part in metric.components if metric.combine == "add" else ():
            out |= {part} | self.summands(part)
        return out

    def tables(self) -> set[str]:
        out = {c.table for c in self.concepts.values()}
        for e in self.edges.values():
            out |= {t for t in (e.via_table, e.restrict_table) if t}
        return out


def _known(where: str, doc: dict, allowed: set[str]) -> None:
    if not isinstance(doc, dict):
        raise ModelError(f"{where}: a mapping is expected")
    if extra := sorted(set(doc) - allowed):
        raise ModelError(f"{where}: unknown keys {', '.join(extra)}")


def _pairs(where: str, doc: Any) -> tuple[tuple[str, str], ...]:
    if not isinstance(doc, dict) or not doc:
        raise ModelError(f"{where}: pairs of columns are expected")
    return tuple(doc.items())


def _predicate(where: str, doc: Any) -> tuple[str, Any] | None:
    if doc is None:
        return None
    if not isinstance(doc, dict) or len(doc) != 1:
        raise ModelError(f"{where}: a predicate is one column and one value")
    return next(iter(doc.items()))


_ATTRIBUTE = {"type", "value_type", "label", "aliases", "via", "attribute", "description", "unit", "format"}
_CONCEPT = {"key", "display", "description", "attributes", "searchable", "grain", "implements", "role"}
_EDGE = {"from", "to", "role", "cardinality", "fan_out", "fan_out_reverse", "evidence", "description"}
_METRIC = {"op", "operand", "combine", "components", "per", "description"}
_TOP = {"version", "domain", "value_types", "concepts", "party_roles", "edges", "metrics", "links", "glossary"}
_MAPPED = {"table", "key_columns", "columns", "predicate"}
_JOINED = {"join", "via_table", "from_join", "to_join", "predicate", "restrict"}


def build(semantic: dict, mapping: dict, schema: dict[str, set[str]] | None = None) -> Model:
    """The model of both layers; schema, if given, is every table's columns."""
    _known("semantic layer", semantic, _TOP)
    _known("mapping layer", mapping, {"version", "warehouse", "source", "concepts", "edges"})
    value_types = semantic.get("value_types") or {}
    roles = {code: (r or {}).get("name", "") if isinstance(r, dict) else r for code, r in (semantic.get("party_roles") or {}).items()}
    for kind in ("concepts", "edges"):
        have, mapped = set(semantic.get(kind) or {}), set(mapping.get(kind) or {})
        if have - mapped:
            raise ModelError(f"{kind} without a mapping: {', '.join(sorted(have - mapped))}")
        if mapped - have:
            raise ModelError(f"{kind} mapped but not declared: {', '.join(sorted(mapped - have))}")

    def column(where: str, table: str, name: str) -> str:
        if schema is not None:
            if table not in schema:
                raise ModelError(f"{where}: no table {table}")
            if name not in schema[table]:
                raise ModelError(f"{where}: table {table} has no column {name}")
        return name

    concepts = {n: _concept(n, c or {}, mapping["concepts"][n] or {}, roles, column) for n, c in (semantic.get("concepts") or {}).items()}
    edges = {n: _edge(n, e or {}, mapping["edges"][n] or {}, concepts, roles, column) for n, e in (semantic.get("edges") or {}).items()}
    metrics = {n: _metric(n, m or {}) for n, m in (semantic.get("metrics") or {}).items()}
    links = []
    for doc in semantic.get("links") or []:
        _known("link", doc, {"name", "predicate", "from", "to", "backed_by", "description"})
        links.append(Link(doc["name"], doc.get("predicate", ""), doc["from"], doc["to"], tuple(doc.get("backed_by") or ()), doc.get("description", "")))
    glossary = []
    for doc in semantic.get("glossary") or []:
        _known("glossary", doc, {"phrases", "means"})
        means = doc.get("means") or {}
        if len(means) != 1 or not set(means) <= {"metric", "link"}:
            raise ModelError(f"glossary {doc.get('phrases')}: it must mean one metric or one link")
        glossary.append(Phrases(tuple(doc.get("phrases") or ()), means.get("metric"), means.get("link")))
    model = Model(semantic.get("domain", ""), concepts, edges, metrics, tuple(links), tuple(glossary), roles, value_types)
    _validate(model)
    return model


def _concept(name: str, doc: dict, mapped: dict, roles: dict, column) -> Concept:
    where = f"concept {name}"
    _known(where, doc, _CONCEPT)
    _known(f"{where}, mapping", mapped, _MAPPED)
    table, columns, searchable = mapped.get("table"), mapped.get("columns") or {}, set(doc.get("searchable") or ())
    if not table:
        raise ModelError(f"{where}: no table")
    attributes = {}
    for a, spec in (doc.get("attributes") or {}).items():
        spec = spec or {}
        _known(f"{where}.{a}", spec, _ATTRIBUTE)
        if spec.get("type") not in TYPES:
            raise ModelError(f"{where}.{a}: type {spec.get('type')}")
        via, at = spec.get("via"), columns.get(a)
        if via and at:
            raise ModelError(f"{where}.{a}: it is reached by {via} and has a column")
        if via and not spec.get("attribute"):
            raise ModelError(f"{where}.{a}: reached by {via}, but no attribute there")
        if not via and at is None:
            raise ModelError(f"{where}.{a}: no column")
        expression = at.get("expr") if isinstance(at, dict) else None
        attributes[a] = Attribute(a, spec["type"], None if via or expression else column(f"{where}.{a}", table, at), expression, via, spec.get("attribute"), spec.get("value_type"), spec.get("label"), tuple(spec.get("aliases") or ()), a in searchable)
    if extra := sorted(set(columns) - set(attributes)):
        raise ModelError(f"{where}: columns of undeclared attributes {', '.join(extra)}")
    if lost := sorted(searchable - set(attributes)):
        raise ModelError(f"{where}: searchable but no attribute: {', '.join(lost)}")
    key = tuple(column(where, table, k) for k in mapped.get("key_columns") or ())
    for k in doc.get("key") or ():
        if k not in attributes or attributes[k].column is None:
            raise ModelError(f"{where}: key {k} is no attribute with a column")
        if attributes[k].column not in key:
            raise ModelError(f"{where}: key {k} isn't among the key columns")
    where_ = _predicate(where, mapped.get("predicate"))
    role = doc.get("role")
    if bool(role) != bool(where_):
        raise ModelError(f"{where}: a role needs a predicate, and a predicate a role")
    if role and roles and role not in roles:
        raise ModelError(f"{where}: unknown role {role}")
    if where_:
        column(where, table, where_[0])
    return Concept(name, table, key, attributes, doc.get("display"), doc.get("grain"), doc.get("implements"), role, where_, (doc.get("description") or "").strip())


def _edge(name: str, doc: dict, mapped: dict, concepts: dict, roles: dict, column) -> Edge:
    where = f"edge {name}"
    _known(where, doc, _EDGE)
    _known(f"{where}, mapping", mapped, _JOINED)
    for end in ("from", "to"):
        if doc.get(end) not in concepts:
            raise ModelError(f"{where}: unknown concept {doc.get(end)}")
    if doc.get("cardinality") not in CARDINALITIES:
        raise ModelError(f"{where}: cardinality {doc.get('cardinality')}")
    fans = [doc.get(k) or "bounded" for k in ("fan_out", "fan_out_reverse")]
    if any(f not in FAN_OUTS for f in fans):
        raise ModelError(f"{where}: fan-out {fans}")
    if ("join" in mapped) == ("via_table" in mapped):
        raise ModelError(f"{where}: either join or via_table")
    source, target = concepts[doc["from"]].table, concepts[doc["to"]].table
    predicate, role = _predicate(where, mapped.get("predicate")), doc.get("role")
    if role and roles and role not in roles:
        raise ModelError(f"{where}: unknown role {role}")
    common = {"name": name, "source": doc["from"], "target": doc["to"], "cardinality": doc["cardinality"], "fan_out": fans[0], "fan_out_reverse": fans[1], "role": role, "evidence": doc.get("evidence", ""), "description": (doc.get("description") or "").strip(), "predicate": predicate}
    if "join" in mapped:
        if predicate:
            raise ModelError(f"{where}: a predicate belongs on a junction table")
        join = _pairs(where, mapped["join"])
        for a, b in join:
            column(where, source, a), column(where, target, b)
        restrict = mapped.get("restrict")
        if restrict is None:
            return Edge(**common, join=join)
        _known(f"{where}, restrict", restrict, {"table", "columns"})
        pairs = _pairs(where, restrict.get("columns"))
        for a, b in pairs:
            column(where, target, a), column(where, restrict["table"], b)
        return Edge(**common, join=join, restrict_table=restrict["table"], restrict_columns=pairs)
    if "restrict" in mapped:
        raise ModelError(f"{where}: a junction has no restriction")
    left, right = _pairs(where, mapped.get("from_join")), _pairs(where, mapped.get("to_join"))
    for a, b in left:
        column(where, source, a), column(where, mapped["via_table"], b)
    for a, b in right:
        column(where, mapped["via_table"], a), column(where, target, b)
    if predicate:
        column(where, mapped["via_table"], predicate[0])
    return Edge(**common, via_table=mapped["via_table"], from_join=left, to_join=right)


def _metric(name: str, doc: dict) -> Metric:
    where = f"metric {name}"
    _known(where, doc, _METRIC)
    op, combine = doc.get("op"), doc.get("combine")
    if bool(op) == bool(combine):
        raise ModelError(f"{where}: either op or combine")
    if op:
        if op not in OPERATIONS:
            raise ModelError(f"{where}: op {op}")
        if doc.get("per") or doc.get("components"):
            raise ModelError(f"{where}: per and components are for composites")
        operand = doc.get("operand") or {}
        _known(f"{where}, operand", operand, {"concept", "attribute", "via"})
        return Metric(name, op, Operand(operand.get("concept"), operand.get("attribute"), operand.get("via")), description=(doc.get("description") or "").strip())
    parts = tuple(doc.get("components") or ())
    if combine not in COMBINES or len(parts) < 2 or (combine in ("subtract", "divide") and len(parts) != 2):
        raise ModelError(f"{where}: {combine} of {len(parts)} components")
    return Metric(name, combine=combine, components=parts, per=doc.get("per"), description=(doc.get("description") or "").strip())


def _acyclic(kind: str, graph: dict[str, tuple[str, ...]]) -> None:
    done: set[str] = set()

    def visit(n: str, above: tuple[str, ...]) -> None:
        if n in above:
            raise ModelError(f"{kind} go round: {' > '.join([*above[above.index(n):], n])}")
        if n not in done:
            for m in graph.get(n, ()):
                visit(m, (*above, n))
            done.add(n)

    for n in graph:
        visit(n, ())


def _validate(m: Model) -> None:
    for c in m.concepts.values():
        where = f"concept {c.name}"
        if c.display and c.display not in c.attributes:
            raise ModelError(f"{where}: display {c.display} is no attribute")
        if c.implements and c.implements not in m.concepts:
            raise ModelError(f"{where}: it implements the unknown {c.implements}")
        for a in c.attributes.values():
            if a.value_type and a.value_type not in m.value_types:
                raise ModelError(f"{where}.{a.name}: unknown value type {a.value_type}")
            if a.via:
                edge = m.edges.get(a.via)
                if edge is None or c.name not in (edge.source, edge.target):
                    raise ModelError(f"{where}.{a.name}: {a.via} is no edge of it")
                if edge.via_table:
                    raise ModelError(f"{where}.{a.name}: {a.via} is a junction")
                far = edge.target if edge.source == c.name else edge.source
                if a.attribute not in m.concepts[far].attributes:
                    raise ModelError(f"{where}.{a.name}: {far} has no attribute {a.attribute}")
    _acyclic("interfaces", {n: (c.implements,) for n, c in m.concepts.items() if c.implements})
    for x in m.metrics.values():
        where = f"metric {x.name}"
        if x.op:
            o = x.operand
            if o.concept not in m.concepts or o.attribute not in m.concepts[o.concept].attributes:
                raise ModelError(f"{where}: no attribute {o.concept}.{o.attribute}")
            if x.op in ("sum", "avg") and m.concepts[o.concept].attributes[o.attribute].type not in NUMBERS:
                raise ModelError(f"{where}: {x.op} of what is no number")
            if o.via and (o.via not in m.edges or o.concept not in (m.edges[o.via].source, m.edges[o.via].target)):
                raise ModelError(f"{where}: {o.via} is no edge of {o.concept}")
        elif lost := [c for c in x.components if c not in m.metrics]:
            raise ModelError(f"{where}: unknown components {', '.join(lost)}")
    _acyclic("metrics", {n: x.components for n, x in m.metrics.items()})
    for x in m.metrics.values():
        if x.per and m.measured_over(x.name) != (x.per,):
            raise ModelError(f"metric {x.name}: per {x.per}, but it is measured over {', '.join(m.measured_over(x.name))}")
    seen = set()
    for link in m.links:
        if link.name in seen:
            raise ModelError(f"link {link.name} twice")
        seen.add(link.name)
        at = link.source
        for e in link.backed_by:
            edge = m.edges.get(e)
            if edge is None or at not in (edge.source, edge.target):
                raise ModelError(f"link {link.name}: {e} doesn't go on from {at}")
            at = edge.target if edge.source == at else edge.source
        if at != link.target or not link.backed_by:
            raise ModelError(f"link {link.name}: its edges end at {at}, not {link.target}")
    for g in m.glossary:
        if (g.metric and g.metric not in m.metrics) or (g.link and g.link not in seen):
            raise ModelError(f"glossary {g.phrases}: it means what isn't there")
