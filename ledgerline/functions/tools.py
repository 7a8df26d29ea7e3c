"""The lookups by name, with their parameters; errors come back as data, as a caller that reads them can mend its call."""

from __future__ import annotations

import dataclasses
import inspect
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.errors import PySparkException

from .. import trace
from ..engine import Engine
from ..operators import profile
from ..operators.check import Checker
from ..plans.model import PlanError
from . import lookup


@dataclass(frozen=True)
class Result:
    tool: str
    ok: bool
    data: Any


#: Types of parameters, as a JSON schema names them.
KINDS = {"str": "string", "int": "integer", "bool": "boolean", "dict": "object"}


class Tools:
    """What may be asked of an engine. Rows that a tool returns are as many as its report shows."""

    def __init__(self, engine: Engine, checker: Checker | None = None, *, rows: int = 50) -> None:
        self.engine, self.checker, self.rows = engine, checker, rows
        self.all: dict[str, Callable[..., Any]] = {n.removeprefix("do_"): getattr(self, n) for n in dir(self) if n.startswith("do_")}
        if checker is None:
            del self.all["check_sql"]

    def do_search(self, words: str, limit: int = 20) -> Any:
        """What the model has that sounds like some words."""
        return lookup.search(self.engine.model, words, limit)

    def do_find_metric(self, words: str) -> Any:
        """The metric that words mean: unique, partial, ambiguous or absent."""
        return lookup.find_metric(self.engine.model, words)

    def do_find_attribute(self, words: str, concept: str = "") -> Any:
        """The attribute that words mean, of any concept or of one."""
        return lookup.find_attribute(self.engine.model, words, concept or None)

    def do_list_concepts(self) -> Any:
        """Every concept."""
        return lookup.list_concepts(self.engine.model)

    def do_list_subjects(self, target: str) -> Any:
        """Concepts from which another is reached, the nearest first."""
        return lookup.list_subjects(self.engine.model, self.engine.graph, target)

    def do_describe_concept(self, name: str, values: bool = False) -> Any:
        """A concept with its attributes, edges and metrics; with its most frequent values on request."""
        return lookup.describe_concept(self.engine.model, self.engine.graph, name, self.engine.tables if values else None)

    def do_find_paths(self, source: str, target: str, max_hops: int = 4, measured: bool = False) -> Any:
        """Routes between two concepts, with measured fan-out on request."""
        return lookup.find_paths(self.engine.graph, source, target, max_hops, self.engine.tables if measured else None)

    def do_search_values(self, concept: str, attribute: str, text: str) -> Any:
        """Values that an attribute has, by likeness to a text."""
        return [tuple(r) for r in profile.search_values(self.engine.model, self.engine.tables, concept, attribute, text).collect()]

    def do_check_sql(self, sql: str) -> Any:
        """Faults of a statement."""
        return self.checker.check(sql)

    def do_run_pick(self, pick: dict) -> Any:
        """Rows of a pick, the first ones."""
        df = self.engine.pick(pick)
        return {"columns": df.columns, "rows": [tuple(r) for r in df.limit(self.rows).collect()]}

    def specs(self) -> list[dict[str, Any]]:
        """Name, description and strict JSON schema of every tool."""
        out = []
        for name, f in self.all.items():
            of = inspect.signature(f).parameters.values()
            properties = {p.name: {"type": KINDS[str(p.annotation)]} for p in of}
            out.append({"name": name, "description": inspect.getdoc(f), "parameters": {"type": "object", "properties": properties, "required": [p.name for p in of if p.default is p.empty], "additionalProperties": False}})
        return out

    def call(self, name: str, arguments: Mapping[str, Any] | None = None) -> Result:
        """A tool's answer as plain data, or why there is none; a mistake of the caller never raises."""
        with trace.span(f"tool {name}") as facts:
            result = self._call(name, dict(arguments or {}))
            facts["ok"] = result.ok
            return result

    def _call(self, name: str, arguments: dict[str, Any]) -> Result:
        if name not in self.all:
            return Result(name, False, {"code": "UNKNOWN_TOOL", "known": sorted(self.all)})
        spec = next(s for s in self.specs() if s["name"] == name)["parameters"]
        kinds = {"string": str, "integer": int, "boolean": bool, "object": dict}
        wrong = [k for k, v in arguments.items() if k not in spec["properties"] or not isinstance(v, kinds[spec["properties"][k]["type"]])]
        if wrong or (missing := [r for r in spec["required"] if r not in arguments]):
            return Result(name, False, {"code": "BAD_ARGUMENTS", "wrong": wrong, "missing": [] if wrong else missing, "expected": spec})
        try:
            return Result(name, True, plain(self.all[name](**arguments)))
        except (PlanError, PySparkException) as e:
            return Result(name, False, {"code": type(e).__name__, "error": str(e)})


def plain(x: Any) -> Any:
    """Dataclasses as dictionaries and tuples as lists, throughout."""
    if dataclasses.is_dataclass(x):
        return {f.name: plain(getattr(x, f.name)) for f in dataclasses.fields(x)}
    if isinstance(x, dict):
        return {k: plain(v) for k, v in x.items()}
    return [plain(v) for v in x] if isinstance(x, (list, tuple)) else x
