"""The engine: a model, its routes and tables; runs plans and picks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import trace
from .operators.lower import Compiler
from .plans.graph import Graph
from .plans.ir import Plan, canonical_key, canonicalise
from .plans.model import GrainError, Model
from .plans.pick import Menu
from .plans.review import Remark, double_counts, review
from .sources import catalog


class Engine:
    def __init__(self, model: Model, tables: Callable[[str], DataFrame], *, elide: bool = True) -> None:
        self.model, self.tables = model, tables
        self.graph = Graph(model)
        self.compiler = Compiler(model, self.graph, tables, elide=elide)

    @classmethod
    def retail(cls, spark: SparkSession, folder: str, *, elide: bool = True) -> Engine:
        """The retail model over a folder's tables, checked against their columns."""
        tables = catalog.parquet(spark, folder)
        bare = catalog.retail()
        return cls(catalog.retail(catalog.schema_of(bare.tables(), tables)), tables, elide=elide)

    def run(self, plan: Plan) -> DataFrame:
        """The plan's rows, or a refusal (PlanError, GrainError), also of a total beside its own summand."""
        with trace.span("compile", subject=plan.subject, measures=len(plan.measures), routes=len(plan.paths)):
            one: Plan | None = plan
            while one is not None:
                if doubled := double_counts(one, self.model):
                    raise GrainError("; ".join(r.message for r in doubled))
                one = one.other
            return self.compiler.compile(plan)

    def key(self, plan: Plan) -> str:
        return canonical_key(plan, self.model)

    def routes(self, plan: Plan) -> list[tuple[str, str, tuple[str, ...]]]:
        """Every route of a plan as it runs: its id, its steps, and the roles that it commits to from the subject on."""
        return [(self.graph.route_id(p), str(p), self.graph.signature(p)) for p in map(self.graph.govern, canonicalise(plan, self.model).paths)]

    def review(self, plan: Plan) -> list[Remark]:
        return review(plan, self.graph)

    def menu(self, concepts: list[str] | None = None, **how) -> Menu:
        return Menu(self.graph, concepts, **how)

    def pick(self, pick: dict, menu: Menu | None = None) -> DataFrame:
        """Rows of a pick; routes are ids of the menu, or of the form From>To#n."""
        return self.run((menu or Menu(self.graph, [pick["subject"]])).parse(pick))
