"""What the data say: values by a ladder of likeness, measured fan-out, facts of columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.graph import Graph, Step
from ..plans.model import Concept, Model, PlanError

Tables = Callable[[str], DataFrame]
LADDER = ("exact", "nocase", "prefix", "contains")


def rows_of(c: Concept, tables: Tables) -> DataFrame:
    """The rows that stand for a concept."""
    df = tables(c.table)
    return df.where(F.col(c.backed_where[0]) == F.lit(c.backed_where[1])) if c.backed_where else df


def _column(model: Model, concept: str, attribute: str) -> tuple[str, str, str]:
    """(concept, attribute, column) where a value stands, over edges that reach it."""
    c = model.concepts.get(concept)
    if c is None or attribute not in c.attributes:
        raise PlanError(f"no attribute {concept}.{attribute}")
    a = c.attributes[attribute]
    if a.via:
        e = model.edges[a.via]
        return _column(model, e.target if e.source == concept else e.source, a.attribute)
    if not a.searchable:
        raise PlanError(f"{concept}.{attribute} isn't searchable")
    return concept, attribute, a.column


def search_values(model: Model, tables: Tables, concept: str, attribute: str, text: str, *, limit: int = 25) -> DataFrame:
    """(value, match) of the first rung of the ladder that has any; limit is the report's length."""
    owner, _, column = _column(model, concept, attribute)
    c = model.concepts[owner]
    df = rows_of(c, tables)
    v, low = F.col(column).cast("string"), text.lower()
    rung = F.when(v == text, 0).when(F.lower(v) == low, 1).when(F.lower(v).startswith(low), 2).when(F.lower(v).contains(low), 3)
    found = df.where(F.trim(v) != "").select(v.alias("value"), rung.alias("__rung")).where("__rung is not null").distinct()
    named = F.element_at(F.array(*map(F.lit, LADDER)), F.col("__rung") + 1)
    # the best rung comes first and, of it, as many as the report shows: one pass, then a window over these
    top = found.orderBy("__rung", "value").limit(limit)
    return top.withColumn("__best", F.min("__rung").over(Window.partitionBy(F.lit(0)))).where(F.col("__rung") == F.col("__best")).select("value", named.alias("match")).orderBy("value")


def fan_out(model: Model, graph: Graph, tables: Tables, edge: str, forward: bool = True) -> DataFrame:
    """One row: origins, largest and mean number of rows that each meets, those that meet none, and whether the model denies it."""
    step = Step(edge, forward)
    e = graph.edge(step)
    ends = []
    for name in (graph.start(step), graph.landing(step)):
        ends.append(rows_of(model.concepts[name], tables))
    origin, far = ends
    if e.via_table:
        near, beyond = (e.from_join, e.to_join) if forward else (tuple((t, j) for j, t in e.to_join), tuple((j, s) for s, j in e.from_join))
        via = tables(e.via_table)
        via = via.where(F.col(e.predicate[0]) == F.lit(e.predicate[1])) if e.predicate else via
        there = far.select(*(F.col(t).alias(f"__t{i}") for i, (_, t) in enumerate(beyond)))
        rows = via.join(there, [F.col(j) == F.col(f"__t{i}") for i, (j, _) in enumerate(beyond)]).select(*(F.col(j).alias(f"__k{i}") for i, (_, j) in enumerate(near)))
        own = [o for o, _ in near]
    else:
        pairs = e.join if forward else tuple((b, a) for a, b in e.join)
        if e.restrict_table:
            marker = tables(e.restrict_table).select(*(F.col(b).alias(f"__r{i}") for i, (_, b) in enumerate(e.restrict_columns)))
            on = [F.col(a) == F.col(f"__r{i}") for i, (a, _) in enumerate(e.restrict_columns)]
            far, origin = (far.join(marker, on, "left_semi"), origin) if forward else (far, origin.join(marker, on, "left_semi"))
        rows, own = far.select(*(F.col(b).alias(f"__k{i}") for i, (_, b) in enumerate(pairs))), [a for a, _ in pairs]
    counts = rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))  # before the join, so no row is multiplied
    met = origin.select(*(F.col(o).alias(f"__o{i}") for i, o in enumerate(own))).join(counts, [F.col(f"__o{i}") == F.col(f"__k{i}") for i in range(len(own))], "left")
    out = met.agg(F.count("*").alias("origins"), F.coalesce(F.max("n"), F.lit(0)).cast("long").alias("largest"), (F.coalesce(F.sum("n"), F.lit(0)) / F.count("*")).alias("mean"), F.count(F.when(F.col("n").isNull(), 1)).alias("orphans"))
    return out.withColumn("contradicted", F.lit(not graph.multiplies(step)) & (F.col("largest") > 1)).select(F.lit(edge).alias("edge"), F.lit(forward).alias("forward"), "*")


def column_facts(model: Model, tables: Tables, concept: str) -> DataFrame:
    """One row for each attribute with a column: rows, nulls, blanks and distinct values.

    Values are counted by column first, with partial aggregation, so distinct ones cost a grouped
    count and not an expansion of every row for a distinct aggregate of each column.
    """
    c = model.concepts[concept]
    own = [a for a in c.attributes.values() if a.column]
    each = F.array(*(F.struct(F.lit(i).alias("i"), F.col(a.column).isNull().alias("empty"), F.col(a.column).cast("string").alias("v")) for i, a in enumerate(own)))
    counts = rows_of(c, tables).select(F.explode(each).alias("z")).groupBy("z.i", "z.empty", "z.v").agg(F.count("*").alias("n"))
    total = lambda rows: F.coalesce(F.sum(F.when(rows, F.col("n"))), F.lit(0))
    facts = counts.groupBy("i").agg(F.sum("n").alias("rows"), total(F.col("empty")).alias("nulls"), total(F.trim("v") == "").alias("blanks"), F.count(F.when(~F.col("empty"), 1)).alias("distinct_values"))
    names = F.element_at(F.array(*(F.lit(a.name) for a in own)), F.col("i") + 1)
    some = facts.select(names.alias("attribute"), "rows", "nulls", "blanks", "distinct_values")
    none = tables(c.table).sparkSession.createDataFrame([(a.name,) for a in own], "attribute string")  # an empty table has facts, too
    return none.join(some, "attribute", "left").select("attribute", *(F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("rows", "nulls", "blanks", "distinct_values")))


def key_report(model: Model, tables: Tables) -> DataFrame:
    """One row for each concept with a key: its rows, those that repeat a key, and whether it holds."""
    out = []
    for c in model.concepts.values():
        if c.key:
            counts = rows_of(c, tables).groupBy(*c.key).agg(F.count("*").alias("n"))
            out.append(counts.agg(F.lit(c.name).alias("concept"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeats")))
    return reduce(DataFrame.unionByName, out).withColumn("holds", F.col("repeats") == 0)


def cardinality(graph: Graph, tables: Tables, edge: str) -> DataFrame:
    """Largest fan-out of an edge both ways and whether it is functional."""
    there, back = (fan_out(graph.model, graph, tables, edge, f).select(F.col("largest").alias(n)) for f, n in ((True, "forward_largest"), (False, "reverse_largest")))
    return there.crossJoin(back).select(F.lit(edge).alias("edge"), "*", (F.col("forward_largest") <= 1).alias("functional"))  # one row each
