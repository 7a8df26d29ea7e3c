"""Snapshots, questions, spans, comparison, tools, resolution and requirements, on the retail model."""

import json

import pytest

from ledgerline import trace
from ledgerline.engine import Engine
from ledgerline.functions.tools import Tools
from ledgerline.operators import compare, profile
from ledgerline.operators.check import Checker
from ledgerline.plans.ir import Plan, Projection
from ledgerline.plans.graph import Path, Step
from ledgerline.plans.model import PlanError
from ledgerline.plans.resolve import Wish, narrow, resolve
from ledgerline.sources import catalog
from ledgerline.sources.questions import load_questions
from ledgerline.sources.snapshot import Snapshot, table_digest

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def engine(spark):
    return Engine.retail(spark, DIR)


def test_snapshot_keeps_answers_by_content(spark):
    rows = [(1, "a", None), (2, "b", 0.5), (2, "b", 0.5)]
    df = spark.createDataFrame(rows, "k int, v string, x double")
    assert table_digest(df) == table_digest(df.repartition(3).select("x", "k", "v")) != table_digest(df.distinct())
    assert table_digest(df) != table_digest(df.withColumn("k", df.k.cast("long")))
    held = {"t": df}
    s = Snapshot(spark, held.__getitem__, {"t"}, longest=2)
    first = s.rows("select k, count(*) from t where v <> :v group by 1 order by 1", v="z")
    assert first == ((1, 1), (2, 2)) and s.has("T") and not s.has("u")
    held["t"] = df.where("k = 1")
    assert s.rows("select k, count(*) from t where v <> :v group by 1 order by 1", v="z") is first
    s.renew()
    assert s.rows("select k, count(*) from t where v <> :v group by 1 order by 1", v="z") == ((1, 1),)
    held["t"] = df
    with pytest.raises(ValueError, match="rows"):
        s.rows("select * from t")


def test_questions(tmp_path):
    path = tmp_path / "q.yaml"
    path.write_text("- {id: a, text: How many, gold: select 1, ordered: true, tags: [x]}\n- {text: Which}\n")
    one, two = load_questions(path)
    assert (one.id, one.gold, one.ordered, one.tags, two.id, two.gold) == ("a", "select 1", True, ("x",), "1", None)
    for bad in ("{}", "- {id: a}", "- {text: a, colour: b}", "- {id: a, text: a}\n- {id: a, text: b}"):
        path.write_text(bad)
        with pytest.raises(ValueError):
            load_questions(path)
    path.write_text("")
    assert load_questions(path) == []


def test_spans(engine, tmp_path):
    path = tmp_path / "spans" / "t.jsonl"
    trace.to(path)
    try:
        engine.run(Plan("Region", projections=(Projection(),)))
        with pytest.raises(PlanError):
            with trace.span("outer", n=1) as facts:
                facts["more"] = 2
                engine.run(Plan("Nowhere", projections=(Projection(),)))
    finally:
        trace.to(None)
    lines = [json.loads(x) for x in path.read_text().splitlines()]
    assert [x["span"] for x in lines] == ["compile", "outer/compile", "outer"] and lines[0]["error"] is None and "PlanError" in lines[2]["error"] and lines[2]["more"] == 2
    engine.run(Plan("Region", projections=(Projection(),)))
    assert len(path.read_text().splitlines()) == 3


def test_results_are_compared_as_bags(spark):
    a = spark.createDataFrame([(1, "x", 0.1), (1, "x", 0.1), (2, None, None)], "a int, b string, c double")
    b = spark.createDataFrame([(2, None, None), (1, "x", 0.10000001), (1, "x", 0.1)], "p long, q string, r double")
    assert compare.difference(a, b).same and compare.result_key(a) == compare.result_key(b)
    assert compare.difference(a, b.distinct()).left == 0 or not compare.difference(a, b.limit(2)).same
    only = compare.difference(a, a.where("a = 1").union(a.where("a = 1")))
    assert (only.left, only.right) == (1, 2) and compare.result_key(a) != compare.result_key(a.distinct())
    assert compare.difference(a, a.select("a")).reason and not compare.difference(a, a.select("a")).same
    none = a.limit(0)
    assert compare.difference(none, none).same and compare.result_key(none) == compare.result_key(none.select("a", "b", "c"))
    up, down = a.orderBy("a"), a.orderBy(a.a.desc())
    assert compare.in_order(up, up) and not compare.in_order(up, down)
    with pytest.raises(ValueError):
        compare.in_order(a, a, longest=2)


def test_steadiness(spark):
    runs = [("q1", "k1", True, False)] * 3 + [("q1", "k2", False, False)] + [("q2", "", False, True)] * 4 + [("q3", "k", True, False)]
    out = {r["question"]: r for r in compare.steadiness(spark.createDataFrame(runs, "question string, key string, correct boolean, refused boolean")).collect()}
    assert (out["q1"]["runs"], out["q1"]["correct"], out["q1"]["results"], out["q1"]["agreement"]) == (4, 3, 2, 0.5)
    assert (out["q2"]["refused"], out["q2"]["results"], out["q2"]["agreement"], out["q3"]["agreement"]) == (4, 0, 0.0, None)


def test_json_sink(spark, tmp_path):
    catalog.write_json(spark.createDataFrame([(1, "a")], "k int, v string"), str(tmp_path / "out"), {"plan": "x"})
    assert [tuple(r) for r in spark.read.json(str(tmp_path / "out")).collect()] == [(1, "a")]
    assert spark.read.json(str(tmp_path / "out.provenance")).first()["value"] == "x"


def test_tools(spark, engine):
    for t in engine.model.tables():
        engine.tables(t).createOrReplaceTempView(t)
    tools = Tools(engine, Checker(spark, engine.model, engine.tables), rows=3)
    assert {s["name"] for s in tools.specs()} == set(tools.all) and all(s["description"] and s["parameters"]["additionalProperties"] is False for s in tools.specs())
    assert tools.call("find_metric", {"words": "revenue"}).data["names"] == ["Revenue"]
    assert tools.call("find_paths", {"source": "Order", "target": "Region"}).data[0]["id"] == "Order>Region#1"
    assert tools.call("check_sql", {"sql": "select 1 from nation cross join region"}).data[0]["code"] == "CARTESIAN"
    ran = tools.call("run_pick", {"pick": {"subject": "Order", "dimensions": [{"attribute": "priority"}], "measures": [{"metric": "OrderCount"}]}})
    assert ran.ok and len(ran.data["rows"]) == 3 and ran.data["columns"] == ["priority", "OrderCount"]
    assert tools.call("search_values", {"concept": "Order", "attribute": "status", "text": "f"}).data == [["F", "nocase"]]
    codes = [tools.call(*x).data["code"] for x in (("nothing",), ("search", {}), ("search", {"words": 1}), ("search", {"words": "a", "b": 1}), ("describe_concept", {"name": "Nowhere"}))]
    assert codes == ["UNKNOWN_TOOL", "BAD_ARGUMENTS", "BAD_ARGUMENTS", "BAD_ARGUMENTS", "PlanError"]
    assert "check_sql" not in Tools(engine).all and all(tools.call(n, {}).ok for n in ("list_concepts",))


def test_resolution_of_a_question(engine):
    m, g = engine.model, engine.graph
    look = lambda c, a, text: [r["value"] for r in profile.search_values(m, engine.tables, c, a, text).collect() if r["match"] in ("exact", "nocase")]
    question = "What was the revenue of customers in building by nation in 1996-02, the top five?"
    wish = Wish(("LineItem", "Nobody"), ("revenue", "sorrow"), ("customer segment",), ("building", "unheard of"), ("1996-02", "someday"), ranks=("top five",))
    r = resolve(wish, question, m, g, look)
    assert r.subjects == ["LineItem", "Nation", "Customer"] or set(r.subjects) == {"LineItem", "Nation", "Customer"}
    assert r.metrics == ["Revenue"] and set(r.recovered) == {"Nation", "Customer"} and r.periods == {"1996-02": ("1996-02-01", "1996-02-29")}
    assert ("Customer.segment", "BUILDING") in r.values["building"]
    assert {("subject", "Nobody"), ("quantity", "sorrow"), ("value", "unheard of"), ("period", "someday")} <= set(r.unresolved)
    assert ("quantities", "sorrow") in r.elsewhere and ("values", "building") not in r.elsewhere
    assert g.route_id(g.paths("LineItem", "Customer")[0]) in r.routes


def test_definitions_and_listings(engine):
    m, g = engine.model, engine.graph
    r = resolve(Wish(("Order",), definitions=(("cost", ("order gross", "order tax")), ("odd", ("revenue", "quantity")), ("bad", ("revenue", "sorrow")))), "cost of each order", m, g)
    assert r.metrics == ["OrderBill"] and r.composed == [("odd", ("Revenue", "Quantity"))] and r.unresolved == [("definition", "sorrow")] and not r.identities
    assert resolve(Wish(("Customer", "Nation")), "customers and their nations", m, g).identities == ["Customer.name", "Nation.name"]


def test_narrowed_schema(engine):
    m, g = engine.model, engine.graph
    schema = engine.menu(["LineItem", "Order", "Customer"]).schema()
    wish = Wish(("Order",), ("order total",), ("market segment",))
    found = resolve(wish, "order total by market segment", m, g)
    found.routes += [i for i, p in engine.menu(["LineItem", "Order", "Customer"]).routes.items() if p.source == "Order"]
    small = narrow(schema, found, wish)
    assert small["properties"]["subject"]["enum"] == ["Order"] and small["$defs"]["measure"]["properties"]["metric"]["enum"] == ["OrderTotal", None]
    assert not {"top", "having", "filters"} & set(small["properties"]) and set(schema["properties"]) > set(small["properties"])
    assert set(small["properties"]["dimensions"]["items"]["properties"]["attribute"]["enum"]) == {"segment", "id", None}
    assert len(small["properties"]["routes"]["items"]["enum"]) < len(schema["properties"]["routes"]["items"]["enum"])
    same = narrow(schema, resolve(Wish(), "", m, g), Wish(ranks=("x",), comparisons=("y",)))
    assert same == schema


def test_requirements_of_a_statement(spark, engine):
    for t in engine.model.tables():
        engine.tables(t).createOrReplaceTempView(t)
    checker = Checker(spark, engine.model, engine.tables)
    need = checker.requirements("select n_name, sum(o_totalprice) from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where c_mktsegment = 'BUILDING' group by 1")
    assert need["concepts"] == ["Customer", "Nation", "Order"] and {"Nation.name", "Order.total", "Customer.segment"} <= set(need["attributes"]) and {"LIVES_IN", "PLACED_BY"} <= set(need["edges"])
    assert checker.requirements("select count(*) from orders where o_orderpriority = '1-URGENT'")["concepts"] == ["UrgentOrder"]


def test_routes_as_they_run(engine):
    twice = Path("ReturnedItem", (Step("RETURNED_FROM"),))
    plan = Plan("ReturnedItem", (twice, twice), (Projection(0, "status"), Projection(1, "priority")))
    assert engine.routes(plan) == [("ReturnedItem>Order#1", str(twice), ("RET", ""))]
