"""Picks, lookups, profiles and the check of SQL, on the retail model."""

import pytest

from ledgerline.engine import Engine
from ledgerline.functions import lookup
from ledgerline.functions.columns import period
from ledgerline.operators import profile
from ledgerline.operators.check import Checker, blocking
from ledgerline.plans.model import GrainError, PlanError
from ledgerline.queries import NATIONS

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def engine(spark):
    return Engine.retail(spark, DIR)


@pytest.fixture(scope="module")
def checker(spark, engine):
    for t in engine.model.tables():
        engine.tables(t).createOrReplaceTempView(t)
    return Checker(spark, engine.model, engine.tables)


def codes(checker, sql, **how):
    return {f.code for f in checker.check(sql, **how)}


def test_clean_statements(checker):
    assert not codes(checker, f"select n_name, sum(l_quantity) from {NATIONS} group by 1")
    assert not codes(checker, "select c_mktsegment, count(distinct o_orderkey) from customer join orders on o_custkey = c_custkey where o_orderstatus = 'F' group by 1")
    assert not codes(checker, "select c_custkey, sum(c_acctbal) from customer left semi join orders on o_custkey = c_custkey group by 1")
    assert not codes(checker, "with n as (select n_nationkey, n_name from nation) select n_name, avg(c_acctbal) from customer join n on c_nationkey = n.n_nationkey group by 1")


@pytest.mark.parametrize("sql, code", [
    ("select from where", "PARSE_ERROR"),
    ("create table x (a int) using parquet", "UNSUPPORTED_STATEMENT"),
    ("select * from nowhere", "UNKNOWN_TABLE"),
    ("select 1 from customer join supplier on c_custkey = s_suppkey", "UNDECLARED_JOIN"),
    ("select 1 from orders join lineitem on l_orderkey < o_orderkey", "UNDECLARED_JOIN"),
    ("select 1 from nation cross join region", "CARTESIAN"),
    ("select sum(o_totalprice) from orders join lineitem on l_orderkey = o_orderkey", "GRAIN_FANOUT"),
    ("select n_name, sum(s_acctbal) from supplier join nation on s_nationkey = n_nationkey join customer on c_nationkey = n_nationkey group by 1", "GRAIN_FANOUT"),
    ("select 1 from customer where c_mktsegment = 'NOTHING'", "UNGROUNDED_LITERAL"),
    ("select c_name from customer union select s_name from supplier", "UNDECIDABLE"),
    ("select row_number() over (order by c_name) from customer", "UNDECIDABLE"),
])
def test_faults(checker, sql, code):
    assert code in codes(checker, sql)


def test_literals_that_nearly_occur(checker):
    found = {f.message for f in checker.check("select 1 from customer where c_mktsegment in ('building', 'NOTHING') and c_custkey = -1 and c_name like 'customer%'")}
    assert len(found) == 3 and sum("another case" in m for m in found) == 2
    assert not codes(checker, "select 1 from customer where c_mktsegment like 'BUILD%' and c_custkey = 1") and not codes(checker, "select 1 from customer where c_mktsegment = 'x'", literals=False)


def test_exempt_and_absorbed(checker):
    join = "orders join lineitem on l_orderkey = o_orderkey"
    assert not codes(checker, f"select max(o_totalprice), count(distinct o_orderkey) from {join}")
    assert codes(checker, f"select count(*) from {join}") == {"GRAIN_FANOUT"}  # orders are counted once for each line
    assert not codes(checker, f"select o_orderkey, count(*) from {join} group by 1") and not codes(checker, "select count(*) from lineitem")
    assert not codes(checker, "select count(*) from orders left semi join lineitem on l_orderkey = o_orderkey")
    undecided = checker.check("select c_name from customer union select s_name from supplier")
    assert not blocking(undecided) and blocking(undecided, strict=True)


TOTALS = "(select o_custkey, sum(o_totalprice) as t from orders group by o_custkey)"
BILLS = "(select o_orderkey, o_custkey, sum(l_extendedprice) as gross from orders join lineitem on l_orderkey = o_orderkey group by o_orderkey, o_custkey)"


@pytest.mark.parametrize("sql", [
    # formed at the grain of the join, by the same column or by an edge
    f"select c_mktsegment, sum(t) from customer join {TOTALS} o on o_custkey = c_custkey group by 1",
    f"select o.o_custkey, sum(gross) from orders o join {BILLS} b on b.o_orderkey = o.o_orderkey group by 1",
    "with p as (select distinct o_custkey from orders where o_orderstatus = 'F') select c_mktsegment, count(c_custkey) from customer join p on p.o_custkey = c_custkey group by 1",
    "select avg(t) from (select o_custkey, sum(o_totalprice) as t from orders group by o_custkey) x",
    # exactly once: the shared value reduced by its own key first
    "select p_brand, sum(t) from (select distinct p_brand, o_orderkey, o_totalprice as t from part join lineitem on l_partkey = p_partkey join orders on l_orderkey = o_orderkey) x group by 1",
    # totals of one row each may stand side by side
    "select a.x / b.y from (select sum(c_acctbal) as x from customer) a cross join (select sum(s_acctbal) as y from supplier) b",
    # listings
    "select c_name, o_orderkey from customer join orders on o_custkey = c_custkey",
    "select c_name, s_name from customer join nation on c_nationkey = n_nationkey join supplier on s_nationkey = n_nationkey",
    # metrics as the model has them
    "select n_name, sum(l_extendedprice * (1 - l_discount)) as revenue from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1",
    "select o_orderpriority, sum(l_extendedprice) + sum(l_extendedprice * l_tax) as bill from lineitem join orders on l_orderkey = o_orderkey group by 1",
    "select l_linestatus, case when count(distinct o_orderkey) = 0 then null else sum(l_extendedprice * (1 - l_discount)) / count(distinct o_orderkey) end as revenue_per_order from lineitem join orders on l_orderkey = o_orderkey group by 1",
    "with r as (select sum(l_extendedprice * (1 - l_discount)) as v from lineitem), o as (select count(distinct o_orderkey) as n from orders) select r.v / o.n as RevenuePerOrder from r cross join o",
])
def test_subqueries_and_metrics_that_hold(checker, sql):
    assert not codes(checker, sql)


@pytest.mark.parametrize("sql, code", [
    # the join doesn't cover the subquery's grain, so its rows multiply
    (f"select sum(c_acctbal) from customer join {BILLS} b on b.o_custkey = c_custkey", "GRAIN_FANOUT"),
    (f"select sum(t) from orders x join {TOTALS} y on y.o_custkey = x.o_custkey", "GRAIN_FANOUT"),
    ("select sum(o_totalprice) from (select 1 as one from region group by 1) x cross join (select distinct o_orderkey, o_totalprice from orders) y", "CARTESIAN"),
    # faults inside
    ("select max(t) from (select o_custkey, sum(o_totalprice) as t from orders join lineitem on l_orderkey = o_orderkey group by o_custkey) x", "GRAIN_FANOUT"),
    ("select avg(n) from (select c_custkey, count(*) as n from customer join supplier on c_custkey = s_suppkey group by 1) x", "UNDECLARED_JOIN"),
    # no edge between what the columns come from
    (f"select sum(t) from supplier join {TOTALS} y on y.o_custkey = s_suppkey", "UNDECLARED_JOIN"),
    ("select 1 from customer join (select max(o_totalprice) as m from orders group by o_custkey) x on m = c_acctbal", "UNDECIDABLE"),
    # a total per customer beside each of the customer's orders, though it could be formed per order
    ("select o.o_orderkey, sum(t) from (select c_custkey, sum(o_totalprice) as t from customer join orders on o_custkey = c_custkey group by c_custkey) x join orders o on o.o_custkey = x.c_custkey group by 1", "GRAIN_MISMATCH"),
    # an order's total for each of its lines, added up again
    ("select sum(t) from (select l_orderkey, l_linenumber, l_partkey, l_suppkey, o_totalprice as t from lineitem join orders on l_orderkey = o_orderkey group by 1, 2, 3, 4, 5) x", "GRAIN_MISMATCH"),
    # two amounts below one nation, and one table twice
    ("select c_acctbal, s_acctbal from customer join nation on c_nationkey = n_nationkey join supplier on s_nationkey = n_nationkey", "ROW_FANOUT"),
    ("select a.c_name, b.c_name from customer a join nation on a.c_nationkey = n_nationkey join customer b on b.c_nationkey = n_nationkey", "ROW_FANOUT"),
    # metrics formed otherwise
    ("select n_name, sum(l_extendedprice) as revenue from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1", "METRIC_FIDELITY"),
    ("select avg(l_quantity) as Quantity from lineitem", "METRIC_FIDELITY"),
    ("select o_orderpriority, sum(l_extendedprice) as bill from lineitem join orders on l_orderkey = o_orderkey group by 1", "METRIC_FIDELITY"),
    ("select count(distinct o_orderkey) / sum(l_extendedprice * (1 - l_discount)) as revenue_per_order from lineitem join orders on l_orderkey = o_orderkey", "METRIC_FIDELITY"),
    ("select l_quantity as Quantity from lineitem", "METRIC_FIDELITY"),
])
def test_faults_of_subqueries_and_metrics(checker, sql, code):
    assert code in codes(checker, sql)


def test_picks(engine):
    menu = engine.menu(["LineItem", "Order", "Customer"])
    assert menu.token_size() > 0 and len(menu.routes) == len(set(menu.routes.values()))
    schema = menu.schema()
    assert schema["properties"]["subject"]["enum"] == ["Customer", "LineItem", "Order"] and "over" in schema["$defs"]["measure"]["properties"]
    pick = {"subject": "LineItem", "dimensions": [{"route": "Order>Customer#1", "attribute": "segment"}], "routes": ["LineItem>Order#1"], "measures": [{"metric": "Revenue", "over": None}], "top": None}
    plan = menu.parse(pick)
    assert str(plan.paths[1]) == "LineItem OF_ORDER> PLACED_BY>" and engine.run(plan).count() == 5
    for bad in ({"subject": "LineItem", "colour": 1}, {}, {"subject": "Region", "dimensions": [{"route": "Order>Customer#1"}]}):
        with pytest.raises(PlanError):
            menu.parse(bad)


def test_words(engine):
    assert lookup.tokens("OrderDetails of HTTPServers2") == ("order", "details", "of", "http", "servers", "2")
    assert all(lookup.alike(a, b) and lookup.alike(b, a) for a, b in (("loss", "losses"), ("country", "countries"), ("order", "orders"), ("x", "x")))
    assert not lookup.alike("bus", "bu s") and not lookup.alike("order", "ordered") and not lookup.alike("loss", "los t")
    scores = [lookup.score(a, b) for a, b in (("loss", "Losses"), ("date of order", "order of date"), ("order date", "the order date"), ("a b", "b c"), ("a", "b"), ("", ""), ("a a", "a"))]
    assert scores == [100, 95, 80, 50, 0, 0, 66]
    m = engine.model
    assert lookup.find_metric(m, "number of orders").names == ("OrderCount",) and lookup.find_metric(m, "zzz").status == "absent"
    assert lookup.find_attribute(m, "market segment").status == "unique"
    assert lookup.search(m, "revenue")[0] == lookup.Hit("metric", "Revenue", 100)
    assert lookup.expand_metric(m, "OrderBill")["components"][0]["of"] == "LineItem.gross"
    assert "without evidence" in lookup.metadata_report(m)
    assert [str(d) for d in period("2024-02")] == ["2024-02-01", "2024-02-29"] and str(period("2023")[1]) == "2023-12-31"
    with pytest.raises(PlanError):
        period("soon")


def test_profiles(engine):
    keys = {r["concept"]: r["holds"] for r in profile.key_report(engine.model, engine.tables).collect()}
    assert keys["Order"] and keys["LineItem"]
    facts = profile.fan_out(engine.model, engine.graph, engine.tables, "OF_ORDER").first()
    assert facts["largest"] == 1 and not facts["contradicted"] and facts["orphans"] == 0
    with pytest.raises(PlanError):
        profile.search_values(engine.model, engine.tables, "Customer", "balance", "1")


def test_descriptions_and_routes(engine):
    m, g = engine.model, engine.graph
    d = lookup.describe_concept(m, g, "Order")
    assert "OrderBill" in d["metrics"] and any(e["edge"] == "OF_ORDER" and e["several"] for e in d["edges"])
    assert lookup.list_subjects(m, g, "Region")[0] == ("Nation", 1) and len(lookup.list_concepts(m)) == len(m.concepts)
    assert lookup.describe_concept(m, g, "Region", engine.tables)["attributes"]["name"]["values"][0] == "AFRICA"
    assert lookup.metric_routes(m, g, "OrderBill", "LineItem")["OrderGross"] == [""] and lookup.metric_routes(m, g, "OrderBill", "Order", 1)["OrderGross"][0].startswith("Order>LineItem#")
    step = lookup.find_paths(g, "Order", "Customer", 1, engine.tables)[0]["steps"][0]
    assert step["measured"]["largest"] == 1 and step["measured"]["orphans"] == 0
    found = lookup.find_paths(g, "Order", "Part")
    assert found[0]["steps"][0]["backing"] == "junction" and found[0]["multiplies"] and g.route(found[1]["id"]) is not None


def test_review(engine):
    from ledgerline.plans.graph import Path, Step
    from ledgerline.plans.ir import Measure, Plan, Projection, Top

    both = Plan("Order", (), (Projection(None, "status"),), (Measure(metric="OrderBill"), Measure(metric="OrderTax")))
    assert [r.code for r in engine.review(both)] == ["DOUBLE_COUNT"]
    with pytest.raises(GrainError, match="part of OrderBill"):
        engine.run(both)
    unused = Plan("Order", (Path("Order", (Step("PLACED_BY"),)),), (), (Measure(metric="OrderTotal"),), top=Top(measure=0))
    assert {r.code for r in engine.review(unused)} >= {"UNUSED_ROUTE", "ORDER_OF_ONE", "NO_LIMIT"}


def test_windows_of_a_stream(spark, tmp_path):
    from ledgerline.streaming.metrics import windowed

    how = {"time": "ts", "every": "1 day", "late": "60 days", "keys": ["event_type"], "measures": {"n": ("count", "event_id"), "total": ("sum", "value")}, "decimals": 2}
    events = spark.read.parquet(f"{DIR}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = windowed(stream, **how).writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    query.awaitTermination()
    want = {tuple(r) for r in windowed(events, **how).collect()}
    assert {tuple(r) for r in spark.table("windows").collect()} == want and len(want) > 5
    with pytest.raises(PlanError):
        windowed(events, **how | {"measures": {"d": ("count_distinct", "user_id")}})
