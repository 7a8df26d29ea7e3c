"""Registered queries over the retail model, each with the SQL that states what it must give."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .functions.columns import period
from .operators import profile
from .plans.graph import Path, Step
from .plans.ir import Filter, Having, Measure, Plan, Projection, Top

Query = Callable[[SparkSession, str], DataFrame]


def _route(source: str, *steps: str) -> Path:
    """A route; a step that ends in < goes against its edge."""
    return Path(source, tuple(Step(s.rstrip("<>"), not s.endswith("<")) for s in steps))


LINE_ORDER = _route("LineItem", "OF_ORDER")
LINE_CUSTOMER = _route("LineItem", "OF_ORDER", "PLACED_BY")
LINE_NATION = _route("LineItem", "OF_ORDER", "PLACED_BY", "LIVES_IN")
LINE_SUPPLIER_NATION = _route("LineItem", "SUPPLIED_BY", "BASED_IN")
NATION_LINES = _route("Nation", "LIVES_IN<", "PLACED_BY<", "OF_ORDER<")
NATION_SUPPLIERS = _route("Nation", "BASED_IN<")
NATION_CUSTOMERS = _route("Nation", "LIVES_IN<")
NATION_ORDERS = _route("Nation", "LIVES_IN<", "PLACED_BY<")
CUSTOMER_ORDERS = _route("Customer", "PLACED_BY<")
CUSTOMER_LINES = _route("Customer", "PLACED_BY<", "OF_ORDER<")
PART_ORDERS = _route("Part", "OF_PART<", "OF_ORDER")
PART_LINES = _route("Part", "OF_PART<")

NET = "cast(l_extendedprice as decimal(18,2)) * (1 - cast(l_discount as decimal(4,2)))"
TAX = "cast(l_extendedprice as decimal(18,2)) * cast(l_tax as decimal(4,2))"
REVENUE = f"sum(cast({NET} as decimal(18,4)))::double"
money = lambda c: f"sum(cast({c} as decimal(18,2)))::double"
LINES = "lineitem join orders on l_orderkey = o_orderkey"
CUSTOMERS = f"{LINES} join customer on o_custkey = c_custkey"
NATIONS = f"{CUSTOMERS} join nation on c_nationkey = n_nationkey"

P, M = Projection, Measure
PLANS: dict[str, tuple[Plan, str]] = {
    # scans and projections
    "scan_concept": (Plan("Region", projections=(P(None, "id"), P(None, "name"))), "select r_regionkey as id, r_name as name from region"),
    "project_display": (Plan("Nation", projections=(P(),)), "select n_name as name from nation"),
    "role_object_scan": (Plan("UrgentOrder", projections=(P(None, "id"), P(None, "total"))), "select o_orderkey as id, o_totalprice as total from orders where o_orderpriority = '1-URGENT'"),
    "via_attribute": (Plan("Customer", projections=(P(None, "id"), P(None, "nation_name"))), "select c_custkey as id, n_name as name from customer join nation on c_nationkey = n_nationkey"),
    "via_attribute_twice": (Plan("Customer", projections=(P(None, "id"), P(None, "region_name"))), "select c_custkey as id, r_name as name from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey"),
    # filters
    "filter_eq": (Plan("Order", projections=(P(None, "id"),), filters=(Filter("status", "=", "F"),)), "select o_orderkey as id from orders where o_orderstatus = 'F'"),
    "filter_ne": (Plan("Customer", projections=(P(None, "id"),), filters=(Filter("segment", "!=", "BUILDING"),)), "select c_custkey as id from customer where c_mktsegment <> 'BUILDING'"),
    "filter_lt": (Plan("Supplier", projections=(P(None, "id"),), filters=(Filter("balance", "<", 1000),)), "select s_suppkey as id from supplier where s_acctbal < 1000"),
    "filter_ge": (Plan("Part", projections=(P(None, "id"),), filters=(Filter("size", ">=", 40),)), "select p_partkey as id from part where p_size >= 40"),
    "filter_like": (Plan("Part", projections=(P(None, "id"), P(None, "name")), filters=(Filter("name", "LIKE", "%RING%"),)), "select p_partkey as id, p_name as name from part where p_name ilike '%RING%'"),
    "filter_in": (Plan("Order", projections=(P(None, "id"), P(None, "priority")), filters=(Filter("priority", "IN", ["1-URGENT", "5-LOW"]),)), "select o_orderkey as id, o_orderpriority as priority from orders where o_orderpriority in ('1-URGENT', '5-LOW')"),
    "filter_between_dates": (Plan("Order", measures=(M(metric="OrderTotal"),), projections=(P(None, "status"),), filters=(Filter("ordered", "BETWEEN", ["1996-01-01", "1996-12-31"]),)), f"select o_orderstatus as status, {money('o_totalprice')} as \"OrderTotal\" from orders where cast(o_orderdate as date) between date '1996-01-01' and date '1996-12-31' group by 1"),
    "filter_period": (Plan("Order", measures=(M(metric="OrderTotal"), M(metric="OrderCount")), projections=(P(None, "priority"),), filters=(Filter("ordered", "BETWEEN", list(map(str, period("1996-02")))),)), f"select o_orderpriority as priority, {money('o_totalprice')} as \"OrderTotal\", count(distinct o_orderkey) as \"OrderCount\" from orders where cast(o_orderdate as date) between date '1996-02-01' and date '1996-02-29' group by 1"),
    "filter_through_fanout": (Plan("Nation", (NATION_CUSTOMERS, NATION_ORDERS), (P(),), (M(metric="CustomerBalance", path=0),), (Filter("priority", "=", "1-URGENT", 1),)), f"select n_name as name, {money('c_acctbal')} as \"CustomerBalance\" from nation join customer on c_nationkey = n_nationkey where exists (select 1 from customer c2 join orders on o_custkey = c2.c_custkey where c2.c_custkey = customer.c_custkey and o_orderpriority = '1-URGENT') group by 1"),
    "filter_on_unprojected_route": (Plan("Customer", (CUSTOMER_ORDERS,), (P(None, "id"),), filters=(Filter("total", ">", 400000, 0),)), "select c_custkey as id from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 400000)"),
    # joins
    "join_direct": (Plan("Order", (_route("Order", "PLACED_BY"),), (P(None, "id"), P(0, "name"))), "select o_orderkey as id, c_name as name from orders join customer on o_custkey = c_custkey"),
    "join_reverse": (Plan("Region", (_route("Region", "IN_REGION<"),), (P(), P(0))), "select r_name as name, n_name as name_2 from region join nation on n_regionkey = r_regionkey"),
    "join_junction": (Plan("Order", (_route("Order", "CONTAINS_PART"),), (P(None, "priority"),), (M(aggregation="count_distinct", attribute="id", path=0),)), "select o_orderpriority as priority, count(distinct p_partkey) as count_distinct_id from orders join lineitem on l_orderkey = o_orderkey join part on l_partkey = p_partkey group by 1"),
    "join_role_junction": (Plan("Order", (_route("Order", "CONTAINS_RETURNED_PART"),), (P(None, "priority"),), (M(aggregation="count_distinct", attribute="id", path=0),)), "select o_orderpriority as priority, count(distinct p_partkey) as count_distinct_id from orders join lineitem on l_orderkey = o_orderkey join part on l_partkey = p_partkey where l_returnflag = 'R' group by 1"),
    "join_marker": (Plan("Customer", (_route("Customer", "PLACED_WITH_LINES"),), (P(None, "segment"),), (M(metric="OrderTotal", path=0),)), f"select c_mktsegment as segment, {money('o_totalprice')} as \"OrderTotal\" from customer join orders on o_custkey = c_custkey where o_orderkey in (select l_orderkey from lineitem) group by 1"),
    "join_prefix_shared": (Plan("LineItem", (LINE_CUSTOMER, LINE_NATION), (P(0, "segment"), P(1)), (M(metric="Quantity"),)), f"select c_mktsegment as segment, n_name as name, {money('l_quantity')} as \"Quantity\" from {NATIONS} group by 1, 2"),
    "join_self_by_kind": (Plan("LineItem", (LINE_NATION, LINE_SUPPLIER_NATION), (P(0), P(1)), (M(metric="Revenue"),)), f"select c.n_name as name, s.n_name as name_2, {REVENUE} as \"Revenue\" from {CUSTOMERS} join nation c on c_nationkey = c.n_nationkey join supplier on l_suppkey = s_suppkey join nation s on s_nationkey = s.n_nationkey group by 1, 2"),
    "join_composite_key": (Plan("Turn", (_route("Turn", "ANSWERS"),), (P(None, "conversation"),), (M(aggregation="count", attribute="number", path=0),)), "select conv_id as conversation, count(*) as count_number from conversations where role = 'assistant' group by 1"),
    # aggregates
    "agg_sum": (Plan("LineItem", (LINE_NATION,), (P(0),), (M(metric="Revenue"),)), f"select n_name as name, {REVENUE} as \"Revenue\" from {NATIONS} group by 1"),
    "agg_count": (Plan("LineItem", (), (P(None, "flag"), P(None, "status")), (M(metric="LineCount"),)), "select l_returnflag as flag, l_linestatus as status, count(*) as \"LineCount\" from lineitem group by 1, 2"),
    "agg_avg": (Plan("Customer", (), (P(None, "segment"),), (M(metric="MeanBalance"),)), f"select c_mktsegment as segment, {money('c_acctbal')} / count(*) as \"MeanBalance\" from customer group by 1"),
    "agg_min_max": (Plan("Order", (), (P(None, "priority"),), (M(metric="SmallestOrder"), M(metric="LargestOrder"))), "select o_orderpriority as priority, min(o_totalprice) as \"SmallestOrder\", max(o_totalprice) as \"LargestOrder\" from orders group by 1"),
    "agg_count_distinct": (Plan("LineItem", (LINE_ORDER,), (P(None, "flag"),), (M(metric="OrderCount", path=0),)), f"select l_returnflag as flag, count(distinct o_orderkey) as \"OrderCount\" from {LINES} group by 1"),
    "agg_grand_total": (Plan("LineItem", (), (), (M(metric="Quantity"),)), f"select {money('l_quantity')} as \"Quantity\" from lineitem"),
    "agg_grand_totals_combined": (Plan("Nation", (NATION_CUSTOMERS, NATION_SUPPLIERS), (), (M(metric="CustomerBalance", path=0), M(metric="SupplierBalance", path=1))), f"select (select {money('c_acctbal')} from customer) as \"CustomerBalance\", (select {money('s_acctbal')} from supplier) as \"SupplierBalance\""),
    "agg_fan_trap_two_measures": (Plan("Nation", (NATION_LINES, NATION_SUPPLIERS), (P(),), (M(metric="Revenue", path=0), M(metric="SupplierBalance", path=1))), f"with r as (select n_name as name, {REVENUE} as v from {NATIONS} group by 1), s as (select n_name as name, {money('s_acctbal')} as v from supplier join nation on s_nationkey = n_nationkey group by 1) select name, r.v as \"Revenue\", s.v as \"SupplierBalance\" from r join s using (name)"),
    "agg_converging_route": (Plan("Part", (PART_ORDERS,), (P(None, "brand"),), (M(metric="OrderTotal", path=0),)), f"select brand, {money('t')} as \"OrderTotal\" from (select distinct p_brand as brand, o_orderkey, o_totalprice as t from part join lineitem on l_partkey = p_partkey join orders on l_orderkey = o_orderkey) group by 1"),
    "agg_raw_counts_each_row_once": (Plan("LineItem", (_route("LineItem", "OF_PART"),), (P(None, "flag"),), (M(aggregation="sum", attribute="price", path=0),)), f"select flag, {money('p')} as sum_price from (select distinct l_returnflag as flag, p_partkey, p_retailprice as p from lineitem join part on l_partkey = p_partkey) group by 1"),
    "agg_output_finer": (Plan("Order", (_route("Order", "PLACED_BY"),), (P(None, "priority"), P(0, "segment")), (M(metric="CustomerBalance", path=0),)), f"select priority, segment, {money('b')} as \"CustomerBalance\" from (select distinct o_orderpriority as priority, c_mktsegment as segment, c_custkey, c_acctbal as b from orders join customer on o_custkey = c_custkey) group by 1, 2"),
    "agg_output_coarser_ratio": (Plan("Part", (PART_LINES, PART_ORDERS), (P(None, "brand"),), (M(combine="divide", parts=(M(metric="Revenue", path=0), M(metric="OrderTotal", path=1))),)), f"with r as (select p_brand as brand, {REVENUE} as v from lineitem join part on l_partkey = p_partkey group by 1), o as (select brand, {money('t')} as v from (select distinct p_brand as brand, o_orderkey, o_totalprice as t from part join lineitem on l_partkey = p_partkey join orders on l_orderkey = o_orderkey) group by 1) select brand, r.v / o.v as \"Revenue_per_OrderTotal\" from r join o using (brand)"),
    "agg_metric_explicit_route": (Plan("Customer", (CUSTOMER_ORDERS,), (P(None, "segment"),), (M(metric="OrderBill", path=0),)), f"select c_mktsegment as segment, {money('l_extendedprice')} + sum(cast({TAX} as decimal(18,4)))::double as \"OrderBill\" from {CUSTOMERS} group by 1"),
    # composites
    "composite_add": (Plan("Order", (), (P(None, "priority"),), (M(metric="OrderBill"),)), f"select o_orderpriority as priority, {money('l_extendedprice')} + sum(cast({TAX} as decimal(18,4)))::double as \"OrderBill\" from {LINES} group by 1"),
    "composite_sub": (Plan("Nation", (NATION_CUSTOMERS, NATION_SUPPLIERS), (P(),), (M(metric="BalanceGap"),)), f"with c as (select n_name as name, {money('c_acctbal')} as v from customer join nation on c_nationkey = n_nationkey group by 1), s as (select n_name as name, {money('s_acctbal')} as v from supplier join nation on s_nationkey = n_nationkey group by 1) select name, c.v - s.v as \"BalanceGap\" from c join s using (name)"),
    "composite_mul": (Plan("LineItem", (), (P(None, "flag"),), (M(metric="QuantitySquared"),)), f"select l_returnflag as flag, {money('l_quantity')} * count(*) as \"QuantitySquared\" from lineitem group by 1"),
    "composite_div": (Plan("LineItem", (LINE_ORDER,), (P(None, "status"),), (M(metric="RevenuePerOrder"),)), f"select l_linestatus as status, {REVENUE} / count(distinct o_orderkey)::double as \"RevenuePerOrder\" from {LINES} group by 1"),
    "composite_grains_mixed": (Plan("Customer", (CUSTOMER_LINES, _route("Customer", "PLACED_BY<", "RETURNED_FROM<")), (P(None, "segment"),), (M(metric="ReturnShare"),)), f"with r as (select c_mktsegment as segment, {REVENUE} as v from {CUSTOMERS} where l_returnflag = 'R' group by 1), a as (select c_mktsegment as segment, {REVENUE} as v from {CUSTOMERS} group by 1) select segment, r.v / a.v as \"ReturnShare\" from r join a using (segment)"),
    "composite_zero_denominator": (Plan("Customer", (), (P(None, "id"),), (M(combine="divide", parts=(M(aggregation="sum", attribute="balance"), M(combine="subtract", parts=(M(aggregation="sum", attribute="balance"), M(aggregation="sum", attribute="balance"))))),)), "select c_custkey as id, cast(null as double) as sum_balance_per_sum_balance_minus_sum_balance from customer"),
    "over_avg_per_grain": (Plan("Order", (), (P(None, "priority"),), (M(metric="OrderBill", over="avg"),)), f"select priority, sum(v) / count(*) as \"avg_OrderBill\" from (select o_orderkey, o_orderpriority as priority, coalesce(round({money('l_extendedprice')} + sum(cast({TAX} as decimal(18,4)))::double, 4), 0) as v from orders left join lineitem on l_orderkey = o_orderkey group by 1, 2) group by 1"),
    "over_max_per_grain": (Plan("Order", (), (P(None, "status"),), (M(metric="OrderBill", over="max"),)), f"select status, max(v) as \"max_OrderBill\" from (select o_orderkey, o_orderstatus as status, coalesce({money('l_extendedprice')}, 0) + coalesce(sum(cast({TAX} as decimal(18,4)))::double, 0) as v from orders left join lineitem on l_orderkey = o_orderkey group by 1, 2) group by 1"),
    # listings, having, order, sets
    "listing_plain": (Plan("Supplier", (_route("Supplier", "BASED_IN"),), (P(None, "name"), P(0))), "select s_name as name, n_name as name_2 from supplier join nation on s_nationkey = n_nationkey"),
    "listing_distinct_revisit": (Plan("Part", (PART_ORDERS,), (P(None, "brand"), P(0, "priority"))), "select distinct p_brand as brand, o_orderpriority as priority from part join lineitem on l_partkey = p_partkey join orders on l_orderkey = o_orderkey"),
    "having_gt": (Plan("Customer", (CUSTOMER_ORDERS,), (P(None, "id"),), (M(metric="OrderCount", path=0),), having=(Having(0, ">", 15),)), "select c_custkey as id, count(distinct o_orderkey) as \"OrderCount\" from customer join orders on o_custkey = c_custkey group by 1 having count(distinct o_orderkey) > 15"),
    "top_k_measure": (Plan("LineItem", (LINE_CUSTOMER,), (P(0, "id"),), (M(metric="Revenue"),), top=Top(10, measure=0)), f"select c_custkey as id, {REVENUE} as \"Revenue\" from {CUSTOMERS} group by 1 order by 2 desc, 1 limit 10"),
    "top_k_projection_tiebreak": (Plan("Order", (), (P(None, "priority"), P(None, "id")), top=Top(20, projection=0, descending=False)), "select o_orderpriority as priority, o_orderkey as id from orders order by 1, 2 limit 20"),
    "union": (Plan("Customer", (), (P(None, "nation_name"),), set_op="union", other=Plan("Supplier", (), (P(None, "nation_name"),))), "select n_name as name from customer join nation on c_nationkey = n_nationkey union select n_name from supplier join nation on s_nationkey = n_nationkey"),
    "intersect": (Plan("Customer", (), (P(None, "nation_name"),), set_op="intersect", other=Plan("Supplier", (), (P(None, "nation_name"),), filters=(Filter("balance", "<", 500),))), "select n_name as name from customer join nation on c_nationkey = n_nationkey intersect select n_name from supplier join nation on s_nationkey = n_nationkey where s_acctbal < 500"),
    "except": (Plan("Nation", (), (P(),), set_op="except", other=Plan("Supplier", (), (P(None, "nation_name"),), filters=(Filter("balance", "<", 500),))), "select n_name as name from nation except select n_name from supplier join nation on s_nationkey = n_nationkey where s_acctbal < 500"),
}


#: Engines by session and folder: the model is read and checked against the tables once.
_engines: dict[tuple[str, str], Engine] = {}


def engine_of(spark: SparkSession, sf_dir: str) -> Engine:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _engines:
        _engines[key] = Engine.retail(spark, sf_dir)
    return _engines[key]


def _planned(plan: Plan) -> Query:
    return lambda spark, sf_dir: engine_of(spark, sf_dir).run(plan)


def _rounded(query: Query, column: str, digits: int) -> Query:
    return lambda spark, sf_dir: (df := query(spark, sf_dir)).withColumn(column, F.round(df[column], digits))


#: Means and maxima of doubles are compared after rounding.
ROUNDED = {"over_avg_per_grain": ("avg_OrderBill", 2), "over_max_per_grain": ("max_OrderBill", 2)}


def _engine(use) -> Query:
    return lambda spark, sf_dir: use(engine_of(spark, sf_dir))


PICK = {"subject": "LineItem", "dimensions": [{"route": "LineItem>Nation#1", "attribute": "name"}], "measures": [{"metric": "Revenue"}], "having": [{"measure": 0, "op": ">", "value": 0}], "top": {"measure": 0, "limit": 5}}

#: Queries that aren't a plan: picks and profiles.
OTHERS: dict[str, tuple[Query, str]] = {
    "pick_top_nations": (_engine(lambda e: e.pick(PICK)), f"select n_name as name, {REVENUE} as \"Revenue\" from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey group by 1 order by 2 desc, 1 limit 5"),
    "value_ladder_exact": (_engine(lambda e: profile.search_values(e.model, e.tables, "Customer", "segment", "BUILDING")), "select distinct c_mktsegment as value, 'exact' as match from customer where c_mktsegment = 'BUILDING'"),
    "value_ladder_nocase": (_engine(lambda e: profile.search_values(e.model, e.tables, "Customer", "segment", "building")), "select distinct c_mktsegment as value, 'nocase' as match from customer where lower(c_mktsegment) = 'building'"),
    "value_ladder_prefix": (_engine(lambda e: profile.search_values(e.model, e.tables, "Nation", "name", "nation")), "select distinct n_name as value, 'prefix' as match from nation where lower(n_name) like 'nation%'"),
    "value_ladder_contains": (_engine(lambda e: profile.search_values(e.model, e.tables, "Customer", "nation_name", "ation_2")), "select distinct n_name as value, 'contains' as match from nation where lower(n_name) like '%ation\\_2%' escape '\\'"),
    "fanout_profile": (_engine(lambda e: profile.fan_out(e.model, e.graph, e.tables, "PLACED_BY", False)), "with n as (select c_custkey, count(o_orderkey) as n from customer left join orders on o_custkey = c_custkey group by 1) select 'PLACED_BY' as edge, false as forward, count(*) as origins, max(n)::bigint as largest, sum(n)::double / count(*) as mean, count(*) filter (where n = 0) as orphans, false as contradicted from n"),
    "fanout_profile_junction": (_engine(lambda e: profile.fan_out(e.model, e.graph, e.tables, "CONTAINS_RETURNED_PART")), "with n as (select o_orderkey, count(l_partkey) as n from orders left join lineitem on l_orderkey = o_orderkey and l_returnflag = 'R' group by 1) select 'CONTAINS_RETURNED_PART' as edge, true as forward, count(*) as origins, max(n)::bigint as largest, sum(n)::double / count(*) as mean, count(*) filter (where n = 0) as orphans, false as contradicted from n"),
    "column_facts": (_engine(lambda e: profile.column_facts(e.model, e.tables, "Supplier")), "select 'id' as attribute, count(*) as rows, 0::bigint as nulls, 0::bigint as blanks, count(distinct s_suppkey) as distinct_values from supplier union all select 'name', count(*), count(*) - count(s_name), count(*) filter (where trim(s_name) = ''), count(distinct s_name) from supplier union all select 'balance', count(*), count(*) - count(s_acctbal), 0, count(distinct s_acctbal) from supplier"),
    "cardinality_profile": (_engine(lambda e: profile.cardinality(e.graph, e.tables, "LIVES_IN")), "select 'LIVES_IN' as edge, 1::bigint as forward_largest, max(n)::bigint as reverse_largest, true as functional from (select c_nationkey, count(*) as n from customer group by 1)"),
}


def queries() -> dict[str, Query]:
    out = {name: _planned(plan) for name, (plan, _) in PLANS.items()} | {name: q for name, (q, _) in OTHERS.items()}
    return out | {name: _rounded(out[name], *how) for name, how in ROUNDED.items()}


def oracle_sql() -> dict[str, str]:
    out = {name: sql for name, (_, sql) in [*PLANS.items(), *OTHERS.items()]}
    return out | {name: f"select * replace (round(\"{c}\", {d}) as \"{c}\") from ({out[name]})" for name, (c, d) in ROUNDED.items()}
