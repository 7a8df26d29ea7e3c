"""The engine on a small insurance model whose right and wrong numbers are known."""

import pytest

from ledgerline.engine import Engine
from ledgerline.plans.graph import Graph, Path, Step
from ledgerline.plans.ir import Filter, Having, Measure, Plan, Projection, Top, canonical_key
from ledgerline.plans.model import GrainError, ModelError, PlanError, build
from ledgerline.sources import catalog

KINDS = ("payment", "reserve", "expense", "expense_reserve")


def layers():
    number = {"type": "integer"}
    text = {"type": "string"}
    semantic = {
        "domain": "insurance",
        "party_roles": {"PH": {"name": "Holder"}},
        "concepts": {
            "Policy": {"key": ["id"], "display": "number", "searchable": ["number"], "attributes": {"id": text, "number": text}},
            "Cover": {"key": ["since", "id"], "display": "id", "attributes": {"id": text, "since": {"type": "date"}}},
            "Premium": {"key": ["id"], "display": "id", "attributes": {"id": text, "amount": number}},
            "Claim": {"key": ["id"], "display": "id", "attributes": {"id": text}},
            "Cost": {"key": ["id"], "display": "id", "attributes": {"id": text, "amount": number}},
            "Holder": {"role": "PH", "key": ["id"], "display": "id", "attributes": {"id": text}},
        },
        "edges": {
            "COVERED": {"from": "Policy", "to": "Cover", "cardinality": "one_to_many", "fan_out": "bounded", "fan_out_reverse": "none"},
            "PRICED": {"from": "Cover", "to": "Premium", "cardinality": "one_to_many", "fan_out": "bounded", "fan_out_reverse": "none"},
            "AGAINST": {"from": "Claim", "to": "Cover", "cardinality": "many_to_many", "fan_out": "bounded", "fan_out_reverse": "bounded"},
            "HOLDS": {"from": "Holder", "to": "Policy", "cardinality": "many_to_one", "fan_out": "none", "fan_out_reverse": "bounded"},
            **{f"HAS_{k.upper()}": {"from": "Claim", "to": "Cost", "cardinality": "one_to_many", "fan_out": "bounded", "fan_out_reverse": "none"} for k in KINDS},
        },
        "metrics": {
            **{k: {"op": "sum", "operand": {"concept": "Cost", "attribute": "amount", "via": f"HAS_{k.upper()}"}} for k in KINDS},
            "Loss": {"combine": "add", "per": "Claim", "components": list(KINDS)},
            "PremiumTotal": {"op": "sum", "operand": {"concept": "Premium", "attribute": "amount", "via": "PRICED"}},
            "Ratio": {"combine": "divide", "components": ["Loss", "PremiumTotal"]},
            "Claims": {"op": "count_distinct", "operand": {"concept": "Claim", "attribute": "id"}},
        },
        "links": [{"name": "PolicyClaims", "from": "Policy", "to": "Claim", "backed_by": ["COVERED", "AGAINST"]}],
        "glossary": [{"phrases": ["loss"], "means": {"metric": "Loss"}}],
    }
    mapping = {
        "concepts": {
            "Policy": {"table": "policy", "key_columns": ["pid"], "columns": {"id": "pid", "number": "pno"}},
            "Cover": {"table": "cover", "key_columns": ["since", "cid"], "columns": {"id": "cid", "since": "since"}},
            "Premium": {"table": "premium", "key_columns": ["aid"], "columns": {"id": "aid", "amount": "amount"}},
            "Claim": {"table": "claim", "key_columns": ["clid"], "columns": {"id": "clid"}},
            "Cost": {"table": "cost", "key_columns": ["coid"], "columns": {"id": "coid", "amount": "amount"}},
            "Holder": {"table": "party_role", "key_columns": ["agreement", "party"], "columns": {"id": "party"}, "predicate": {"code": "PH"}},
        },
        "edges": {
            "COVERED": {"join": {"pid": "pid"}},
            "PRICED": {"join": {"since": "since", "cid": "cid"}},
            "AGAINST": {"via_table": "claim_cover", "from_join": {"clid": "clid"}, "to_join": {"since": "since", "cid": "cid"}},
            "HOLDS": {"join": {"agreement": "pid"}},
            **{f"HAS_{k.upper()}": {"join": {"clid": "clid"}, "restrict": {"table": k, "columns": {"coid": "coid"}}} for k in KINDS},
        },
    }
    return semantic, mapping


BASE = {"C1": (["D1"], (2000, 1500, 600, 500)), "C2": (["D1"], (5000, 2500, 1000, 500))}
FANNED = {"C1": (["D1"], (2000, 1500, 600, 500)), "C2": (["D1", "D2"], (4000, 2200, 1000, 500)), "C3": (["D3"], (2400, 1500, 600, 400)), "C4": (["D6"], (1000, 500, 300, 200))}


def tables(spark, claims, numbers=("PN-1", "PN-2")):
    day = "2019-01-01"
    policy = [("P1", numbers[0]), ("P2", numbers[1])]
    cover = [(f"D{i}", day, "P1" if i < 6 else "P2") for i in range(1, 7)]
    premium = [(f"A{i}", {1: 20000, 6: 5000}.get(i, 0), f"D{i}", day) for i in range(1, 7)]
    cost = [(f"{c}-{k}", a, c, k) for c, (_, amounts) in claims.items() for k, a in zip(KINDS, amounts) if a is not None]
    rows = {
        "policy": (policy, "pid string, pno string"), "cover": (cover, "cid string, since string, pid string"),
        "premium": (premium, "aid string, amount int, cid string, since string"), "claim": ([(c,) for c in claims], "clid string"),
        "claim_cover": ([(c, d, day) for c, (ds, _) in claims.items() for d in ds], "clid string, cid string, since string"),
        "cost": ([r[:3] for r in cost], "coid string, amount int, clid string"),
        "party_role": ([("P1", "X", "PH"), ("P1", "Y", "AG"), ("P2", "X", "PH")], "agreement string, party string, code string"),
        **{k: ([(r[0],) for r in cost if r[3] == k], "coid string") for k in KINDS},
    }
    made = {n: spark.createDataFrame(r, s) for n, (r, s) in rows.items()}
    return made.__getitem__


def engine(spark, claims=BASE, elide=True, **more):
    return Engine(build(*layers()), tables(spark, claims, **more), elide=elide)


def path(source, *steps):
    return Path(source, tuple(Step(s.rstrip("<"), not s.endswith("<")) for s in steps))


TO_POLICY = path("Claim", "AGAINST", "COVERED<")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("elide", [True, False])
def test_base_numbers(spark, elide):
    e = engine(spark, elide=elide)
    loss = Measure(metric="Loss")
    assert rows(e.run(Plan("Claim", (TO_POLICY,), (Projection(0),), (loss,)))) == [("PN-1", 13600)]
    assert rows(e.run(Plan("Claim", (TO_POLICY,), (Projection(0), Projection(None, "id")), (loss,)))) == [("PN-1", "C1", 4600), ("PN-1", "C2", 9000)]
    priced = path("Claim", "AGAINST", "PRICED")
    assert rows(e.run(Plan("Claim", (TO_POLICY, priced), (Projection(0),), (Measure(metric="Ratio"),)))) == [("PN-1", 0.68)]


@pytest.mark.parametrize("elide", [True, False])
def test_fanned_out_numbers(spark, elide):
    e = engine(spark, FANNED, elide)
    assert rows(e.run(Plan("Claim", (TO_POLICY,), (Projection(0),), (Measure(metric="Loss"),)))) == [("PN-1", 17200), ("PN-2", 2000)]
    assert e.run(Plan("Claim", (), (), (Measure(metric="Loss"),))).collect()[0][0] == 19200
    to_claim = path("Policy", "COVERED", "AGAINST<")
    assert e.run(Plan("Policy", (to_claim,), (Projection(), Projection(0)))).count() == 4  # five joined rows, one twice
    assert rows(e.run(Plan("Policy", (to_claim,), (Projection(),), (Measure(metric="Claims", path=0),)))) == [("PN-1", 3), ("PN-2", 1)]


def test_null_and_equal_displays(spark):
    loss = (Measure(metric="Loss"),)
    assert rows(engine(spark, FANNED, numbers=("PN", "PN")).run(Plan("Claim", (TO_POLICY,), (Projection(0),), loss))) == [("PN", 19200)]
    assert rows(engine(spark, FANNED, numbers=("PN", None)).run(Plan("Claim", (TO_POLICY,), (Projection(0),), loss))) == [("PN", 17200)]


def test_over_counts_instances_without_a_part(spark):
    claims = {"C1": (["D1"], (100, None, None, None)), "C2": (["D1"], (100, 100, 100, 100)), "C3": (["D6"], (50, 50, None, None))}
    e = engine(spark, claims)
    mean = lambda p: rows(e.run(p))
    assert mean(Plan("Claim", (TO_POLICY,), (Projection(0),), (Measure(metric="Loss", over="avg"),))) == [("PN-1", 250.0), ("PN-2", 100.0)]
    assert mean(Plan("Claim", (), (), (Measure(metric="Loss", over="max"),))) == [(400,)]
    both = Plan("Claim", (TO_POLICY,), (Projection(0),), (Measure(metric="Claims"), Measure(metric="Loss", over="sum")))
    assert mean(both) == [("PN-1", 2, 500), ("PN-2", 1, 100)]


def test_zero_divisor_and_having_and_top(spark):
    e = engine(spark, {"C1": (["D2"], (1, 1, 1, 1)), "C2": (["D6"], (5, 5, 5, 5))})
    priced = path("Claim", "AGAINST", "PRICED")
    by_cover = Plan("Claim", (path("Claim", "AGAINST"), priced), (Projection(0),), (Measure(metric="Ratio"),))
    assert rows(e.run(by_cover))[0] == ("D2", None)
    loss = Plan("Claim", (TO_POLICY,), (Projection(0),), (Measure(metric="Loss"),), having=(Having(0, ">", 5),))
    assert rows(e.run(loss)) == [("PN-2", 20)]
    top = Plan("Claim", (TO_POLICY,), (Projection(0),), (Measure(metric="Loss"),), top=Top(1, measure=0))
    assert [tuple(r) for r in e.run(top).collect()] == [("PN-2", 20)]


def test_refusals(spark):
    e = engine(spark, FANNED)
    refused = lambda kind, plan: pytest.raises(kind, e.run, plan)
    p = Projection()
    covers, holders = path("Policy", "COVERED"), path("Policy", "HOLDS<")
    refused(GrainError, Plan("Policy", (covers, holders), (Projection(0), Projection(1))))
    to_cost = path("Policy", "COVERED", "AGAINST<", "HAS_EXPENSE")
    refused(GrainError, Plan("Policy", (to_cost,), (p,), (Measure(aggregation="sum", attribute="amount", path=0),)))
    refused(GrainError, Plan("Policy", (path("Policy", "COVERED", "PRICED"),), (p,), (Measure(aggregation="avg", attribute="amount", path=0),)))
    refused(GrainError, Plan("Policy", (path("Policy", "COVERED", "PRICED"),), (p,), (Measure(aggregation="count_distinct", attribute="amount", path=0),)))
    refused(PlanError, Plan("Policy", (path("Policy", "AGAINST"),), (Projection(0),)))
    refused(PlanError, Plan("Policy", (), (Projection(None, "colour"),)))
    refused(PlanError, Plan("Policy", (), (p,), (Measure(metric="Nothing"),)))
    refused(PlanError, Plan("Claim", (TO_POLICY,), (Projection(0),), (Measure(metric="Claims", over="avg"),)))
    refused(GrainError, Plan("Claim", (TO_POLICY,), (Projection(0),), (Measure(metric="Ratio", path=0),)))
    for bad in (lambda: Measure(), lambda: Filter("a", "~", 1), lambda: Filter("a", "IN", []), lambda: Top(3), lambda: Measure(combine="divide", parts=(Measure(metric="Loss"),))):
        pytest.raises(PlanError, bad)


def test_filters(spark):
    e = engine(spark, FANNED)
    holder = path("Claim", "AGAINST", "COVERED<", "HOLDS<")
    plan = Plan("Claim", (TO_POLICY, holder), (Projection(0),), (Measure(metric="Loss"),), (Filter("id", "=", "X", 1),))
    assert rows(e.run(plan)) == [("PN-1", 17200), ("PN-2", 2000)]
    like = Plan("Policy", (), (Projection(),), filters=(Filter("number", "LIKE", "pn-%"),))
    assert len(rows(e.run(like))) == 2


def test_routes():
    g = Graph(build(*layers()))
    found = g.paths("Policy", "Claim")
    assert [str(p) for p in found] == ["Policy COVERED> AGAINST<"] and g.route(g.route_id(found[0])) == found[0]
    assert g.paths("Policy", "Policy") == [] and g.link("PolicyClaims") == found[0]
    assert len(g.paths("Claim", "Cost")) == 4 and g.signature(path("Policy", "HOLDS<")) == ("", "PH")
    with pytest.raises(PlanError):
        g.route("Policy>Claim#9")
    with pytest.raises(PlanError):
        g.govern(path("Policy", "COVERED", "COVERED<"))


def test_keys_of_plans():
    a, b = Measure(metric="Claims"), Measure(metric="Loss")
    add = lambda *m, **k: Plan("Claim", measures=(Measure(combine="add", parts=m),), **k)
    assert canonical_key(add(a, b)) == canonical_key(add(b, a)) == canonical_key(add(a, b, paths=()))
    assert canonical_key(Plan("Claim", measures=(b,))) != canonical_key(Plan("Claim", measures=(Measure(metric="Loss", over="avg"),)))
    two = (TO_POLICY, TO_POLICY)
    assert canonical_key(Plan("Claim", two, (Projection(1),))) == canonical_key(Plan("Claim", two[:1], (Projection(0),)))


def test_known_gaps_of_keys(spark):
    """Plans of one result whose keys differ: routes in another order, a route that nothing uses, a listing in another order."""
    e, other = engine(spark, FANNED), path("Claim", "AGAINST")
    loss = (Measure(metric="Loss"),)
    one = Plan("Claim", (TO_POLICY, other), (Projection(0), Projection(1)), loss)
    turned = Plan("Claim", (other, TO_POLICY), (Projection(1), Projection(0)), loss)
    assert e.key(one) != e.key(turned) and rows(e.run(one)) == rows(e.run(turned))
    unused = Plan("Claim", (TO_POLICY, other), (Projection(0),), loss)
    assert e.key(unused) != e.key(Plan("Claim", (TO_POLICY,), (Projection(0),), loss)) and rows(e.run(unused)) == rows(e.run(Plan("Claim", (TO_POLICY,), (Projection(0),), loss)))
    assert e.key(Plan("Claim", (TO_POLICY,), (Projection(0),), loss)) == e.key(Plan("Claim", (TO_POLICY,), (Projection(0, "number"),), loss))  # the display, once the model is known
    assert canonical_key(Plan("Claim", (TO_POLICY,), (Projection(0),), loss)) != canonical_key(Plan("Claim", (TO_POLICY,), (Projection(0, "number"),), loss))


def test_nulls_come_last_whatever_the_order(spark):
    e = engine(spark, FANNED, numbers=("PN", None))
    for down in (True, False):
        plan = Plan("Policy", (), (Projection(None, "id"), Projection()), top=Top(5, projection=1, descending=down))
        assert [tuple(r)[1] for r in e.run(plan).collect()] == ["PN", None]


def broken(change):
    semantic, mapping = layers()
    change(semantic, mapping)
    return semantic, mapping


@pytest.mark.parametrize("change", [
    lambda s, m: m["concepts"].pop("Policy"),
    lambda s, m: m["edges"].update(EXTRA={"join": {"a": "b"}}),
    lambda s, m: m["concepts"]["Policy"]["columns"].pop("number"),
    lambda s, m: m["concepts"]["Policy"]["columns"].update(colour="c"),
    lambda s, m: m["concepts"]["Holder"].pop("predicate"),
    lambda s, m: m["concepts"]["Holder"].update(predicate={"code": "PH", "b": 1}),
    lambda s, m: s["concepts"]["Holder"].update(role="ZZ"),
    lambda s, m: m["concepts"]["Policy"].update(key_columns=["other"]),
    lambda s, m: m["edges"]["COVERED"].update(via_table="x"),
    lambda s, m: m["edges"]["COVERED"].update(join={}),
    lambda s, m: m["edges"]["COVERED"].update(predicate={"a": 1}),
    lambda s, m: s["edges"]["COVERED"].update({"from": "Nobody"}),
    lambda s, m: s["edges"]["COVERED"].update(fan_out="many"),
    lambda s, m: s["edges"]["COVERED"].update(cardinality="some"),
    lambda s, m: s["concepts"]["Policy"].update(display="colour"),
    lambda s, m: s["concepts"]["Policy"].update(implements="Policy"),
    lambda s, m: s["concepts"]["Policy"].update(colour=1),
    lambda s, m: s["concepts"]["Policy"]["attributes"]["id"].update(type="blob"),
    lambda s, m: s["concepts"]["Policy"]["attributes"]["id"].update(value_type="Nothing"),
    lambda s, m: s["metrics"]["Loss"].update(op="sum"),
    lambda s, m: s["metrics"]["Loss"].update(per="Policy"),
    lambda s, m: s["metrics"]["Loss"]["components"].append("Loss"),
    lambda s, m: s["metrics"]["Claims"].update(op="sum"),
    lambda s, m: s["links"].append(s["links"][0]),
    lambda s, m: s["links"][0].update(backed_by=["AGAINST"]),
    lambda s, m: s["glossary"].append({"phrases": ["x"], "means": {"metric": "Nothing"}}),
])
def test_models_that_are_refused(change):
    with pytest.raises(ModelError):
        build(*broken(change))


def test_schema_of_ddl_and_missing_columns():
    schema = catalog.ddl_schema("CREATE TABLE policy (pid VARCHAR(9) NOT NULL, pno TEXT, PRIMARY KEY (pid, pno));\n-- no\ncreate table b (\n x decimal(9,2)\n);")
    assert schema == {"policy": {"pid", "pno"}, "b": {"x"}}
    with pytest.raises(ModelError):
        build(*layers(), schema)


def test_elided_is_full_on_retail(spark):
    from ledgerline.queries import PLANS

    for name in ("agg_sum", "agg_fan_trap_two_measures", "agg_converging_route", "composite_grains_mixed", "filter_through_fanout", "over_max_per_grain"):
        plan = PLANS[name][0]
        a, b = (rows(Engine.retail(spark, "/root/testdata/sf0.001", elide=e).run(plan)) for e in (True, False))
        assert len(a) == len(b) and all(x == pytest.approx(y) for x, y in zip(a, b)), name
