import random

import pytest

from loomshift.functions.names import name_tokens
from loomshift.operators import match, rules
from loomshift.plans import graph, patch, plan, state
from loomshift.sources.catalog import Catalog, Column, ForeignKey, Table, drifted, fingerprint
from loomshift.streaming.progress import RateWindow, seconds_left


def test_load_order_cuts_the_edge_that_may_be_null():
    edges = [("Customers", "Addresses"), ("Addresses", "Customers"), ("Orders", "Customers"), ("Orders", "Addresses"), ("OrderLines", "Orders"), ("OrderLines", "Products")]
    order, cut = graph.load_order(["Customers", "Addresses", "Orders", "OrderLines", "Products", "AuditEvents"], edges, [("Customers", "Addresses")])
    assert order == ["AuditEvents", "Customers", "Products", "Addresses", "Orders", "OrderLines"] and cut == [("Customers", "Addresses")]


def test_components_against_reachability():
    pick = random.Random(5)
    for _ in range(200):
        nodes = [f"n{k}" for k in range(pick.randint(1, 7))]
        edges = [(pick.choice(nodes), pick.choice(nodes)) for _ in range(pick.randint(0, 12))]
        reach = {n: {n} for n in nodes}
        for _ in nodes:
            for a, b in edges:
                for n in nodes:
                    if a in reach[n]:
                        reach[n] |= reach[b]
        wanted = sorted({tuple(sorted(m for m in nodes if m in reach[n] and n in reach[m])) for n in nodes})
        assert [tuple(c) for c in graph.components(nodes, edges)] == wanted
        order, cut = graph.load_order(nodes, edges)
        assert all(order.index(p) < order.index(c) for c, p in edges if (c, p) not in cut) and sorted(order) == nodes


def test_patch():
    assert patch.apply({"a": [1, 2]}, [{"op": "add", "path": "/a/-", "value": 3}, {"op": "remove", "path": "/a/0"}, {"op": "add", "path": "/b/c", "value": {}}]) == {"a": [2, 3], "b": {"c": {}}}
    for bad in ({"op": "replace", "path": "/x", "value": 1}, {"op": "remove", "path": "/a/9"}, {"op": "move", "path": "/a"}, {"op": "add", "path": "/a/01", "value": 1}):
        with pytest.raises(patch.PatchFault):
            patch.apply({"a": [1]}, [bad])


def _catalogs():
    columns = lambda *names: [Column(n, k, "int", n not in names[:1]) for k, n in enumerate(names)]
    source = Catalog("src", {"CUST": Table("CUST", columns("CUST_ID", "NAME"), 10, None, ["CUST_ID"]), "LOG": Table("LOG", columns("X"), 0), "ORD": Table("ORD", columns("ORD_ID", "CUST_ID"), 5, None, ["ORD_ID"], foreign_keys=[ForeignKey("FK1", ["CUST_ID"], "CUST", ["CUST_ID"], False)])}, {"compat": 160})
    target = Catalog("tgt", {"Customers": Table("Customers", columns("CustomerId", "Name"), 3, None, ["CustomerId"]), "Orders": Table("Orders", columns("OrderId", "CustomerId"), 0, None, ["OrderId"], foreign_keys=[ForeignKey("FK2", ["CustomerId"], "Customers", ["CustomerId"])], triggers=["trg"])}, {"compat": 150})
    return source, target


def test_rules():
    source, target = _catalogs()
    found = rules.analyse(source, target, {("CUST", "NAME"): {"sampled_rows": 100, "nulls": 99}}, None)
    assert [(f.rule, f.severity, f.object) for f in found] == [("R01", "low", "LOG"), ("R06", "medium", "Orders"), ("R09", "medium", "ORD.FK1"), ("R10", "low", "CUST.NAME"), ("R11", "low", "LOG"), ("R15", "high", "Customers"), ("R16", "medium", "compat")]
    assert rules.analyse(source, target, None, {("ORD", "FK1"): 0})[2].severity == "low" and found[0].id == "F001"


def test_fingerprint_and_drift():
    source, _ = _catalogs()
    mark = fingerprint(source)
    source.tables["CUST"].rows = 99
    source.tables["ORD"].foreign_keys[0].trusted = True
    assert not drifted(mark, source) and not drifted(None, None)
    source.tables["CUST"].columns[1].nullable = False
    assert drifted(mark, source)
    with pytest.raises(ConnectionError):
        drifted(mark, None)


def test_mapping_and_plan(spark):
    source, target = _catalogs()
    mapping = {"tables": {"Customers": {"kind": "direct", "sources": ["CUST"], "columns": {"CustomerId": {"expr": "s.CUST_ID", "source_columns": ["CUST.CUST_ID"]}, "Name": {"expr": "s.NAME", "source_columns": ["CUST.NAME"]}}}, "Orders": {"kind": "direct", "sources": ["ORD"], "filter": "s.ORD_ID > 0", "columns": {"OrderId": {"expr": "s.ORD_ID", "source_columns": ["ORD.ORD_ID"]}, "CustomerId": {"expr": "s.NOPE", "source_columns": ["ORD.CUST_ID"]}}}}, "drops": {"LOG": "empty"}}
    assert plan.mapping_errors(mapping, source, target) == [] and plan.mapping_blockers(mapping, source, target) == []
    made = plan.generate(mapping, source, target)
    assert [(t.id, t.target, t.depends_on) for t in made.tasks] == [("T01", "Customers", []), ("T02", "Orders", ["T01"])] and made.tasks[1].query.endswith("WHERE (s.ORD_ID > 0)")
    spark.range(1).selectExpr("id as CUST_ID", "id as NAME").createOrReplaceTempView("CUST")
    spark.range(1).selectExpr("id as ORD_ID", "id as CUST_ID").createOrReplaceTempView("ORD")
    told = plan.validate(spark, made, target)
    assert told["T01"] == [] and "NOPE" in told["T02"][0]
    assert plan.mapping_errors({"tables": {"customers": {"kind": "direct"}}}, source, target) == ["customers: no such target table (it is Customers)"]
    assert plan.plan_order(["T02", "T09", "T02"], ["T01", "T02"]) == ["T02", "T01"]
    mapping["notes"] = "changed"
    assert plan.mapping_hash(mapping) == made.mapping_hash


def test_scores_and_assignment():
    assert match.column_score(1, 1, 1, None) == match.column_score(1, 1, 1, 1.0) == 1.0
    assert match.degree_similarity(0, 0) == 1 and match.degree_similarity(1, 2) == 0.5
    pairs = [("A", "x", 0.9, 1.0), ("A", "y", 0.8, 1.0), ("B", "x", 0.9, 1.0), ("B", "y", 0.6, 1.0), ("C", "z", 0.7, 0.1), ("D", "w", 0.4, 1.0)]
    assert match.greedy_assignment(pairs) == {"A": ("x", 0.9), "B": ("y", 0.6)}
    assert name_tokens("ORD_HDR") == ["order", "header"]


def test_state_machine():
    p = state.Project()
    v = p.add_version("mapping", "script", {})
    with pytest.raises(state.StateFault):
        p.approve("mapping", v, ["blocked"])
    item = p.remark("mapping", "Orders", "why")
    p.send("mapping")
    with pytest.raises(state.StateFault):
        p.add_version("mapping", "agent", {}, v)
    p.respond(item, True)
    v = p.add_version("mapping", "agent", {}, v)
    p.approve("mapping", v)
    p.status["sql"] = "approved"
    p.reopen("mapping")
    assert p.status["sql"] == "stale" and p.next() == ("setup", "agent")


def test_rates():
    rate = RateWindow()
    assert [rate.add(t, n) for t, n in ((0, 0), (5, 50), (20, 350))] == [0.0, 10.0, 20.0]
    assert seconds_left([100, None], 10, 0, 5.0) is None and seconds_left([100], 40, 10, 5.0) == 10.0
