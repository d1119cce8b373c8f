from loomshift.operators import match
from loomshift.plans import carry, packets, state
from loomshift.plans.automap import automap, search
from loomshift.plans.patch import PatchFault
from loomshift.plans.store import Store
from loomshift.sources.catalog import Catalog, Column, ForeignKey, Table, fingerprint

import pytest


def both():
    text = lambda n, k, size, nullable=True: Column(n, k, f"nvarchar({size})", nullable, max_length=size)
    source = Catalog("source", {
        "CUST": Table("CUST", [Column("CUST_ID", 0, "int", False), text("EMAIL_ADDR", 1, 120), text("PHONE_NO", 2, 30), text("NOTES", 3, 300)], 10, None, ["CUST_ID"]),
        "ORD": Table("ORD", [Column("ORD_ID", 0, "int", False), Column("CUST_ID", 1, "int", False)], 5, None, ["ORD_ID"], foreign_keys=[ForeignKey("F", ["CUST_ID"], "CUST", ["CUST_ID"])]),
    })
    target = Catalog("target", {"Customers": Table("Customers", [Column("CustomerId", 0, "int", False), text("Email", 1, 60, False), text("Phone", 2, 30), text("Notes", 3, 200)], 0, None, ["CustomerId"])})
    return source, target


SEEN = {"sampled_rows": 100, "nulls": 10, "null_ratio": 0.1, "distinct_ratio": 0.9, "max_len": 120, "min_text": "a@b.de", "max_text": "z@b.de", "semantic_class": "email"}


def test_profile_scores():
    assert match.profile_score(None, None, "string", 60, False, False, []) is None and match.profile_score({"sampled_rows": 0}, None, "string", 60, False, False, []) is None
    # class fits the name, nulls into a required column, no unique key, half of the length
    assert match.profile_score(SEEN, None, "string", 60, True, False, ["email"]) == pytest.approx((1 + 0 + 0.5) / 3)
    assert match.profile_score(SEEN, None, "string", -1, False, True, ["mail"]) == pytest.approx((1 + 1 + 0.9 + 1) / 4)
    other = {"sampled_rows": 9, "nulls": 0, "null_ratio": 0.0, "distinct_ratio": 0.4, "max_len": 60, "semantic_class": "text"}
    assert match.profile_score(SEEN, other, "string", 60, True, False, ["email"]) == pytest.approx((0 + 0.9 + 0.5 + 0.5) / 4)
    assert [match.class_fit(*x) for x in (("guid", "guid", 0, []), ("date", "datetime", 0, []), ("integer", "string", 9, []), ("integer", "date", 0, []), ("decimal", "integer", 0, []), ("flag", "string", 1, []), ("flag", "string", 2, []), ("text", "string", 5, []), ("text", "integer", 0, []), ("url", "string", 5, ["link"]))] == [1, 1, 0.5, 0.2, 0.5, 1, 0.3, 1, 0.3, 1]


def test_profiles_change_scores_and_risks():
    source, target = both()
    bare = automap(source, target)["tables"]["Customers"]["columns"]
    told = automap(source, target, profiles={("CUST", "EMAIL_ADDR"): SEEN})["tables"]["Customers"]["columns"]
    assert bare["Email"]["expr"] == told["Email"]["expr"] == "s.`EMAIL_ADDR`" and bare["Email"]["confidence"] != told["Email"]["confidence"]
    assert told["Email"]["type_risk"] == "may truncate (source max 120)" and bare["Phone"]["confidence"] == told["Phone"]["confidence"]
    keys = lambda classes: [h[3] for h in search([source], "email", classes=classes)]
    assert "CUST.NOTES" not in keys({}) and set(keys({("CUST", "NOTES"): "email"})) >= {"CUST.NOTES", "CUST.EMAIL_ADDR"}


def test_bare_references():
    assert carry.bare_reference("s.`EMAIL_ADDR`", ["CUST"]) == ("CUST", "EMAIL_ADDR") and carry.bare_reference(" o.[ID] ", [], "ORD o JOIN CUST AS c ON c.CUST_ID = o.CUST_ID") == ("ORD", "ID")
    assert carry.bare_reference("upper(s.X)", ["CUST"]) is None and carry.bare_reference("x.ID", ["CUST"]) is None and carry.bare_reference(None, ["CUST"]) is None
    assert carry.aliases([], "app.`Ord` AS o LEFT JOIN CUST c ON 1 = 1") == {"o": "app.Ord", "c": "CUST"}


def test_risks_are_the_engines():
    source, target = both()
    entry = lambda expr, risk=None: {"expr": expr, "type_risk": risk, "source_columns": []}
    given = {"tables": {"Customers": {"kind": "direct", "sources": ["CUST"], "columns": {"Email": entry("s.EMAIL_ADDR", "none at all"), "Phone": entry("trim(s.PHONE_NO)", "made up"), "Notes": {"default": "x", "type_risk": "y"}, "CustomerId": entry("s.CUST_ID", "kept")}}}}
    stored = {"tables": {"Customers": {"columns": {"CustomerId": entry("s.CUST_ID", "as stored")}}}}
    found = carry.normalise_risks(given, stored, source, target)["tables"]["Customers"]["columns"]
    assert {k: v["type_risk"] for k, v in found.items()} == {"Email": "may truncate (source max 120)", "Phone": carry.UNKNOWN_RISK, "Notes": None, "CustomerId": "as stored"}
    made = {"tables": {"Customers": {"columns": found}, "Other": {"kind": "skip", "columns": {"a": {"type_risk": "b"}}}}, "drops": {"X": "y"}}
    assert carry.risk_warnings(made) == ["Customers.Email: may truncate (source max 120)", f"Customers.Phone: {carry.UNKNOWN_RISK}", "Customers.CustomerId: as stored"]
    assert carry.mapping_summary(made, ["z"]) == {"tables": 2, "columns": 5, "drops": 1, "attention": 0, "blockers": 1, "risks": 3}


def test_decisions_carry_over_while_they_resolve():
    source, target = both()
    draft = automap(source, target)
    old = {"tables": {"Customers": {**draft["tables"]["Customers"], "columns": {"Email": {"expr": "s.`NOTES`", "source_columns": ["CUST.NOTES"], "method": "human"}, "Phone": {"expr": "s.`GONE`", "source_columns": ["CUST.GONE"], "method": "agent"}}}, "Lost": {"method": "human"}}, "drops": {"CUST.NOTES": "why", "ORD": "old", "NOPE": "x"}}
    found = carry.carry_over(old, draft, source, target)
    columns = found["tables"]["Customers"]["columns"]
    assert (columns["Email"]["expr"], columns["Email"]["method"], columns["Email"]["type_risk"]) == ("s.`NOTES`", "carried", "may truncate (source max 300)")
    assert columns["Phone"] == draft["tables"]["Customers"]["columns"]["Phone"] and set(found["tables"]) == {"Customers"} and found["drops"] == {"CUST.NOTES": "why", "ORD": "old"}
    whole = carry.carry_over({"tables": {"Customers": {"kind": "merge", "sources": ["CUST"], "from": "CUST c", "method": "human", "columns": {}}}}, draft, source, target)
    assert whole["tables"]["Customers"] == {"kind": "merge", "sources": ["CUST"], "from": "CUST c", "method": "carried", "columns": {}}


def test_packets_and_submissions():
    source, target = both()
    mapping = automap(source, target)
    profiles = {("CUST", "EMAIL_ADDR"): {**SEEN, "samples": ["a@b.de"]}, ("CUST", "CUST_ID"): {"min_text": "1", "max_text": "9"}}
    packet = packets.draft_packet(mapping, source, target, profiles)
    assert packet["targets"][0].startswith("Customers (0 rows)") and "email, null 10%, distinct 90%, a@b.de .. z@b.de" in packet["sources"][0] and list(packet["draft"]) == ["Customers"]
    mark, clean = fingerprint(source), packets.without_samples(profiles, source)
    assert clean["CUST", "EMAIL_ADDR"]["min_text"] is None and "samples" not in clean["CUST", "EMAIL_ADDR"] and clean["CUST", "CUST_ID"]["min_text"] == "1" and fingerprint(source) == mark
    remark = state.Feedback("Customers.Email", "why", "open")
    assert packets.rework_packet(mapping, [remark], source, target)["remarks"] == [{"anchor": "Customers.Email", "text": "why", "status": "open"}]
    got = packets.parse_submission('{"phase": "mapping", "baseVersion": 2, "ops": [{"op": "add"}], "summary": "s"}')
    assert (got.phase, got.base, got.operations, got.responses, got.summary) == ("mapping", 2, [{"op": "add"}], [], "s")
    for bad in ("[", "[]", '{"phase": "x", "baseVersion": 1}', '{"phase": "sql", "baseVersion": true}', '{"phase": "sql", "baseVersion": 1, "ops": [1]}'):
        with pytest.raises(PatchFault):
            packets.parse_submission(bad)
    assert packets.split_batches("a\nGO\n\ngo ;\nb\nGOTO x") == ["a", "b\nGOTO x"]
    lines = [str(k) for k in range(20)]
    changed = [*lines[:10], "new", *lines[11:]]
    diff = packets.line_diff("\n".join(lines), "\n".join(changed), 1)
    assert diff == [("…", ""), (" ", "9"), ("-", "10"), ("+", "new"), (" ", "11"), ("…", "")] and packets.line_diff("a", "a") == []


def test_the_review_outlives_the_process(spark, tmp_path):
    store, p = Store(spark, f"file://{tmp_path}/x"), state.Project()
    assert state.Project.load(store) is None
    p.add_version("mapping", "script", {"a": 1})
    p.remark("mapping", "T", "why")
    p.save(store)
    p.send("mapping")
    p.supersede("mapping")
    assert p.save(store) == 2
    again = state.Project.load(store)
    assert again == p and again.feedback["mapping"][0].status == "superseded"


def test_catalogs_are_stored_and_orders_checked(spark):
    from loomshift.plans.plan import order_faults
    from loomshift.sources.catalog import catalog_json, catalog_of, read_catalog
    from loomshift.streaming.progress import Throttle

    source, _ = both()
    assert catalog_of(catalog_json(source)) == source
    assert order_faults(["a", "x", "a", "a"], ["a", "b"]) == {"unknown": ["x"], "twice": ["a"], "missing": ["b"]}
    throttle = Throttle()
    assert [throttle.passes(t, f) for t, f in ((0, False), (100, False), (120, True), (300, False), (370, False))] == [True, False, True, False, True]
    found = read_catalog(spark, "source", "/root/testdata/sf0.001", {"region": {"primary_key": ["r_regionkey"]}})
    assert found.tables["region"].rows == 5 and found.tables["region"].size_mb > 0


def test_finishing_a_run(spark, tmp_path):
    from loomshift.plans import report
    from loomshift.plans.runner import TaskReport

    store, p = Store(spark, f"file://{tmp_path}/x"), state.Project()
    told = {"headline": "a <b>", "notes": ["n"], "tasks": [{"id": "T1", "target": "A", "source_rows": None, "loaded": 1, "rejected": 0, "status": "done"}]}
    with pytest.raises(state.StateFault):
        report.finish_run(store, p, {**told, "tasks": [{**told["tasks"][0], "status": "paused"}]})
    assert report.finish_run(store, p, told) == told == report.finish_run(store, p, {**told, "headline": "later"}) and p.status["complete"] == "approved"
    assert "a &lt;b&gt;" in report.report_html(told) and "<td>unknown</td>" in report.report_html(told)
    assert report.live_totals([TaskReport("T", "A", 5, 3, 1, status="done"), TaskReport("U", "B", None)]) == {"done": 3, "total": None, "rejected": 1, "tasks": {"done": 1, "pending": 1}}
