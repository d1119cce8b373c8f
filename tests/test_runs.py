from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from loomshift.operators import load
from loomshift.plans import preflight, report, runner
from loomshift.plans import plan as plans
from loomshift.plans.constraints import rules_from
from loomshift.plans.plan import Plan, Task
from loomshift.plans.store import LockHeld
from loomshift.sources.catalog import Catalog, Column, ForeignKey, Table


@pytest.fixture
def settings(spark):
    """Set session settings for one test."""
    before = {}

    def put(**values):
        for k, v in values.items():
            name = f"spark.sql.{k.replace('__', '.')}"
            before.setdefault(name, spark.conf.get(name))
            spark.conf.set(name, v)

    yield put
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("adaptive", ["true", "false"])
@pytest.mark.parametrize("size", ["64MB", "64KB"])
def test_wide_rows_are_numbered_without_gap(spark, settings, adaptive, size):
    settings(adaptive__enabled=adaptive, adaptive__advisoryPartitionSizeInBytes=size, shuffle__partitions="200")
    wide = spark.range(200_000).select(F.xxhash64("id").alias("k"), "id", F.expr("repeat(md5(cast(id as string)), 8)").alias("payload"))
    out = load.row_numbers(wide, ["k"])
    got = out.agg(F.count("*").alias("n"), F.count_distinct("rn").alias("d"), F.min("rn").alias("a"), F.max("rn").alias("b"), F.count_distinct("id").alias("i")).first()
    assert tuple(got) == (200_000, 200_000, 1, 200_000, 200_000)
    from pyspark.sql import Window

    falls = out.where("rn % 97 < 2").select("k", F.lag("k").over(Window.orderBy("rn")).alias("before")).where("before > k")
    assert falls.count() == 0


def wide_task(spark, n=5000, chunk=1000):
    spark.range(n).select("id", F.expr("repeat(md5(cast(id as string)), 8)").alias("payload")).createOrReplaceTempView("wide_rows")
    return Task("T01", "Wide", "direct", "select id, payload, id as __k0 from wide_rows", ["id", "payload"], ["__k0"], chunk)


def target(tmp_path, spark, name="target"):
    return runner.Store(spark, f"file://{tmp_path}/{name}")


def test_a_resumed_load_knows_what_the_target_held(spark, tmp_path):
    store, task, rules = target(tmp_path, spark), wide_task(spark), load.Constraints(primary_key=["id"])
    held = replace(task, id="T00", query=task.query + " where id < 10")
    runner.run_task(spark, store, held, rules, runner.Options())
    assert runner.run_task(spark, store, task, rules, runner.Options(stop_after=2)).status == "paused"
    last = runner.run_task(spark, store, task, rules, runner.Options())
    assert (last.status, last.loaded, last.rejected, last.before, last.after) == ("done", 4990, 10, 10, 5000)
    assert store.read("Wide").select("id").distinct().count() == 5000 and runner.reconcile(last) == (True, None)
    assert runner.run_task(spark, store, task, rules, runner.Options()).loaded == 4990 and not store.exists("Wide/_stage/T01")


def test_a_crash_between_writing_and_committing(spark, tmp_path, monkeypatch):
    store, task, rules = target(tmp_path, spark), wide_task(spark), load.Constraints(primary_key=["id"])
    commit, calls = runner.Store.commit, []

    def broken(self, *x):
        calls.append(x)
        if len(calls) == 2:
            raise OSError("the machine went down")
        commit(self, *x)

    monkeypatch.setattr(runner.Store, "commit", broken)
    with pytest.raises(OSError):
        runner.run_task(spark, store, task, rules, runner.Options())
    assert store.read("Wide").count() == 3000  # the committed range, and not the files of the other
    monkeypatch.setattr(runner.Store, "commit", commit)
    done = runner.run_task(spark, store, task, rules, runner.Options())
    assert (done.loaded, done.after, store.read("Wide").select("id").distinct().count()) == (5000, 5000, 5000)
    store.delete("Wide/_manifest")
    with pytest.raises(runner.CheckpointLost):
        runner.run_task(spark, store, task, rules, runner.Options())


def test_stop_mode_records_its_row_once(spark, tmp_path):
    store, task, rules = target(tmp_path, spark), wide_task(spark, chunk=500), load.Constraints(checks=["id <> 1700"])
    for _ in range(2):
        stopped = runner.run_task(spark, store, task, rules, runner.Options(error_mode="stop"))
        assert (stopped.status, stopped.loaded, store.read("Wide").count()) == ("failed", 1500, 1500)
        assert [r["key_json"] for r in runner.rejected_rows(store).collect()] == ['{"__k0":1700}']
    done = runner.run_task(spark, store, task, rules, runner.Options())
    assert (done.loaded, done.rejected, runner.rejected_rows(store).count(), done.note) == (4999, 1, 1, None)


def test_signals_and_the_lock(spark, tmp_path):
    store, task, rules = target(tmp_path, spark), wide_task(spark), load.Constraints()
    assert runner.run_task(spark, store, task, rules, runner.Options(signal=lambda: ("pause", "cancel"))).status == "cancelled"
    other = target(tmp_path, spark)
    store.acquire("first")
    with pytest.raises(LockHeld, match="first"):
        other.acquire("second")
    with pytest.raises(LockHeld):
        runner.run_plan(spark, other, Plan([task], [], ""), lambda t, s: rules)
    store._write("_lock.json", {"holder": "thief"}, True)
    lost = runner.run_task(spark, store, task, rules, runner.Options())
    assert (lost.status, lost.loaded, store.read("Wide")) == ("paused", 0, None)
    other.delete("_lock.json")
    assert runner.run_plan(spark, other, Plan([task], [], ""), lambda t, s: rules)[0].loaded == 5000 and not other.exists("_lock.json")


def test_ranges_of_chunks(spark):
    rows = spark.range(1, 6000).select("id", runner.range_of(F.col("id")).alias("r")).groupBy("r").agg(F.min("id"), F.max("id")).orderBy("r").collect()
    assert [r[0] for r in rows] == list(range(len(rows))) and rows[0][1:] == (1, 3) and rows[1][1:] == (4, 4) and rows[2][1:] == (5, 6)
    assert all(a[2] + 1 == b[1] for a, b in zip(rows, rows[1:])) and max(r[2] - r[1] + 1 for r in rows) == runner.WIDEST


def catalogs():
    source = Catalog("source", {"SRC": Table("SRC", [Column("ID", 0, "bigint", False), Column("AT", 1, "timestamp"), Column("KIND", 2, "string")], primary_key=["ID"])})
    things = Table("Things", [Column("Id", 0, "bigint", False), Column("At", 1, "datetime2(0)"), Column("State", 2, "string", False, default="'new'"), Column("Number", 3, "bigint", False, identity=True)], primary_key=["Id"])
    return source, Catalog("target", {"Things": things})


def test_defaults_identities_and_rounding(spark, tmp_path):
    source, goal = catalogs()
    spark.sql("select id as ID, timestamp_micros(1000000 * id + 500000) as AT, 'a' as KIND from range(1500)").createOrReplaceTempView("SRC")
    mapping = {"tables": {"Things": {"kind": "direct", "sources": ["SRC"], "columns": {"Id": {"expr": "s.ID"}, "At": {"expr": "s.AT"}}}}}
    made = plans.generate(mapping, source, goal)
    assert plans.validate(spark, made, goal) == {"T01": []} and made.tasks[0].identity == "Number" and made.tasks[0].rounding == {"At": 0}
    store = target(tmp_path, spark)
    reports = runner.run_plan(spark, store, made, rules_from(spark, goal, made))
    rows = store.read("Things").orderBy("Id").collect()
    assert [(r["Number"], r["State"]) for r in rows] == [(k + 1, "new") for k in range(1500)]
    assert store.read("Things").where("unix_micros(At) <> 1000000 * (Id + 1)").count() == 0
    told = report.final_report(spark, store, made, reports, goal.tables, 61)
    assert told["headline"] == "Transferred 1,500 of 1,500 rows into 1 table in 1m 01s; row counts validated."
    assert any("no checksums" in n for n in told["notes"]) and report.report_markdown(told).startswith("# Transferred")
    del goal.tables["Things"].columns[2:]
    goal.tables["Things"].columns.append(Column("Needed", 2, "int", False))
    assert plans.validate(spark, made, goal)["T01"] == ["State is no column of Things", "Needed is required and has no value"]


def test_lookup_plans_and_cut_keys(spark, tmp_path):
    spark.sql("select * from values (1, 'F'), (2, 'O'), (3, 'Z') t(ID, KIND)").createOrReplaceTempView("orders_src")
    spark.sql("select * from values ('F', 'done'), ('O', 'open') t(K, NAME)").createOrReplaceTempView("kinds_src")
    text = lambda *names: [Column(n, k, "string", False) for k, n in enumerate(names)]
    source = Catalog("source", {"orders_src": Table("orders_src", text("ID", "KIND"), primary_key=["ID"]), "kinds_src": Table("kinds_src", text("K", "NAME"), primary_key=["K"])})
    goal = Catalog("target", {"Kinds": Table("Kinds", text("K", "Name"), primary_key=["K"]), "Orders": Table("Orders", text("Id", "Name"), foreign_keys=[ForeignKey("FK", ["Name"], "Kinds", ["K"])])})
    mapping = {"tables": {"Kinds": {"kind": "direct", "sources": ["kinds_src"], "columns": {"K": {"expr": "s.K"}, "Name": {"expr": "s.NAME"}}}, "Orders": {"kind": "lookup", "sources": ["orders_src"], "columns": {"Id": {"expr": "s.ID"}, "Name": {"expr": "s.KIND"}}, "reads": ["Kinds"], "merge": "select g.Id, k.Name, g.__k0 from stg g join Kinds k on k.K = g.Name"}}}
    made = plans.generate(mapping, source, goal)
    made.cut.append(("Orders", "Kinds"))
    store = target(tmp_path, spark)
    reports = runner.run_plan(spark, store, made, rules_from(spark, goal, made))
    assert [(r.target, r.loaded, r.merge) for r in reports] == [("Kinds", 2, "not applicable"), ("Orders", 2, "ran")]
    assert sorted(map(tuple, store.read("Orders").collect())) == [(1, "done"), (2, "open")]
    assert runner.verify_cut(store, made, goal) == [("Orders", "FK", 2)]
    with pytest.raises(runner.BadTask, match="needs a merge query"):
        runner.run_task(spark, target(tmp_path, spark, "x"), replace(made.tasks[1], merge_query=None), load.Constraints(), runner.Options())


def test_preflight(spark, tmp_path):
    source, goal = catalogs()
    spark.sql("select id as ID, current_timestamp() as AT, 'a' as KIND from range(10)").createOrReplaceTempView("SRC")
    made = plans.generate({"tables": {"Things": {"kind": "direct", "sources": ["SRC"], "columns": {"Id": {"expr": "s.ID"}, "At": {"expr": "s.AT"}}}}}, source, goal)
    store = target(tmp_path, spark)
    checks = preflight.preflight(spark, store, made, source, goal)
    assert preflight.may_start(checks) and {c.name: c.detail for c in checks}["estimated_rows"] == "10 rows"
    runner.run_plan(spark, store, made, rules_from(spark, goal, made))
    held = {c.name: c for c in preflight.preflight(spark, store, made, source, goal)}["target_rows"]
    assert (held.ok, held.severity) == (False, "warning") and "Things (10)" in held.detail
    with pytest.raises(preflight.Refused):
        preflight.guard(store, made, goal)
    preflight.guard(store, made, goal, named=["Things"])
    preflight.guard(store, made, goal, truncate=True)
    blind = {c.name: c for c in preflight.preflight(spark, store, made, source, None, target_mark="m", same_target=None)}
    assert blind["target_connection"].severity == "error" and (blind["target_rows"].not_run, blind["target_rows"].severity) == (True, "warning")
    assert blind["target_identity"].severity == "error" and blind["target_identity"].not_run
    doubled = Task("T01", "Things", "direct", "select s.ID as Id, s.ID as __k0 from SRC s cross join range(2)", ["Id"], ["__k0"])
    assert not {c.name: c.ok for c in preflight.preflight(spark, store, Plan([doubled], [], ""), source, goal)}["chunk_keys"]
    assert [c.name for c in preflight.preflight(spark, store, Plan([], [], ""), source, goal)] == ["plan_valid"]


def test_headlines():
    one = runner.TaskReport("T1", "A", 10, 0, 10, 0, 0, "done")
    assert report.headline([one], 5) == "Transferred 0 of 10 rows into 1 table in 5s (10 rejected); A loaded 0 of 10 rows."
    held = runner.TaskReport("T1", "A", 10, 10, 0, 3, 13, "done")
    assert report.headline([held], None) == "Transferred 10 of 10 rows into 1 table in an unknown time; target tables were not empty before this run; counts compare rows added."
    unknown = runner.TaskReport("T1", "A", None, 4, 0, 0, 4, "done")
    assert report.headline([unknown], 3700) == "Transferred 4 of at least 0 rows into 1 table in 1h 01m; row counts NOT CONFIRMED."
    assert "duplicate keys" in report.loaded_nothing_note(replace(one, before=4)) and "none was rejected" in report.loaded_nothing_note(replace(one, rejected=0))
    assert report.samples_note(5, 3, 3).startswith("2 of 5") and report.samples_note(5, 3, 5) == "3 of 5 recorded rejected rows are shown" and report.samples_note(0, 0, 0) is None
