import random

import pytest
from pyspark.sql import functions as F

from loomshift.operators import load, profile, reconcile
from loomshift.plans import report, runner
from loomshift.plans.plan import Plan, Task
from loomshift.streaming import progress


def test_reject_split_against_a_row_at_a_time_model(spark):
    pick = random.Random(11)
    rows = [(k, pick.choice([None, 1, 2, 3, 9]), pick.choice(["1", "x", None]), pick.choice(["ok", "far too long", None]), pick.choice([-1, 1, None]), pick.randint(0, 30)) for k in range(300)]
    df = spark.createDataFrame(rows, "k int, parent int, num string, txt string, qty int, pk int")
    parents = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    existing = spark.createDataFrame([(7,), (8,)], "pk int")
    rules = load.Constraints({"num": "int"}, {"txt": 6}, ["txt"], ["qty > 0"], [load.ForeignKey(["parent"], parents, ["id"])], ["pk"])
    found = {r["k"]: r["reason"] for r in load.mark_rejects(df, rules, ["k"], existing).collect()}
    taken, wanted = {7, 8}, {}
    for k, parent, num, txt, qty, pk in rows:
        reason = "conversion" if num == "x" else "truncation" if txt and len(txt) > 6 else "not_null" if txt is None else "check" if qty == -1 else "fk" if parent == 9 else "duplicate" if pk in taken else None
        wanted[k] = reason
        if reason is None:
            taken.add(pk)
    assert found == wanted


def test_row_numbers_and_chunks(spark):
    got = [(r["id"], r["rn"]) for r in load.row_numbers(spark.range(1000).repartition(7), ["id"]).orderBy("id").collect()]
    assert got == [(k, k + 1) for k in range(1000)]
    sizes = spark.range(1, 5001).select(load.chunk_of(F.col("id"), 1500).alias("c")).groupBy("c").count().orderBy("c").collect()
    assert [tuple(r) for r in sizes] == [(1, 1000), (2, 1000), (3, 1000), (4, 1500), (5, 500)]


@pytest.fixture
def shop(spark):
    """Orders and their lines with the planted faults: two orphans, three long comments, one zero quantity."""
    orders = spark.range(1, 3006).selectExpr("cast(id as int) ORD_ID", "cast(case id when 3001 then -1 when 3002 then -2 else id % 1000 + 1 end as int) CUST_ID", "case when id >= 3003 then repeat('x', 300) else 'ok' end CMNT")
    lines = spark.range(9002).selectExpr("cast(case when id >= 9000 then 3001 + id - 9000 else id div 3 + 1 end as int) ORD_ID", "cast(case when id >= 9000 then 1 else id % 3 + 1 end as int) LINE_NO", "cast(case id when 0 then 0 else 1 end as int) QTY")
    orders.createOrReplaceTempView("ORD_HDR")
    lines.createOrReplaceTempView("ORD_LINE")
    spark.range(1, 1001).selectExpr("cast(id as int) CUST_ID").createOrReplaceTempView("CUST")
    tasks = [
        Task("T01", "Customers", "direct", "select CUST_ID as CustomerId, CUST_ID as __k0 from CUST", ["CustomerId"], ["__k0"], 500),
        Task("T02", "Orders", "direct", "select ORD_ID as OrderId, CUST_ID as CustomerId, CMNT as Comment, ORD_ID as __k0 from ORD_HDR", ["OrderId", "CustomerId", "Comment"], ["__k0"], 500, ["T01"]),
        Task("T03", "OrderLines", "direct", "select ORD_ID as OrderId, LINE_NO as LineNumber, QTY as Quantity, ORD_ID as __k0, LINE_NO as __k1 from ORD_LINE", ["OrderId", "LineNumber", "Quantity"], ["__k0", "__k1"], 500, ["T02"]),
    ]

    def rules_of(task, store):
        if task.id == "T01":
            return load.Constraints(primary_key=["CustomerId"])
        if task.id == "T02":
            return load.Constraints(max_length={"Comment": 200}, foreign_keys=[load.ForeignKey(["CustomerId"], store.read("Customers"), ["CustomerId"])], primary_key=["OrderId"])
        return load.Constraints(checks=["Quantity > 0"], foreign_keys=[load.ForeignKey(["OrderId"], store.read("Orders"), ["OrderId"])], primary_key=["OrderId", "LineNumber"])

    return Plan(tasks, [], ""), rules_of


def test_eight_rejects_and_a_paused_run_that_resumes(spark, shop, tmp_path):
    plan, rules_of = shop
    spark.sparkContext.setCheckpointDir(str(tmp_path / "cp"))
    store = runner.Store(spark, f"file://{tmp_path}/target")
    paused = runner.run_plan(spark, store, plan, rules_of, runner.Options(stop_after=2))
    assert paused[-1].status == "done" and paused[0].status == "done" or paused[-1].status == "paused"
    reports = runner.run_plan(spark, store, plan, rules_of)
    assert [(r.target, r.source_rows, r.loaded, r.rejected, r.status) for r in reports] == [("Customers", 1000, 1000, 0, "done"), ("Orders", 3005, 3000, 5, "done"), ("OrderLines", 9002, 8999, 3, "done")]
    assert [store.read(r.target).count() for r in reports] == [1000, 3000, 8999]
    found = spark.read.parquet(f"file://{tmp_path}/target/_rejects").select("task", "key_json", "reason").collect()
    assert sorted((r["reason"], r["key_json"]) for r in found) == sorted([("fk", '{"__k0":3001}'), ("fk", '{"__k0":3002}'), *(("truncation", f'{{"__k0":{k}}}') for k in (3003, 3004, 3005)), ("check", '{"__k0":1,"__k1":1}'), ("fk", '{"__k0":3001,"__k1":1}'), ("fk", '{"__k0":3002,"__k1":1}')])
    assert all(runner.reconcile(r)[0] for r in runner.run_plan(spark, runner.Store(spark, f"file://{tmp_path}/again"), plan, rules_of))
    assert report.headline(reports, 61) == "Transferred 12,999 of 13,007 rows into 3 tables in 1m 01s (8 rejected); row counts validated."


def test_guards(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path / "cp"))
    spark.range(10).selectExpr("id as v", "'x' as s").createOrReplaceTempView("ten")
    task = Task("T01", "Ten", "direct", "select v, s, v as __k0 from ten", ["v", "s"], ["__k0"])
    with pytest.raises(runner.BadTask, match="fails alike"):
        runner.run_task(spark, runner.Store(spark, f"file://{tmp_path}/a"), task, load.Constraints({"s": "int"}), runner.Options())
    with pytest.raises(runner.BadTask, match="nothing loaded"):
        runner.run_task(spark, runner.Store(spark, f"file://{tmp_path}/b"), task, load.Constraints(checks=["v < 0"]), runner.Options())
    store = runner.Store(spark, f"file://{tmp_path}/c")
    assert runner.run_task(spark, store, task, load.Constraints(primary_key=["v"]), runner.Options()).loaded == 10
    again = Task("T02", "Ten", "direct", task.query, task.columns, task.keys)
    report = runner.run_task(spark, store, again, load.Constraints(primary_key=["v"]), runner.Options())
    assert (report.loaded, report.rejected, report.before, report.after) == (0, 10, 10, 10)


def test_profiles(spark):
    df = spark.createDataFrame([(1, "Ab  "), (2, None), (2, "x" * 50)], "a int, b string")
    found = {r["column"]: r for r in profile.with_ratios(profile.column_profiles(df)).collect()}
    assert (found["a"]["distinct_values"], found["a"]["max_text"], found["b"]["nulls"], found["b"]["max_len"]) == (2, "2", 1, 50)
    assert found["b"]["max_text"] == "x" * 39 + "…"
    assert [r[0] for r in profile.first_samples(df, "b", ["a"]).collect()] == ["Ab  ", "x" * 50]
    assert profile.has_duplicate_key(df, ["a"]) and not profile.has_duplicate_key(df, ["a", "b"])
    empty = profile.with_ratios(profile.column_profiles(df.limit(0))).where("column = 'a'").first()
    assert empty["null_ratio"] == 0 and empty["distinct_ratio"] is None


def test_reconciliation():
    assert reconcile.count_match(10, 2, 0, 8) == (True, None)
    assert reconcile.count_match(None, 2, 0, 8) == (None, "not compared: source unknown")
    assert reconcile.checksum_gate(True, True, 0, 0) is None and reconcile.checksum_gate(True, True, None, 0) == "the row count before the run is unknown"


def test_event_stream(spark, tmp_path):
    source, target = f"file://{tmp_path}/events", f"file://{tmp_path}/out"
    for k in range(3):
        spark.range(k * 10, k * 10 + 10).withColumn("kind", F.lit("a")).coalesce(1).write.mode("append").parquet(source)
    for _ in range(2):  # nothing new the second time
        progress.append_new(progress.tail(spark, source, "id long, kind string"), target, f"file://{tmp_path}/cp").awaitTermination()
    assert spark.read.parquet(target).count() == 30
