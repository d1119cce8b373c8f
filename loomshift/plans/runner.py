"""Running a plan: tasks in dependency order, chunks committed by manifest, rejects apart, resumable.

A task's rows are numbered, judged and staged once, so every later step, a resumed one included, sees the same rows with the
same verdicts. Ranges of chunks are then written and committed one after another; ranges double up to ``WIDEST`` chunks, so
the number of jobs and what the driver holds stay small however many chunks there are.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.temporal import round_to_scale, to_minute
from ..operators.load import Constraints, assert_accounted, chunk_of, mark_rejects, rejects, row_numbers
from ..operators.reconcile import count_match
from ..sources.catalog import Catalog, orphan_count
from .plan import Plan, Task
from .store import LockHeld, Store

__all__ = ["BadTask", "CheckpointLost", "LockHeld", "Options", "Store", "TaskReport", "run_plan", "run_task"]

GUARD_CHUNKS = 3
#: Ranges of 1, 2, 4, ... chunks follow the guarded ones, and then ranges of this many.
WIDEST = 1024
CONSTRAINT_FAULTS = ("check", "fk", "duplicate")
#: Of several signals the strongest holds.
SIGNALS = {"fail": "failed", "cancel": "cancelled", "pause": "paused"}


class BadTask(RuntimeError):
    """The plan of a task is wrong, rather than its rows."""


class CheckpointLost(RuntimeError):
    """Progress was recorded for a task of which the target knows nothing: to go on would load rows twice."""


@dataclass
class TaskReport:
    id: str
    target: str
    source_rows: int | None = None
    loaded: int = 0
    rejected: int = 0
    before: int | None = None
    after: int | None = None
    status: str = "pending"
    note: str | None = None
    merge: str = "not applicable"


@dataclass
class Options:
    error_mode: str = "skip"
    stop_after: int | None = None
    rejects_path: str = "_rejects"
    signal: object = field(default=lambda: None)
    run_id: str = "run"


def range_of(chunk: Column) -> Column:
    """The range of a chunk: 0 for the guarded ones, then 1, 2, 4, ... and at last WIDEST chunks a range."""
    at, doubling = chunk - GUARD_CHUNKS, WIDEST - 1
    steps = WIDEST.bit_length() - 1
    grown = F.when(at <= doubling, 1 + F.floor(F.log2(at.cast("double")))).otherwise(1 + steps + F.floor((at - doubling - 1) / WIDEST))
    return F.when(chunk <= GUARD_CHUNKS, 0).otherwise(grown).cast("int")


def normalised(rows: DataFrame, task: Task) -> DataFrame:
    """Temporal columns rounded as the target stores them."""
    return rows.withColumns({c: to_minute(F.col(c)) if scale < 0 else round_to_scale(F.col(c), scale) for c, scale in task.rounding.items()})


def _source_rows(spark: SparkSession, store: Store, task: Task) -> tuple[DataFrame, str]:
    """The rows that a task offers to its target, and what became of its merge query.

    A staging task's own query fills the view ``stg``; its merge query, a SELECT over it, gives the rows.
    """
    rows = spark.sql(task.query)
    if task.mode != "staging":
        if task.merge_query:
            raise BadTask(f"{task.id}: a direct load has no merge query")
        return rows, "not applicable"
    if not task.merge_query:
        raise BadTask(f"{task.id}: a lookup load needs a merge query")
    rows.createOrReplaceTempView("stg")
    for table in task.reads:
        there = store.read(table)
        if there is None:
            raise BadTask(f"{task.id}: {table} holds no rows to look up")
        there.createOrReplaceTempView(table.replace(".", "_"))
    return spark.sql(task.merge_query), "ran"


def _stage(spark: SparkSession, store: Store, task: Task, rules: Constraints) -> dict:
    """Number, judge and write a task's rows once; what was staged before is used again."""
    folder = f"{task.target}/_stage/{task.id}"
    told = store.read_json(f"{folder}/stage.json")
    if told is not None:
        return told
    existing = store.read(task.target)
    before = existing.count() if existing is not None else 0
    rows, merged = _source_rows(spark, store, task)
    source_rows = rows.count()  # apart from the rows that are staged, which must be as many
    keys = [k for k in task.keys if k in rows.columns]
    if keys or task.identity:
        rows = row_numbers(rows, keys or task.columns)
    else:
        rows = rows.withColumn("rn", F.lit(1).cast("long"))
    columns = list(task.columns)
    if task.identity:
        top = existing.agg(F.max(task.identity)).first()[0] if existing is not None else None
        rows = rows.withColumn(task.identity, F.col("rn") + F.lit(top or 0))
        columns.append(task.identity)
    marked = mark_rejects(normalised(rows, task), rules, ["rn", *keys], existing)
    chunk = chunk_of(F.col("rn"), task.chunk_size) if keys else F.lit(1).cast("long")
    marked = marked.withColumn("chunk", chunk).withColumn("range", range_of(F.col("chunk")))
    path = f"{folder}/rows-{uuid.uuid4().hex}"
    marked.write.partitionBy("range").parquet(f"{store.root}/{path}")
    staged = spark.read.schema(marked.schema).parquet(f"{store.root}/{path}").count() if source_rows else 0
    assert_accounted(source_rows, staged, 0)
    told = {"path": path, "rows": source_rows, "before": before, "keys": keys or columns[:1], "columns": columns, "merge": merged, "schema": marked.schema.json()}
    store.write_new(f"{folder}/stage.json", told)
    return told


def _staged(spark: SparkSession, store: Store, told: dict) -> DataFrame:
    if not told["rows"]:
        return spark.createDataFrame([], StructType.fromJson(json.loads(told["schema"])))
    return spark.read.parquet(f"{store.root}/{told['path']}")


def _tally(rows: DataFrame, *by: str) -> DataFrame:
    bad = F.col("reason").isNotNull()
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.count("reason").alias("bad"), F.count(F.when(F.col("reason") == "duplicate", 1)).alias("dup"),
        F.min("chunk").alias("first"), F.max("chunk").alias("last"), F.min(F.when(bad, F.col("chunk"))).alias("first_bad"), F.mode("reason", True).alias("often"),
    )


def _broken_chunk(staged: DataFrame) -> tuple[int, str] | None:
    """The first chunk of several rows that all fail alike for a reason that no constraint explains, and the reason."""
    one = staged.groupBy("chunk").agg(F.count("*").alias("n"), F.count("reason").alias("bad"), F.min("reason").alias("low"), F.max("reason").alias("high"))
    alike = one.where((F.col("n") > 1) & (F.col("n") == F.col("bad")) & (F.col("low") == F.col("high")) & ~F.col("low").isin(*CONSTRAINT_FAULTS))
    found = alike.agg(F.min(F.struct("chunk", "low"))).first()[0]
    return (found["chunk"], found["low"]) if found else None


def _asked(signal) -> str | None:
    """The status that the strongest of the given signals asks for. A signal is a name, several names, or None."""
    given = signal() or ()
    given = (given,) if isinstance(given, str) else given
    return next((status for name, status in SIGNALS.items() if name in given), None)


def run_task(spark: SparkSession, store: Store, task: Task, rules: Constraints, options: Options) -> TaskReport:
    """Load the chunks of a task that are not committed yet.

    Constraints are evaluated once over the task's rows, against the rows that the target held before the task began. stop
    mode ends at the first rejected row, which is recorded once: chunks before its chunk stay. The guard ends a task whose
    first chunks load nothing and reject something, unless the target held rows and all rejects are duplicate keys. A task
    without key is one chunk.
    """
    report = TaskReport(task.id, task.target)
    mirror = store.read_json(f"_runs/{options.run_id}/{task.id}.json")
    state = store.manifest(task.target, task.id)
    if state is None and mirror and (mirror["loaded"] or mirror["rejected"]):
        raise CheckpointLost(f"{task.id}: {mirror['loaded']:,} rows loaded and {mirror['rejected']:,} rejected are on record, but {task.target} has no manifest of them")
    state = state or {"ranges": [], "next": 1, "loaded": 0, "rejected": 0, "duplicates": 0, "done": False}
    if state["done"]:
        report.status, report.before, report.source_rows, report.merge = "done", state["before"], state["source_rows"], state["merge"]
    else:
        told = _stage(spark, store, task, rules)
        state |= {"before": told["before"], "source_rows": told["rows"], "merge": told["merge"]}
        report.before, report.source_rows, report.merge = told["before"], told["rows"], told["merge"]
        report.status = "running"
        _load(spark, store, task, options, state, told, report)
    report.loaded, report.rejected = state["loaded"], state["rejected"]
    after = store.read(task.target)
    report.after = after.count() if after is not None else 0
    recorded = recorded_rejects(store, task.id, options)
    if report.status == "done" and recorded != report.rejected:
        report.note = f"{report.rejected - recorded:,} of {report.rejected:,} rejected rows are not on record"
    return report


def _load(spark: SparkSession, store: Store, task: Task, options: Options, state: dict, told: dict, report: TaskReport) -> None:
    staged = _staged(spark, store, told)
    ranges = sorted(_tally(staged, "range").collect(), key=lambda r: r["first"])
    broken = _broken_chunk(staged) if any(r["bad"] for r in ranges) else None
    limit = state["next"] + options.stop_after - 1 if options.stop_after is not None else None
    final = ranges[-1]["last"] if ranges else 0
    for r in ranges:
        first, last, fault = max(r["first"], state["next"]), r["last"], None
        if last < first:
            continue
        stopped = _asked(options.signal)
        if not stopped and limit is not None and last > limit:
            last, fault = limit, "paused"
        if stopped or last < first:
            report.status = stopped or "paused"
            return
        if broken and first <= broken[0] <= last:
            last, fault = broken[0] - 1, "broken"
        bad_at = r["first_bad"] if r["first_bad"] is not None and r["first_bad"] >= first else None
        if options.error_mode == "stop" and bad_at is not None and bad_at <= last:
            last, fault = bad_at - 1, "stop"
        if last >= first and not _commit(store, task, options, state, told, staged.where((F.col("range") == r["range"]) & F.col("chunk").between(first, last)), first, last):
            report.status, report.note = "paused", "the lock on the target was lost"
            return
        if fault == "broken":
            raise BadTask(f"{task.id}: every row of chunk {broken[0]} fails alike ({broken[1]})")
        if fault == "stop":
            row = staged.where((F.col("chunk") == bad_at) & F.col("reason").isNotNull()).orderBy("rn").limit(1)
            _record(store, task, options, told, row, "stopped")
            report.status, report.note = "failed", f"chunk {bad_at} has a rejected row"
            return
        guarded = min(GUARD_CHUNKS, final)
        if first <= guarded <= last and not state["loaded"] and state["rejected"] and not (state["before"] and state["duplicates"] == state["rejected"]):
            raise BadTask(f"{task.id}: nothing loaded and {state['rejected']} row(s) rejected, most often for {r['often']}")
        if fault == "paused":
            report.status = "paused"
            return
    report.status, state["done"] = "done", True
    store.commit(task.target, task.id, state)
    store.delete(f"{task.target}/_stage/{task.id}")


def _commit(store: Store, task: Task, options: Options, state: dict, told: dict, rows: DataFrame, first: int, last: int) -> bool:
    """Write a range of chunks, count what was written, and commit it; its rejects are recorded after that."""
    n, bad, dup = rows.agg(F.count("*"), F.count("reason"), F.count(F.when(F.col("reason") == "duplicate", 1))).first()
    path = f"{task.target}/task={task.id}/{first}-{last}-{uuid.uuid4().hex[:8]}"
    written = 0
    if n > bad:
        rows.where("reason is null").select(*(F.col(f"`{c}`") for c in told["columns"])).write.parquet(f"{store.root}/{path}")
        written = store.spark.read.parquet(f"{store.root}/{path}").count()
    assert_accounted(n, written, bad)
    if store.lock_lost():
        store.delete(path)
        return False
    state["ranges"].append({"path": path, "rows": written, "first": first, "last": last})
    state["next"] = last + 1
    state["loaded"] += written
    state["rejected"] += bad
    state["duplicates"] += dup
    store.commit(task.target, task.id, state)
    store.delete(f"{options.rejects_path}/task={task.id}/range=stopped")
    if bad:
        _record(store, task, options, told, rows, f"{first}-{last}")
    mirror = f"_runs/{options.run_id}/{task.id}.json"
    store._write(mirror, {"loaded": state["loaded"], "rejected": state["rejected"]}, True)
    return True


def _record(store: Store, task: Task, options: Options, told: dict, rows: DataFrame, name: str) -> None:
    given = rows.drop("chunk", "rn", "range")
    rejects(given, told["keys"]).write.mode("overwrite").parquet(f"{store.root}/{options.rejects_path}/task={task.id}/range={name}")


def rejected_rows(store: Store, options: Options | None = None) -> DataFrame | None:
    """(key_json, row_json, reason, number, task, range) of all rejects on record."""
    path = (options or Options()).rejects_path
    return store.spark.read.parquet(f"{store.root}/{path}") if store.names(path) else None


def recorded_rejects(store: Store, task_id: str, options: Options) -> int:
    path = f"{options.rejects_path}/task={task_id}"
    return store.spark.read.parquet(f"{store.root}/{path}").count() if store.names(path) else 0


def run_plan(spark: SparkSession, store: Store, plan: Plan, rules_of, options: Options | None = None) -> list[TaskReport]:
    """Run tasks in order, holding the target's lock; rules_of(task, store) gives a task's constraints once its parents are
    loaded, so that children of rejected parents are rejected in turn. The first task that does not finish ends the run."""
    options, out = options or Options(), []
    store.acquire(f"{options.run_id} ({uuid.uuid4().hex})")
    try:
        for task in plan.tasks:
            report = run_task(spark, store, task, rules_of(task, store), options)
            out.append(report)
            if report.status != "done":
                break
    finally:
        store.release()
    return out


def verify_cut(store: Store, plan: Plan, target: Catalog) -> list[tuple[str, str, int | None]]:
    """(child, key, orphans) of the foreign keys that the load order had to cut, checked on what was loaded.

    Orphans are None where either table holds nothing to check with.
    """
    out = []
    for child, parent in plan.cut:
        for key in (k for k in target.tables[child].foreign_keys if k.parent == parent):
            rows, parents = store.read(child), store.read(parent)
            if rows is None:
                out.append((child, key.name, 0))
            elif parents is None:
                out.append((child, key.name, None))
            else:
                out.append((child, key.name, orphan_count(rows, key, parents)))
    return out


def reconcile(report: TaskReport) -> tuple[bool | None, str | None]:
    if report.status != "done":
        return None, "the task did not finish"
    return count_match(report.source_rows, report.rejected, report.before, report.after)
