"""What a run is told to have done: validation of each task, notes, the headline, and the report as a table.

A number that nobody established stays None and is explained in words; it is never zero.
"""

from __future__ import annotations

import html
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.reconcile import checksum_gate, column_checksums, compare_checksums
from ..sources.catalog import Table
from .plan import Plan, Task
from .runner import Options, TaskReport, normalised, reconcile, recorded_rejects, rejected_rows
from .state import Project, StateFault
from .store import Store

SAMPLES = 5
#: Types of which the text form is exact, so that sums over it can be compared.
EXACT = ("tinyint", "smallint", "int", "integer", "bigint", "boolean", "bit", "string", "char", "varchar", "nchar", "nvarchar", "decimal", "numeric", "money", "date", "datetime2", "timestamp", "timestamp_ntz", "uniqueidentifier")
#: What the headline says of the row counts.
COUNTS = {"same": "row counts validated", "differ": "row counts MISMATCH", "unknown": "row counts NOT CONFIRMED", "held": "target tables were not empty before this run; counts compare rows added"}


@dataclass
class Validation:
    compared: bool = False
    count_match: bool | None = None
    count_note: str | None = None
    checksums: list[tuple[str, bool]] = field(default_factory=list)
    skipped: str | None = None
    left_out: list[str] = field(default_factory=list)


def checksum_columns(task: Task, table: Table) -> tuple[list[str], list[str]]:
    """The loaded columns whose sums can be compared, and the others with the reason."""
    known = {c.name: c for c in table.columns}
    good, left_out = [], []
    for name in task.columns:
        c = known.get(name)
        kind = c.data_type.split("(")[0].strip().lower() if c else ""
        why = "unknown to the target" if c is None else "computed" if c.computed else f"{kind} has no exact sum" if kind not in EXACT else None
        if why:
            left_out.append(f"{name}: {why}")
        else:
            good.append(name)
    return good, left_out


def validate_task(spark: SparkSession, store: Store, task: Task, report: TaskReport, table: Table, checksums: bool = True) -> Validation:
    """Counts, and where nothing blurs them sums over the columns, of a task's source and target."""
    out = Validation()
    out.count_match, out.count_note = reconcile(report)
    out.compared = out.count_match is not None
    if out.count_match is False:
        added = report.after - report.before
        out.count_note = f"{report.source_rows - report.rejected:,} new rows were expected and {added:,} were found"
    out.skipped = checksum_gate(checksums, report.status == "done", report.before, report.rejected)
    if out.skipped:
        return out
    columns, out.left_out = checksum_columns(task, table)
    if task.mode == "staging" or task.identity:
        columns, out.skipped = [], "the source has no rows of the target's form"
    elif not columns:
        out.skipped = "no column can be compared"
    there = store.read(task.target)
    if columns and there is not None:
        types = {f.name: f.dataType.simpleString() for f in there.schema.fields}
        sums = column_checksums(normalised(spark.sql(task.query), task), columns, types)
        found = compare_checksums(sums, column_checksums(there, columns)).collect()
        out.checksums = sorted((r["column"], r["matched"]) for r in found)
    return out


def loaded_nothing_note(report: TaskReport) -> str | None:
    """For a task that loaded no row of a source that had some."""
    if report.loaded or not report.source_rows:
        return None
    if not report.rejected:
        return f"{report.target}: none of {report.source_rows:,} source rows loaded and none was rejected; the source changed, or its count and its query disagree"
    head = f"{report.target}: none of {report.source_rows:,} source rows loaded, {report.rejected:,} were rejected"
    if report.before:
        return f"{head}; the table held {report.before:,} rows before, so duplicate keys mean that they were there already"
    return f"{head}; counts that balance over an empty table validate nothing, and the mapping is more likely wrong than the data"


def samples_note(rejected: int, shown: int, recorded: int) -> str | None:
    if not rejected:
        return None
    if recorded < rejected:
        return f"{rejected - recorded:,} of {rejected:,} rejected rows are not on record: the run broke off between a commit and their recording"
    return f"{shown} of {recorded:,} recorded rejected rows are shown" if shown < recorded else None


def error_samples(store: Store, options: Options | None = None, most: int = SAMPLES) -> DataFrame | None:
    """At most so many rejects of each task, by key."""
    rows = rejected_rows(store, options)
    if rows is None:
        return None
    order = Window.partitionBy("task").orderBy("key_json", "row_json")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def duration_text(seconds: float | None) -> str:
    if seconds is None:
        return "an unknown time"
    s = round(max(0.0, seconds))
    if s < 60:
        return f"{s}s"
    return f"{s // 60}m {s % 60:02d}s" if s < 3600 else f"{s // 3600}h {s % 3600 // 60:02d}m"


def headline(reports: list[TaskReport], seconds: float | None, validations: list[Validation] | None = None) -> str:
    """One line; it never calls a count validated that nobody made."""
    checked = validations if validations is not None else [Validation(r is not None, r) for r in (reconcile(x)[0] for x in reports)]
    known = [r.source_rows for r in reports if r.source_rows is not None]
    tables = len({r.target.lower() for r in reports})
    rejected = sum(r.rejected for r in reports)
    verdict = "differ" if any(v.count_match is False for v in checked) else "unknown" if not checked or not all(v.compared for v in checked) else "same"
    counts = COUNTS[verdict]
    if any(r.before for r in reports):
        counts = COUNTS["held"] if verdict == "same" else f"{counts} ({COUNTS['held']})"
    empty = ", ".join(f"{r.target} loaded 0 of {r.source_rows:,} rows" for r in reports if loaded_nothing_note(r))
    if empty:
        counts = empty if counts == COUNTS["same"] else f"{counts}; {empty}"
    sums = [matched for v in checked for _, matched in v.checksums]
    left_out = sum(len(v.left_out) for v in checked)
    text = f"Transferred {sum(r.loaded for r in reports):,} {'of' if len(known) == len(reports) else 'of at least'} {sum(known):,} rows"
    text += f" into {tables} {'table' if tables == 1 else 'tables'} in {duration_text(seconds)}"
    text += f" ({rejected:,} rejected)" if rejected else ""
    text += f"; {counts}"
    if sums:
        text += f", checksums {sum(sums)}/{len(sums)} matched"
        text += f", {left_out} column{'s' if left_out > 1 else ''} not compared" if left_out else ""
    return text + "."


def final_report(spark: SparkSession, store: Store, plan: Plan, reports: list[TaskReport], tables: dict[str, Table], seconds: float | None = None, options: Options | None = None, cut: list[tuple[str, str, int | None]] = ()) -> dict:
    """Tasks with their validations, totals, notes and the headline."""
    options = options or Options()
    tasks = {t.id: t for t in plan.tasks}
    checked = [validate_task(spark, store, tasks[r.id], r, tables[r.target]) for r in reports]
    notes, rows = [], []
    for r, v in zip(reports, checked):
        recorded = recorded_rejects(store, r.id, options)
        told = [loaded_nothing_note(r), samples_note(r.rejected, min(SAMPLES, recorded), recorded), v.count_note and f"{r.target}: {v.count_note}"]
        if v.skipped:
            told.append(f"{r.target}: no checksums, {v.skipped}")
        if v.left_out:
            told.append(f"{r.target}: not compared: {', '.join(v.left_out)}")
        notes += [x for x in told if x]
        rows.append(asdict(r) | {"validation": asdict(v)})
    for child, key, orphans in cut:
        state = "could not be checked" if orphans is None else f"is not trusted: {orphans:,} orphans" if orphans else "holds"
        notes.append(f"{child}: the foreign key {key} was cut for the load and {state}")
    loaded = sum(r.loaded for r in reports)
    rate = round(loaded / seconds, 1) if seconds else None
    return {"tasks": rows, "loaded": loaded, "rejected": sum(r.rejected for r in reports), "rows_per_second": rate, "notes": notes, "headline": headline(reports, seconds, checked)}


def report_frame(spark: SparkSession, reports: list[TaskReport]) -> DataFrame:
    """(task, target, source_rows, loaded, rejected, held_before, held_after, status, balanced) of a run."""
    rows = [(r.id, r.target, r.source_rows, r.loaded, r.rejected, r.before, r.after, r.status, reconcile(r)[0]) for r in reports]
    return spark.createDataFrame(rows, "task string, target string, source_rows long, loaded long, rejected long, held_before long, held_after long, status string, balanced boolean")


def report_markdown(report: dict) -> str:
    """The report as a page of text."""
    out = [f"# {report['headline']}", "", "| Task | Target | Source | Loaded | Rejected | Status |", "| --- | --- | --- | --- | --- | --- |"]
    for t in report["tasks"]:
        source = "unknown" if t["source_rows"] is None else f"{t['source_rows']:,}"
        out.append(f"| {t['id']} | {t['target']} | {source} | {t['loaded']:,} | {t['rejected']:,} | {t['status']} |")
    return "\n".join([*out, "", *(f"* {n}" for n in report["notes"])])


def report_html(report: dict) -> str:
    """The report as one file for a browser."""
    cells = lambda tag, values: "<tr>" + "".join(f"<{tag}>{html.escape(str(v))}</{tag}>" for v in values) + "</tr>"
    names = ("id", "target", "source_rows", "loaded", "rejected", "status")
    rows = [cells("td", ("unknown" if t[n] is None else t[n] for n in names)) for t in report["tasks"]]
    notes = "".join(f"<li>{html.escape(n)}</li>" for n in report["notes"])
    head = html.escape(report["headline"])
    return f"<!doctype html><meta charset=utf-8><title>{head}</title><h1>{head}</h1><table>{cells('th', names)}{''.join(rows)}</table><ul>{notes}</ul>"


def live_totals(reports: list[TaskReport]) -> dict:
    """Rows done, rows in all (None while any is unknown), rejects, and tasks by status."""
    totals = [r.source_rows for r in reports]
    status: dict[str, int] = {}
    for r in reports:
        status[r.status] = status.get(r.status, 0) + 1
    return {"done": sum(r.loaded for r in reports), "total": None if None in totals else sum(totals), "rejected": sum(r.rejected for r in reports), "tasks": status}


def finish_run(store: Store, project: Project, report: dict, run_id: str = "run") -> dict:
    """Keep the report of a completed run and approve the last phase. A run that is finished already stays as it was."""
    path = f"_runs/{run_id}/report.json"
    kept = store.read_json(path)
    if kept is None:
        if any(t["status"] != "done" for t in report["tasks"]):
            raise StateFault("the run is not complete")
        store.write_new(path, report)
        kept = report
    for phase in ("transfer", "complete"):
        project.status[phase] = "approved"
    return kept
