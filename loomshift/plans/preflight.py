"""What has to hold before a run starts, as a list of checks that each speak for themselves.

A check that could not run is a warning only if what kept it from running is an error already; else it is an error.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from ..operators.profile import has_duplicate_key
from ..sources.catalog import Catalog, drifted
from .plan import Plan, Task, plan_order, validate
from .store import LOCK, Store


@dataclass
class Check:
    name: str
    ok: bool
    severity: str
    detail: str
    not_run: bool = False


@dataclass
class NonEmpty:
    target: str
    rows: int
    keyless: bool


class Refused(RuntimeError):
    """A run that may not start."""


def passed(name: str, detail: str) -> Check:
    return Check(name, True, "ok", detail)


def failed(name: str, detail: str, severity: str = "error") -> Check:
    return Check(name, False, severity, detail)


def not_run(name: str, detail: str, cause_is_an_error: bool) -> Check:
    return Check(name, False, "warning" if cause_is_an_error else "error", detail, True)


def one_table(query: str) -> bool:
    """Whether a query reads one table as it stands, whose key then needs no probe."""
    text = re.sub(r"\s+", " ", query).strip()
    return bool(re.fullmatch(r"SELECT .*? FROM (`[^`]+`\.)?`[^`]+` AS s( WHERE \(.*\))?", text)) and " JOIN " not in text.upper()


def needs_key_probe(task: Task) -> bool:
    return bool(task.keys) and (task.mode != "direct" or not one_table(task.query))


def non_empty(store: Store, plan: Plan, target: Catalog) -> list[NonEmpty]:
    """The plan's targets that hold rows now, counted now."""
    out = []
    for name in dict.fromkeys(t.target for t in plan.tasks):
        rows = store.read(name)
        n = rows.count() if rows is not None else 0
        if n:
            table = target.tables.get(name)
            out.append(NonEmpty(name, n, not (table and (table.primary_key or table.unique))))
    return out


def guard(store: Store, plan: Plan, target: Catalog, truncate: bool = False, named: list[str] = ()) -> None:
    """Refuse a new run over tables that hold rows, unless they are emptied first or each is named."""
    held = [] if truncate else [x.target for x in non_empty(store, plan, target) if x.target not in named]
    if held:
        raise Refused(f"these target tables hold rows and were not named: {', '.join(held)}")


def preflight(
    spark: SparkSession, store: Store, plan: Plan, source: Catalog | None, target: Catalog | None,
    source_mark: str | None = None, target_mark: str | None = None, truncate: bool = False, same_target: bool | None = True,
) -> list[Check]:
    """The checks in order. source and target are the catalogs as they are now, None where they cannot be read; the marks
    are the fingerprints that the plan was made from."""
    checks = []
    if not plan.tasks:
        return [failed("plan_valid", "the plan has no tasks")]
    order = [t for i in plan_order([], [t.id for t in plan.tasks]) for t in plan.tasks if t.id == i]
    if target is None:
        checks.append(not_run("plan_valid", "not checked: the target cannot be read", True))
    else:
        bad = {i: e for i, e in validate(spark, plan, target).items() if e}
        checks.append(failed("plan_valid", "tasks with errors: " + ", ".join(sorted(bad))) if bad else passed("plan_valid", f"{len(order)} tasks without errors"))
    for side, catalog in (("source", source), ("target", target)):
        checks.append(passed(f"{side}_connection", "readable") if catalog else failed(f"{side}_connection", "the catalog cannot be read"))
    for side, mark, catalog in (("source", source_mark, source), ("target", target_mark, target)):
        name = f"{side}_drift"
        if mark is not None and catalog is None:
            checks.append(not_run(name, "not checked: the catalog cannot be read", True))
        elif drifted(mark, catalog):
            checks.append(failed(name, "the structure changed since the plan was made"))
        else:
            checks.append(passed(name, "unchanged" if mark else "no earlier state to compare with"))
    if same_target is None:
        checks.append(not_run("target_identity", "it is unknown whether this is the target that the plan was made for", False))
    else:
        checks.append(passed("target_identity", "the plan's own target") if same_target else failed("target_identity", "another target than the plan was made for"))
    checks += _target_checks(store, plan, target, truncate)
    checks += _source_checks(spark, order, failed_already=any(not c.ok and c.name in ("plan_valid", "source_connection") for c in checks))
    keyless = [t.target for t in order if not t.keys]
    checks.append(failed("keyless_tasks", "loaded as a whole, and again from the start after a stop: " + ", ".join(keyless), "warning") if keyless else passed("keyless_tasks", "every task has a key"))
    return checks


def _target_checks(store: Store, plan: Plan, target: Catalog | None, truncate: bool) -> list[Check]:
    if target is None:
        return [not_run(n, "not checked: the target cannot be read", True) for n in ("target_tables", "control_table", "target_rows")]
    missing = [t.target for t in plan.tasks if t.target not in target.tables]
    checks = [failed("target_tables", "missing: " + ", ".join(missing)) if missing else passed("target_tables", f"all {len({t.target for t in plan.tasks})} are there")]
    holder = store.read_json(LOCK)
    checks.append(failed("control_table", f"in use by {holder.get('holder')}") if holder else passed("control_table", "free"))
    held = non_empty(store, plan, target)
    if not held:
        checks.append(passed("target_rows", "all are empty"))
    else:
        told = ", ".join(f"{x.target} ({x.rows:,})" for x in held)
        free = [x.target for x in held if x.keyless]
        if truncate:
            checks.append(passed("target_rows", f"to be emptied first: {told}"))
        else:
            more = f"; no key keeps rows from being loaded twice into {', '.join(free)}" if free else ""
            checks.append(failed("target_rows", f"already hold rows: {told}{more}", "warning"))
    return checks


def _source_checks(spark: SparkSession, order: list[Task], failed_already: bool) -> list[Check]:
    checks, total, unknown, doubled, unprobed = [], 0, [], [], []
    for task in order:
        try:
            rows: DataFrame = spark.sql(task.query)
        except AnalysisException:
            unknown.append(task.id)
            unprobed += [task.id] if needs_key_probe(task) else []
            continue
        total += rows.count()
        if needs_key_probe(task) and has_duplicate_key(rows, task.keys):
            doubled.append(task.id)
    text = f"{total:,} rows"
    checks.append(not_run("estimated_rows", f"at least {text}; not counted: {', '.join(unknown)}", failed_already) if unknown else passed("estimated_rows", text))
    if doubled:
        checks.append(failed("chunk_keys", "the key repeats, so a row may be read twice or never: " + ", ".join(doubled)))
    elif unprobed:
        checks.append(not_run("chunk_keys", "not probed: " + ", ".join(unprobed), failed_already))
    else:
        checks.append(passed("chunk_keys", "unique wherever a query joins"))
    return checks


def may_start(checks: list[Check]) -> bool:
    return not any(c.severity == "error" for c in checks)


def checks_frame(spark: SparkSession, checks: list[Check]) -> DataFrame:
    return spark.createDataFrame([(c.name, c.ok, c.severity, c.not_run) for c in checks], "name string, ok boolean, severity string, not_run boolean")
