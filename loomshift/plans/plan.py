"""From an approved mapping to ordered tasks of Spark SQL, checked by analysis alone.

A mapping is {tables: {target: {kind, sources, from, filter, columns: {column: {expr | default}}}}, drops: {source: reason}}.
Kinds: direct (one source), merge (its own FROM text, alias s for the first source), lookup (staged), skip.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import SparkSession

from ..sources.catalog import Catalog, Table
from .graph import load_order

CHUNK, LOB_CHUNK = 100_000, 5_000
RESERVED = "__n_"


@dataclass
class Task:
    id: str
    target: str
    mode: str
    query: str
    columns: list[str]
    keys: list[str]
    chunk_size: int = CHUNK
    depends_on: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    merge_query: str | None = None
    #: Tables of the target that the merge query looks up, as views with "_" for "."
    reads: list[str] = field(default_factory=list)
    #: Temporal columns and the decimals of a second that the target keeps; -1 for whole minutes.
    rounding: dict[str, int] = field(default_factory=dict)
    #: A column that the target numbers itself.
    identity: str | None = None


@dataclass
class Plan:
    tasks: list[Task]
    cut: list[tuple[str, str]]
    mapping_hash: str
    warnings: list[str] = field(default_factory=list)


def quoted(name: str) -> str:
    return ".".join("`" + part.replace("`", "``") + "`" for part in name.split(".", 1))


def mapping_hash(mapping: dict) -> str:
    """Of the fields that the SQL comes from."""
    used = {t: {k: m.get(k) for k in ("kind", "sources", "from", "filter")} | {"columns": {c: {k: x.get(k) for k in ("expr", "default")} for c, x in m.get("columns", {}).items()}} for t, m in mapping.get("tables", {}).items()}
    return hashlib.sha256(json.dumps(used, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def mapping_errors(mapping: dict, source: Catalog, target: Catalog) -> list[str]:
    """Names must be those of the catalogs, case included."""
    out = []
    for name, m in mapping.get("tables", {}).items():
        if name not in target.tables:
            near = next((t for t in target.tables if t.lower() == name.lower()), None)
            out.append(f"{name}: no such target table" + (f" (it is {near})" if near else ""))
            continue
        if m.get("kind") not in ("direct", "merge", "lookup", "skip"):
            out.append(f"{name}: {m.get('kind')!r} is no kind")
        out += [f"{name}: no such source table {s}" for s in m.get("sources", []) if s not in source.tables]
        if m.get("kind") == "direct" and len(m.get("sources", [])) > 1:
            out.append(f"{name}: a direct load has one source")
        columns = {c.name: c for c in target.tables[name].columns}
        for column, x in m.get("columns", {}).items():
            if column not in columns:
                out.append(f"{name}.{column}: no such column")
            elif columns[column].computed or columns[column].rowversion:
                out.append(f"{name}.{column}: cannot be written")
            elif not (x.get("expr") or x.get("default")):
                out.append(f"{name}.{column}: neither expression nor default")
    out += [f"drop {d}: no such source table or column" for d in mapping.get("drops", {}) if d not in source.tables and not any(f"{t.key}.{c.name}" == d for t in source.tables.values() for c in t.columns)]
    return out


def mapping_blockers(mapping: dict, source: Catalog, target: Catalog) -> list[str]:
    """What keeps a mapping from approval: unmapped tables, required columns without a value, sources nobody decided on."""
    tables, drops = mapping.get("tables", {}), mapping.get("drops", {})
    out = [f"{t}: not mapped" for t in sorted(target.tables) if t not in tables]
    for name, m in tables.items():
        if m.get("kind") != "skip" and name in target.tables:
            out += [f"{name}.{c.name}: required, without a value" for c in target.tables[name].columns if not (c.nullable or c.identity or c.computed or c.rowversion) and c.name not in m.get("columns", {})]
    used = {s for m in tables.values() if m.get("kind") != "skip" for s in m.get("sources", [])}
    covered = {c for m in tables.values() for x in m.get("columns", {}).values() for c in x.get("source_columns", [])}
    for t in source.tables.values():
        if t.key not in used and t.key not in drops:
            out.append(f"{t.key}: neither used nor dropped")
        elif t.key in used:
            out += [f"{t.key}.{c.name}: neither used nor dropped" for c in t.columns if f"{t.key}.{c.name}" not in covered and f"{t.key}.{c.name}" not in drops]
    return out


def _query(name: str, m: dict, table: Table, source: Catalog) -> tuple[str, list[str], list[str], list[str]]:
    warnings, columns, parts = [], [], []
    for c in table.columns:
        x = m.get("columns", {}).get(c.name) or ({"default": c.default} if c.default and not c.nullable else None)
        if not x:
            continue
        if c.computed or c.rowversion:
            warnings.append(f"{c.name} is generated and left out")
            continue
        parts.append(f"{x.get('expr') or x['default']} AS {quoted(c.name)}")
        columns.append(c.name)
    first = m["sources"][0] if m.get("sources") else None
    keys = (source.tables[first].best_key() or []) if first in source.tables else []
    parts += [f"s.{quoted(k)} AS `__k{n}`" for n, k in enumerate(keys)]
    text = "SELECT " + ",\n       ".join(parts)
    if m.get("from"):
        text += f"\nFROM {m['from']}"
    elif first:
        text += f"\nFROM {quoted(first)} AS s"
    if m.get("filter"):
        text += f"\nWHERE ({m['filter']})"
    if not keys:
        warnings.append("no key: loaded as a whole")
    return text, columns, [f"__k{n}" for n in range(len(keys))], warnings


def rounding_of(table: Table, columns: list[str]) -> dict[str, int]:
    """What the target's temporal types keep of a second."""
    out = {}
    for c in table.columns:
        found = re.fullmatch(r"(datetime2|datetimeoffset|time|smalldatetime)(?:\((\d)\))?", c.data_type.strip().lower())
        if c.name in columns and found:
            out[c.name] = -1 if found[1] == "smalldatetime" else min(6, int(found[2] or 6))
    return out


def generate(mapping: dict, source: Catalog, target: Catalog, chunk_size: int = CHUNK) -> Plan:
    """Tasks in an order that loads parents first; edges whose columns may all be null are cut first where keys form a cycle."""
    todo = {t: m for t, m in mapping.get("tables", {}).items() if m.get("kind") != "skip"}
    edges, soft = [], []
    for t in todo:
        nullable = {c.name for c in target.tables[t].columns if c.nullable}
        for k in target.tables[t].foreign_keys:
            edges.append((t, k.parent))
            if set(k.columns) <= nullable:
                soft.append((t, k.parent))
    order, cut = load_order(todo, edges, soft)
    width = max(2, len(str(len(order))))
    ids = {t: f"T{n:0{width}d}" for n, t in enumerate(order, 1)}
    tasks = []
    for t in order:
        text, columns, keys, warnings = _query(t, todo[t], target.tables[t], source)
        large = any(c.data_type in ("text", "ntext", "image", "xml") or c.data_type.endswith("(max)") for s in todo[t].get("sources", []) for c in source.tables[s].columns)
        if target.tables[t].triggers:
            warnings.append("the target has triggers")
        if todo[t]["kind"] == "lookup":
            warnings.append("review the merge query")
        parents = sorted({ids[p] for c, p in edges if c == t and p in ids and p != t and (c, p) not in cut})
        table, staged = target.tables[t], todo[t]["kind"] == "lookup"
        identity = next((c.name for c in table.columns if c.identity and c.name not in columns), None)
        task = Task(ids[t], t, "staging" if staged else "direct", text, columns, keys, min(chunk_size, LOB_CHUNK) if large else chunk_size, parents, warnings)
        task.merge_query, task.reads = todo[t].get("merge"), todo[t].get("reads", [])
        task.rounding, task.identity = rounding_of(table, columns), identity
        tasks.append(task)
    return Plan(tasks, cut, mapping_hash(mapping))


def plan_order(order: list[str], ids: list[str]) -> list[str]:
    """The stored order's known ids, then those it misses."""
    known = [i for i in dict.fromkeys(order) if i in ids]
    return known + sorted(set(ids) - set(known))


def _uncastable(spark: SparkSession, task: Task, known: dict) -> list[str]:
    """Columns that Spark can never cast to the target's type; types that it cannot read are not judged."""
    out = []
    for name in task.columns:
        kind = known[name].data_type if name in known else ""
        try:
            spark.sql(f"SELECT CAST(NULL AS {kind})")
        except (AnalysisException, ParseException):
            continue
        try:
            spark.sql(f"SELECT CAST({quoted(name)} AS {kind}) FROM ({task.query}\n)")
        except AnalysisException as bad:
            if "CAST" in (bad.getCondition() or "") or "DATATYPE_MISMATCH" in (bad.getCondition() or ""):
                out.append(f"{name} can never be a {kind}")
    return out


def _merge_errors(spark: SparkSession, task: Task) -> list[str]:
    """Of a lookup task's merge query, analysed over an empty staging view and the tables that it reads, if these are known."""
    if task.mode != "staging":
        return ["a direct load has no merge query"] if task.merge_query else []
    if not task.merge_query:
        return ["a lookup load needs a merge query"]
    spark.sql(task.query).limit(0).createOrReplaceTempView("stg")
    if not all(spark.catalog.tableExists(t.replace(".", "_")) for t in task.reads):
        return []
    names = spark.sql(task.merge_query).schema.names
    return [f"column {c} is not in the merge query" for c in task.columns if c not in names]


def order_faults(order: list[str], ids: list[str]) -> dict[str, list[str]]:
    """What is wrong with a stored order: ids that no task has, that come twice, and those that it misses."""
    seen, twice = set(), []
    for i in order:
        if i in seen and i not in twice:
            twice.append(i)
        seen.add(i)
    return {"unknown": [i for i in dict.fromkeys(order) if i not in ids], "twice": twice, "missing": [i for i in ids if i not in seen]}


def validate(spark: SparkSession, plan: Plan, target: Catalog) -> dict[str, list[str]]:
    """Errors by task. Queries are analysed against the registered source views and never run."""
    out: dict[str, list[str]] = {}
    for task in plan.tasks:
        errors = []
        if not task.query.strip():
            errors.append("no query")
        if "\r" in task.query.replace("\r\n", "\n"):
            line = task.query.replace("\r\n", "\n").split("\r")[0].count("\n") + 1
            errors.append(f"a bare carriage return in line {line}")
        try:
            names = spark.sql(task.query).schema.names
            errors += [f"column {n} comes twice" for n in sorted({n for n in names if names.count(n) > 1})]
            errors += [f"column {c} is not in the query" for c in task.columns if c not in names]
            errors += [f"{c} is a reserved name" for c in names if c.startswith(RESERVED)]
            table = target.tables[task.target]
            known = {c.name: c for c in table.columns}
            errors += [f"{c} is no column of {task.target}" for c in task.columns if c not in known]
            given = {*task.columns, task.identity}
            errors += [f"{c.name} is required and has no value" for c in table.columns if not (c.nullable or c.computed or c.rowversion or c.name in given)]
            errors += _uncastable(spark, task, known)
            errors += _merge_errors(spark, task)
        except AnalysisException as bad:
            errors.append(str(bad).split("\n")[0])
        out[task.id] = errors
    return out
