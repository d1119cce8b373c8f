"""Findings about a pair of catalogs: rules R01 to R16."""

from __future__ import annotations

from dataclasses import dataclass

from ..plans.graph import cycles
from ..sources.catalog import Catalog

HUGE_ROWS, MOSTLY_NULL = 10_000_000, 0.95


@dataclass(frozen=True)
class Finding:
    rule: str
    severity: str
    side: str
    object: str
    message: str
    count: int | None = None
    id: str = ""


def _columns(catalog: Catalog, test):
    return [(f"{t.key}.{c.name}", t, c) for t in catalog.tables.values() for c in t.columns if test(t, c)]


def analyse(source: Catalog, target: Catalog, profiles: dict[tuple[str, str], dict] | None = None, orphans: dict[tuple[str, str], int] | None = None) -> list[Finding]:
    """All findings, numbered in the order of rule, side and object.

    profiles: (source table, column) -> {sampled_rows, nulls}. orphans: (source table, key name) -> count; a key that was
    not counted is told as such, which is something else than none.
    """
    found: list[Finding] = []
    say = lambda *a, **k: found.append(Finding(*a, **k))
    sides = (("src", source), ("tgt", target))
    for side, catalog in sides:
        for t in catalog.tables.values():
            if t.best_key() is None:
                say("R01", "high" if side == "src" and t.rows else "low", side, t.key, "no primary key and no unique index over required columns")
            if t.temporal:
                say("R13", "medium", side, t.key, f"temporal table ({t.temporal})")
        for name, _, c in _columns(catalog, lambda t, c: c.data_type in ("text", "ntext", "image")):
            say("R02", "medium", side, name, f"deprecated type {c.data_type}")
        for name, _, c in _columns(catalog, lambda t, c: c.data_type == "xml" or c.data_type.endswith("(max)")):
            say("R03", "low", side, name, f"large values ({c.data_type})")
        own = catalog.server.get("collation")
        for name, _, c in _columns(catalog, lambda t, c, own=own: bool(own and c.collation and c.collation != own)):
            say("R04", "info", side, name, f"collation {c.collation} differs from the database's {own}")
    a, b = source.server.get("collation"), target.server.get("collation")
    if a and b and a != b:
        say("R04", "medium", "both", "database", f"collations differ: {a} and {b}")
    for rule, flag, text in (("R05", "identity", "identity column"), ("R07", "computed", "computed column, not written"), ("R08", "rowversion", "rowversion column, not written")):
        for name, _, _ in _columns(target, lambda t, c, flag=flag: getattr(c, flag)):
            say(rule, "info", "tgt", name, text)
    for t in target.tables.values():
        if t.triggers:
            say("R06", "medium", "tgt", t.key, f"{len(t.triggers)} trigger(s)", count=len(t.triggers))
        if t.rows:
            say("R15", "high", "tgt", t.key, "the target table is not empty", count=t.rows)
    for t in source.tables.values():
        for key in t.foreign_keys:
            if not key.trusted:
                n = (orphans or {}).get((t.key, key.name))
                severity = "medium" if n is None else "high" if n else "low"
                say("R09", severity, "src", f"{t.key}.{key.name}", "untrusted foreign key, " + ("orphans not counted" if n is None else f"{n} orphan(s)"), count=n)
        if t.rows == 0:
            say("R11", "low", "src", t.key, "the source table is empty")
        elif t.rows and t.rows > HUGE_ROWS:
            say("R12", "info", "src", t.key, "large table", count=t.rows)
    for (table, column), p in (profiles or {}).items():
        if p["sampled_rows"] and p["nulls"] / p["sampled_rows"] > MOSTLY_NULL:
            say("R10", "low", "src", f"{table}.{column}", "almost always null")
    edges = [(t.key, k.parent) for t in target.tables.values() for k in t.foreign_keys]
    for child in sorted({a for a, b in edges if a == b}):
        say("R14", "medium", "tgt", child, "references itself")
    for loop in cycles(target.tables, edges):
        say("R14", "medium", "tgt", " ↔ ".join(loop), "foreign keys form a cycle")
    for what in ("major", "compat"):
        x, y = source.server.get(what), target.server.get(what)
        if x is not None and y is not None and y < x:
            say("R16", "medium", "both", what, f"the target's {what} level {y} is below the source's {x}")
    place = {"src": 0, "tgt": 1, "both": 2}
    found.sort(key=lambda f: (f.rule, place[f.side], f.object.lower()))
    return [Finding(f.rule, f.severity, f.side, f.object, f.message, f.count, f"F{k:03d}") for k, f in enumerate(found, 1)]
