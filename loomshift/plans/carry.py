"""What survives when a mapping is drafted anew, and the risks and sums that a mapping tells of itself."""

from __future__ import annotations

import re

from ..functions.types import Sampled, check_types, parse_type
from ..operators.match import AUTO_ACCEPT
from ..sources.catalog import Catalog, Column

#: Who decided: what these said outlives a new draft.
KEPT = ("agent", "human", "carried")
UNKNOWN_RISK = "not evaluated: custom expression"
_NAME = r"(?:`[^`]+`|\[[^\]]+\]|\w+)"
_BARE = re.compile(rf"\s*({_NAME})\s*\.\s*({_NAME})\s*")
_FROM = re.compile(rf"\b(?:FROM|JOIN)\s+({_NAME}(?:\s*\.\s*{_NAME})*)(?:\s+AS)?\s+(?!ON\b|JOIN\b|WHERE\b|LEFT\b|INNER\b)({_NAME})", re.IGNORECASE)


def _plain(name: str) -> str:
    return name.strip().strip("`[]")


def aliases(sources: list[str], text: str | None = None) -> dict[str, str]:
    """alias -> table of a mapping's FROM text; without one its first source is s."""
    if not text:
        return {"s": sources[0]} if sources else {}
    found = {}
    for table, alias in _FROM.findall(text if re.match(r"\s*FROM\b", text, re.IGNORECASE) else f"FROM {text}"):
        found[_plain(alias).lower()] = ".".join(_plain(p) for p in re.findall(_NAME, table))
    return found


def bare_reference(expr: str | None, sources: list[str], text: str | None = None) -> tuple[str, str] | None:
    """(table, column) if an expression is one column and nothing else. A best effort on the text."""
    match = _BARE.fullmatch(expr or "")
    table = aliases(sources, text).get(_plain(match[1]).lower()) if match else None
    return (table, _plain(match[2])) if table else None


def _column(catalog: Catalog, table: str, name: str) -> Column | None:
    found = next((t for k, t in catalog.tables.items() if k.lower() == table.lower()), None)
    return next((c for c in found.columns if c.name.lower() == name.lower()), None) if found else None


def bare_risk(entry: dict, mapping: dict, source: Catalog, target: Column, profiles: dict | None = None) -> tuple[bool, str | None]:
    """(whether the expression is one known column, the risk of its conversion)."""
    found = bare_reference(entry.get("expr"), mapping.get("sources", []), mapping.get("from"))
    column = _column(source, *found) if found else None
    if column is None:
        return False, None
    seen = (profiles or {}).get(found)
    sampled = Sampled(seen["sampled_rows"], seen.get("min_text"), seen.get("max_text"), seen.get("max_len")) if seen else None
    return True, check_types(parse_type(column.data_type), parse_type(target.data_type), sampled).risk


def normalise_risks(mapping: dict, stored: dict | None, source: Catalog, target: Catalog, profiles: dict | None = None) -> dict:
    """The mapping with risks as the engine states them, whatever was handed in: those of unchanged expressions as they were,
    none for defaults, those of single columns by their types, and a remark for all other expressions."""
    out = {**mapping, "tables": {}}
    for name, m in mapping.get("tables", {}).items():
        columns = {}
        before = ((stored or {}).get("tables", {}).get(name) or {}).get("columns", {})
        for c, entry in m.get("columns", {}).items():
            goal = _column(target, name, c)
            old = before.get(c)
            if old and old.get("expr") == entry.get("expr"):
                risk = old.get("type_risk")
            elif not (entry.get("expr") or "").strip() or goal is None:
                risk = None
            else:
                known, risk = bare_risk(entry, m, source, goal, profiles)
                risk = risk if known else UNKNOWN_RISK
            columns[c] = {**entry, "type_risk": risk}
        out["tables"][name] = {**m, "columns": columns}
    return out


def _resolves(entry: dict, source: Catalog) -> bool:
    """Whether all columns that a decision names are still there."""
    parts = [x.rpartition(".") for x in entry.get("source_columns", [])]
    return all(_column(source, table, column) for table, _, column in parts)


def carry_over(old: dict, draft: dict, source: Catalog, target: Catalog, profiles: dict | None = None) -> dict:
    """A new draft with the earlier decisions of agents and people that the catalogs still bear out, marked as carried."""
    out = {"tables": dict(draft.get("tables", {})), "drops": dict(draft.get("drops", {}))}
    for name, m in old.get("tables", {}).items():
        goal = target.tables.get(name)
        if goal is None or not all(s in source.tables for s in m.get("sources", [])):
            continue
        whole = m.get("method") in KEPT
        new = dict(m if whole else out["tables"].get(name, {}))
        same = new.get("sources") == m.get("sources") and new.get("from") == m.get("from")
        columns = {} if whole else dict(new.get("columns", {}))
        writable = {c.name: c for c in goal.columns if not (c.computed or c.rowversion)}
        for c, entry in m.get("columns", {}).items():
            if c not in writable or not _resolves(entry, source) or not (whole or same and entry.get("method") in KEPT):
                continue
            known, risk = bare_risk(entry, m, source, writable[c], profiles)
            columns[c] = {**entry, "method": "carried" if entry.get("method") in KEPT else entry.get("method"), "type_risk": risk if known else entry.get("type_risk")}
        if whole or new:
            out["tables"][name] = {**new, "columns": columns, **({"method": "carried"} if whole else {})}
    known = {*source.tables, *(f"{t.key}.{c.name}" for t in source.tables.values() for c in t.columns)}
    used = {s for m in out["tables"].values() for s in m.get("sources", [])}
    out["drops"] |= {k: why for k, why in old.get("drops", {}).items() if k in known and k not in used}
    return out


def risk_warnings(mapping: dict) -> list[str]:
    """One line for each column with a risk, tables that are skipped apart."""
    tables = {t: m for t, m in mapping.get("tables", {}).items() if m.get("kind") != "skip"}
    return [f"{t}.{c}: {x['type_risk']}" for t, m in tables.items() for c, x in m.get("columns", {}).items() if x.get("type_risk")]


def mapping_summary(mapping: dict, blockers: list[str] = (), accept: float = AUTO_ACCEPT) -> dict[str, int]:
    tables = mapping.get("tables", {})
    weak = sum(x.get("method") in ("fuzzy", "vector") and x.get("confidence", 1.0) < accept for m in tables.values() for x in (m, *m.get("columns", {}).values()))
    return {"tables": len(tables), "columns": sum(len(m.get("columns", {})) for m in tables.values()), "drops": len(mapping.get("drops", {})), "attention": weak, "blockers": len(blockers), "risks": len(risk_warnings(mapping))}
