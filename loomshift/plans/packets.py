"""What reviewers and agents get to read, and what they hand in."""

from __future__ import annotations

import copy
import difflib
import json
import re
from dataclasses import asdict, dataclass, field

from ..sources.catalog import Catalog, Table
from .patch import PatchFault
from .state import PHASES

#: Lines of context around a change, and the letters that a profile shows of a text.
CONTEXT = 3


@dataclass
class Submission:
    phase: str
    base: int
    operations: list[dict] = field(default_factory=list)
    responses: list[dict] = field(default_factory=list)
    summary: str = ""


def parse_submission(text: str) -> Submission:
    """A patch as it is handed in: {phase, baseVersion, ops, responses, summary}."""
    try:
        given = json.loads(text)
    except ValueError as bad:
        raise PatchFault(f"no JSON: {bad}") from None
    if not isinstance(given, dict):
        raise PatchFault("a patch is an object")
    if given.get("phase") not in PHASES:
        raise PatchFault(f"{given.get('phase')!r} is no phase")
    base = given.get("baseVersion")
    if not isinstance(base, int) or isinstance(base, bool) or base < 0:
        raise PatchFault("baseVersion is no version")
    for name in ("ops", "responses"):
        if not isinstance(given.get(name, []), list) or not all(isinstance(x, dict) for x in given.get(name, [])):
            raise PatchFault(f"{name} is no list of objects")
    return Submission(given["phase"], base, given.get("ops", []), given.get("responses", []), str(given.get("summary") or ""))


def split_batches(script: str) -> list[str]:
    """The batches of a script, parted by lines that say GO; empty ones are left out."""
    return [b.strip("\r\n") for b in re.split(r"(?im)^[ \t]*GO[ \t]*;?[ \t]*$", script) if b.strip()]


def percent(ratio: float | None) -> str:
    return "?" if ratio is None else f"{ratio * 100:.0f}%" if ratio in (0, 1) or ratio >= 0.1 else f"{ratio * 100:.1f}%"


def table_text(table: Table, profiles: dict[tuple[str, str], dict] | None = None) -> str:
    """A table in few words: a line for itself, one for each column, and what is known of the column's values."""
    rows = "rows unknown" if table.rows is None else f"{table.rows:,} rows"
    out = [f"{table.key} ({rows}{'' if table.primary_key else ', no key'})"]
    refs = {c: f"{k.parent}.{p}" for k in table.foreign_keys for c, p in zip(k.columns, k.parent_columns)}
    for c in table.columns:
        marks = [c.data_type, "" if c.nullable else "required", "key" if c.name in table.primary_key else "", "identity" if c.identity else "", "computed" if c.computed else "", f"-> {refs[c.name]}" if c.name in refs else ""]
        out.append(f"  {c.name}: {', '.join(m for m in marks if m)}")
        seen = (profiles or {}).get((table.key, c.name))
        if seen:
            parts = [seen.get("semantic_class"), f"null {percent(seen.get('null_ratio'))}", f"distinct {percent(seen.get('distinct_ratio'))}"]
            parts += [f"{seen['min_text']} .. {seen['max_text']}"] if seen.get("min_text") is not None else []
            out.append("    " + ", ".join(p for p in parts if p))
    return "\n".join(out)


def without_samples(profiles: dict[tuple[str, str], dict], catalog: Catalog) -> dict[tuple[str, str], dict]:
    """Profiles without values of the source: no samples, and no bounds of texts. The structure's fingerprint is not touched."""
    texts = {(t.key, c.name) for t in catalog.tables.values() for c in t.columns if re.match(r"(n?(var)?char|n?text|string)", c.data_type.lower())}
    out = copy.deepcopy(profiles)
    for key, p in out.items():
        p.pop("samples", None)
        if key in texts:
            p["min_text"] = p["max_text"] = None
    return out


def draft_packet(mapping: dict, source: Catalog, target: Catalog, profiles: dict | None = None, names: list[str] | None = None) -> dict:
    """What an agent needs for some target tables: these, the sources that they are mapped from or may be, and the draft."""
    names = names or sorted(target.tables)
    wanted = set()
    for n in names:
        m = mapping.get("tables", {}).get(n, {})
        wanted |= {*m.get("sources", []), *(s for s, _ in m.get("candidates", []))}
    return {
        "targets": [table_text(target.tables[n]) for n in names if n in target.tables],
        "sources": [table_text(source.tables[s], profiles) for s in sorted(wanted) if s in source.tables],
        "draft": {n: mapping["tables"][n] for n in names if n in mapping.get("tables", {})},
    }


def rework_packet(mapping: dict, remarks: list, source: Catalog, target: Catalog, profiles: dict | None = None) -> dict:
    """The draft packet of the tables that open remarks speak of, and the remarks."""
    given = [r for r in remarks if r.status == "open"]
    names = sorted({t for t in target.tables for r in given if r.anchor == t or r.anchor.startswith(t + ".")})
    return {**draft_packet(mapping, source, target, profiles, names or None), "remarks": [asdict(r) for r in given]}


def line_diff(before: str, after: str, context: int = CONTEXT) -> list[tuple[str, str]]:
    """(mark, line): "+" and "-" for changed lines, " " for those around them, "…" for what is left out."""
    a, b = before.split("\n"), after.split("\n")
    out: list[tuple[str, str]] = []
    groups = list(difflib.SequenceMatcher(None, a, b, autojunk=False).get_grouped_opcodes(context))
    for n, group in enumerate(groups):
        if n or group[0][1]:
            out.append(("…", ""))
        for tag, i, j, k, m in group:
            if tag == "equal":
                out += [(" ", x) for x in a[i:j]]
            else:
                out += [("-", x) for x in a[i:j]] + [("+", x) for x in b[k:m]]
    if groups and groups[-1][-1][2] < len(a):
        out.append(("…", ""))
    return out
