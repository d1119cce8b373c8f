"""Proposing a mapping: names as vectors, scores of tables and columns, and one-to-one assignment. Metadata only."""

from __future__ import annotations

import math
from collections import Counter

from ..functions.names import Synonyms, name_tokens
from ..functions.types import Sampled, check_types, parse_type
from ..operators import match
from ..sources.catalog import Catalog, Column, Table

#: Words of a description that a search looks at.
DESCRIBED = 8
EMPTY_REASON = "the source table is empty and nothing uses it"


def name_features(tokens: list[str]) -> Counter:
    """Words, and trigrams of the words between marks."""
    joined = "#" + "#".join(tokens) + "#"
    return Counter([f"w:{t}" for t in tokens] + [f"g:{joined[k : k + 3]}" for k in range(len(joined) - 2)]) if tokens else Counter()


class Vectors:
    """TF-IDF vectors of length one over a fixed set of documents."""

    def __init__(self, documents: list[list[str]]):
        self.n = len(documents)
        self.df = Counter(f for d in documents for f in name_features(d))

    def of(self, tokens: list[str]) -> dict[str, float]:
        raw = {f: n * (math.log((1 + self.n) / (1 + self.df[f])) + 1) * (match.WORD_WEIGHT if f[0] == "w" else match.GRAM_WEIGHT) for f, n in name_features(tokens).items()}
        length = math.sqrt(sum(x * x for x in raw.values())) or 1.0
        return {f: x / length for f, x in raw.items()}


def cosine(a: dict[str, float], b: dict[str, float]) -> float:
    if len(a) > len(b):
        a, b = b, a
    return min(1.0, max(0.0, sum(x * b.get(f, 0.0) for f, x in a.items())))


class Names:
    """Tokens and vectors of both catalogs' tables and columns; a column's tokens leave out its table's words."""

    def __init__(self, source: Catalog, target: Catalog, synonyms: Synonyms | None = None):
        self.synonyms = synonyms or Synonyms()
        tables = [t for c in (source, target) for t in c.tables.values()]
        self.vectors = Vectors([self.table_tokens(t) for t in tables] + [self.column_tokens(t, c) for t in tables for c in t.columns])
        self._known: dict[tuple, dict[str, float]] = {}

    def table_tokens(self, t: Table) -> list[str]:
        return name_tokens(t.key.rpartition(".")[2], self.synonyms)

    def column_tokens(self, t: Table, c: Column) -> list[str]:
        return name_tokens(c.name, self.synonyms, frozenset(self.table_tokens(t)))

    def _vector(self, t: Table, c: Column | None) -> dict[str, float]:
        key = (id(t), c.name if c else None)
        if key not in self._known:
            self._known[key] = self.vectors.of(self.column_tokens(t, c) if c else self.table_tokens(t))
        return self._known[key]

    def table_similarity(self, a: Table, b: Table) -> float:
        return cosine(self._vector(a, None), self._vector(b, None))

    def column_similarity(self, a: Table, x: Column, b: Table, y: Column) -> float:
        return cosine(self._vector(a, x), self._vector(b, y))


def degree(catalog: Catalog, key: str) -> int:
    return len(catalog.tables[key].foreign_keys) + sum(k.parent == key for t in catalog.tables.values() for k in t.foreign_keys)


def writable(table: Table) -> list[Column]:
    return [c for c in table.columns if not (c.computed or c.rowversion)]


def foreign_key_of(table: Table, column: Column):
    return next((k for k in table.foreign_keys if column.name in k.columns), None)


def structure(t: Table, y: Column, s: Table, x: Column, pairs: dict[str, str]) -> float:
    a, b = foreign_key_of(t, y), foreign_key_of(s, x)
    role = 1.0 if a is None and b is None else 0.0 if a is None or b is None else 1.0 if pairs.get(a.parent) == b.parent else 0.5
    return match.structure_score((y.name in t.primary_key) == (x.name in s.primary_key), role, y.identity == x.identity, x.nullable, y.nullable)


def sampled(profile: dict | None) -> Sampled | None:
    """What a profile tells of a conversion's risks."""
    return Sampled(profile["sampled_rows"], profile.get("min_text"), profile.get("max_text"), profile.get("max_len")) if profile else None


def column_scores(names: "Names", t: Table, y: Column, s: Table, x: Column, pairs: dict[str, str], profiles: dict, target_profiles: dict) -> tuple[float, float, str | None]:
    """(score, likeness of the names, risk) of a pair of columns."""
    name = names.column_similarity(t, y, s, x)
    goal, seen = parse_type(y.data_type), profiles.get((s.key, x.name))
    kind = check_types(parse_type(x.data_type), goal, sampled(seen))
    unique = [y.name] in (t.primary_key, *t.unique)
    length = y.max_length or (goal.length if goal.family == "string" else 0)
    profile = match.profile_score(seen, target_profiles.get((t.key, y.name)), goal.family, length, not y.nullable, unique, names.column_tokens(t, y))
    return match.column_score(name, kind.score, structure(t, y, s, x, pairs), profile), name, kind.risk


def automap(source: Catalog, target: Catalog, synonyms: Synonyms | None = None, candidate: float = match.CANDIDATE, profiles: dict | None = None, target_profiles: dict | None = None) -> dict:
    """A draft: the best source of each target table, columns assigned one to one, and empty sources that nothing uses dropped.

    Target tables whose best score is below ``candidate`` stay unmapped. Every table and column tells its score, the method
    (exact, fuzzy or vector) and the three best candidates. Profiles are by (table, column).
    """
    profiles, target_profiles = profiles or {}, target_profiles or {}
    names = Names(source, target, synonyms)
    scores = {}
    for t in target.tables.values():
        for s in source.tables.values():
            best = [max((names.column_similarity(t, y, s, x) for x in s.columns), default=0.0) for y in writable(t)]
            scores[t.key, s.key] = match.table_score(names.table_similarity(t, s), best, degree(target, t.key), degree(source, s.key))
    ranked = {t: sorted(((scores[t, s], s) for s in source.tables), key=lambda x: (-x[0], x[1])) for t in target.tables}
    pairs = {t: r[0][1] for t, r in ranked.items() if r and r[0][0] >= candidate}
    tables = {}
    for t_key, s_key in pairs.items():
        t, s = target.tables[t_key], source.tables[s_key]
        triples = []
        for y in writable(t):
            for x in s.columns:
                score, name, risk = column_scores(names, t, y, s, x, pairs, profiles, target_profiles)
                if y.identity and x.name not in s.primary_key:
                    continue  # an identity column takes a key or nothing
                triples.append((y.name, x.name, score, name, risk))
        chosen = match.greedy_assignment([p[:4] for p in triples], candidate)
        columns = {}
        for y_name, (x_name, score) in chosen.items():
            _, _, _, name, risk = next(p for p in triples if p[:2] == (y_name, x_name))
            best = sorted((p for p in triples if p[0] == y_name and p[2] >= match.LEAST_SHOWN), key=lambda p: (-p[2], p[1]))[: match.TOP_K]
            columns[y_name] = {"expr": f"s.`{x_name}`", "source_columns": [f"{s_key}.{x_name}"], "confidence": score, "method": match.method_of(name, x_name.lower() == y_name.lower()), "type_risk": risk, "candidates": [(p[1], p[2]) for p in best]}
        name = names.table_similarity(t, s)
        shown = [(s, x) for x, s in ranked[t_key] if x >= match.LEAST_SHOWN][: match.TOP_K]
        tables[t_key] = {"kind": "direct", "sources": [s_key], "confidence": ranked[t_key][0][0], "method": match.method_of(name, t_key.lower() == s_key.lower()), "candidates": shown, "columns": columns}
    used = set(pairs.values())
    drops = {s.key: EMPTY_REASON for s in source.tables.values() if s.rows == 0 and s.key not in used}
    return {"tables": tables, "drops": drops}


def needs_attention(mapping: dict, accept: float = match.AUTO_ACCEPT) -> list[str]:
    """What was found by likeness and scores below the bar of acceptance."""
    out = []
    for t, m in mapping["tables"].items():
        for name, x in [(t, m), *((f"{t}.{c}", x) for c, x in m.get("columns", {}).items())]:
            if x.get("method") in ("fuzzy", "vector") and x.get("confidence", 1.0) < accept:
                out.append(name)
    return out


def search(catalogs: list[Catalog], text: str, k: int = 10, side: str | None = None, kind: str | None = None, synonyms: Synonyms | None = None, classes: dict | None = None) -> list[tuple[float, str, str, str]]:
    """(score, side, kind, key) of the tables and columns most like a text, best first.

    A column's vector takes in half of its table's, the words of its class of values (by (table, column)) and the first
    words of its description.
    """
    synonyms = synonyms or Synonyms()
    rows = []
    for c in catalogs:
        for t in c.tables.values():
            own = name_tokens(t.key.rpartition(".")[2], synonyms)
            rows.append((c.side, "table", t.key, own, None))
            for x in t.columns:
                more = name_tokens((classes or {}).get((t.key, x.name)) or "", synonyms) + name_tokens(x.description or "", synonyms)[:DESCRIBED]
                rows.append((c.side, "column", f"{t.key}.{x.name}", name_tokens(x.name, synonyms, frozenset(own)) + more, own))
    vectors = Vectors([r[3] for r in rows])
    wanted = vectors.of(name_tokens(text, synonyms))
    hits = []
    for s, what, key, tokens, table in rows:
        if side in (None, s) and kind in (None, what):
            score = cosine(wanted, vectors.of(tokens)) + (0.5 * cosine(wanted, vectors.of(table)) if table else 0.0)
            if score > 0:
                hits.append((round(score, 6), s, what, key))
    return sorted(hits, key=lambda h: (-h[0], h[1], h[3]))[: max(1, min(50, k))]
