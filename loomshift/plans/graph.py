"""Foreign-key graphs: cycles, and a load order that cuts as few edges as it must."""

from __future__ import annotations

from collections.abc import Iterable


def components(nodes: Iterable[str], edges: Iterable[tuple[str, str]]) -> list[list[str]]:
    """Strongly connected components, members and components in order; without recursion."""
    out: dict[str, list[str]] = {n: [] for n in nodes}
    into: dict[str, list[str]] = {n: [] for n in out}
    for a, b in edges:
        if a in out and b in out:
            out[a].append(b)
            into[b].append(a)
    seen: set[str] = set()
    finished: list[str] = []
    for root in sorted(out):
        stack = [(root, iter(sorted(out[root])))] if root not in seen else []
        seen.add(root)
        while stack:
            node, rest = stack[-1]
            following = next((n for n in rest if n not in seen), None)
            if following is None:
                finished.append(node)
                stack.pop()
            else:
                seen.add(following)
                stack.append((following, iter(sorted(out[following]))))
    found: list[list[str]] = []
    placed: set[str] = set()
    for root in reversed(finished):
        if root in placed:
            continue
        group, todo = [], [root]
        placed.add(root)
        while todo:
            node = todo.pop()
            group.append(node)
            for n in into[node]:
                if n not in placed:
                    placed.add(n)
                    todo.append(n)
        found.append(sorted(group))
    return sorted(found)


def cycles(nodes: Iterable[str], edges: Iterable[tuple[str, str]]) -> list[list[str]]:
    return [c for c in components(nodes, edges) if len(c) > 1]


def load_order(nodes: Iterable[str], edges: Iterable[tuple[str, str]], preferred: Iterable[tuple[str, str]] = ()) -> tuple[list[str], list[tuple[str, str]]]:
    """(order, cut edges) for edges child -> parent: parents first, level by level, names in order within a level.

    Self-references are cut. While a cycle is left, each loses one edge a round: the first of the preferred ones (those
    whose columns may all be null), or else the first of all.
    """
    names, wanted = sorted(set(nodes)), set(preferred)
    live = {e for e in edges if e[0] in names and e[1] in names}
    cut = sorted(e for e in live if e[0] == e[1])
    live -= set(cut)
    while loops := cycles(names, live):
        for loop in loops:
            inside = sorted(e for e in live if e[0] in loop and e[1] in loop)
            gone = next((e for e in inside if e in wanted), inside[0])
            live.discard(gone)
            cut.append(gone)
    order: list[str] = []
    while len(order) < len(names):
        done = set(order)
        order += [n for n in names if n not in done and all(p in done for c, p in live if c == n)]
    return order, cut
