"""Schema graphs: layers, reachability, the direction of inference. Driver-side; sizes are numbers of tables."""

from __future__ import annotations

from weftline.catalog import Database, Edge


def neighbours(edges: tuple[Edge, ...], name: str) -> list[str]:
    return [e.target if e.source == name else e.source for e in edges if e.touches(name)]


def layers(db: Database, start: str) -> list[list[str]]:
    """Tables by distance from ``start``, references taken either way."""
    out, seen = [[start]], {start}
    while True:
        new = list(dict.fromkeys(n for t in out[-1] for n in neighbours(db.edges, t) if n not in seen))
        if not new:
            return out
        seen.update(new)
        out.append(new)


def distances(db: Database, start: str) -> dict[str, int]:
    """Tables within reach of ``start`` by their distance."""
    return {t: i for i, layer in enumerate(layers(db, start)) for t in layer}


def drop_unreachable(db: Database, start: str) -> Database:
    held = {t for layer in layers(db, start) for t in layer}
    return Database({n: r for n, r in db.tables.items() if n in held}, tuple(e for e in db.edges if e.source in held))


def inference_dag(db: Database, start: str, shortest: bool = False) -> list[Edge]:
    """Edges away from ``start``: a reference points outward; within a layer it keeps its own direction, or is left out if ``shortest``.

    A cycle, which references within a layer can make, falls back on ``shortest``.
    """
    at = distances(db, start)
    out = []
    for e in db.edges:
        if e.source not in at or e.source == e.target:
            continue
        a, b = at[e.source], at[e.target]
        if a != b or not shortest:
            out.append(e if a <= b else e.inverse)
    if topological(list(at), out) is None:
        return inference_dag(db, start, True)
    return sorted(out, key=lambda e: (at[e.source], at[e.target], e.source, e.target, e.source_col))


def topological(tables: list[str], edges: list[Edge]) -> list[str] | None:
    """Tables with every edge pointing forward; None if there is a cycle."""
    left, out = dict.fromkeys(tables), []
    while left:
        free = [t for t in left if not any(e.target == t and e.source in left for e in edges)]
        if not free:
            return None
        out += free
        for t in free:
            del left[t]
    return out


def longest_path(edges: list[tuple[str, str]]) -> list[str]:
    """A simple path of most nodes in a small undirected graph; of equals the first in order."""
    near: dict[str, set[str]] = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)

    def walk(path: list[str]) -> list[str]:
        best = path
        for n in sorted(near[path[-1]] - set(path)):
            got = walk([*path, n])
            if len(got) > len(best):
                best = got
        return best

    return max((walk([n]) for n in sorted(near)), key=len, default=[])
