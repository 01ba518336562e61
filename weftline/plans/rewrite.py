"""Rewrites of a schema graph into a smaller one, each a function from Database to Database.

They change which columns stand beside each other, so they are no optimizer
rules; what they produce are plans for the optimizer.
"""

from __future__ import annotations

from itertools import combinations

from weftline.catalog import SEPARATOR, Database, Edge, Rel
from weftline.operators.algebra import empirical_keys, join
from weftline.operators.counts import add_count_features
from weftline.plans.graph import drop_unreachable, longest_path, neighbours


def normalize(db: Database) -> Database:
    """All columns as ``table__column``."""
    full = lambda t, c: c if c.startswith(f"{t}{SEPARATOR}") else f"{t}{SEPARATOR}{c}"
    tables = {n: r.renamed({c: full(n, c) for c in r.df.columns}) for n, r in db.tables.items()}
    return Database(tables, tuple(Edge(e.source, full(e.source, e.source_col), e.target, full(e.target, e.target_col), e.type) for e in db.edges))


def drop_self_references(db: Database) -> Database:
    return Database(db.tables, tuple(e for e in db.edges if e.source != e.target))


def pull(db: Database, many: str, one: str, edge: Edge, drop_key: bool = False) -> Database:
    """``one`` joined into ``many`` along a reference, which goes."""
    e = edge if edge.source == many else edge.inverse
    if e.type.to_many:
        raise ValueError(f"{one} isn't on the one side of {edge}")
    left, right = db.tables[many], db.tables[one]
    df = join(left.df, right.df, [e.source_col], [e.target_col], "left", drop_right=drop_key)
    keys = left.keys
    times = left.times + tuple(t for t in right.times if t not in left.times)
    return db.replace(Rel(many, df, keys, times), edges=tuple(x for x in db.edges if x != edge))


def _renamed_copy(rel: Rel, name: str) -> tuple[Rel, dict[str, str]]:
    new = {c: f"{name}{SEPARATOR}{c.removeprefix(rel.name + SEPARATOR)}" for c in rel.df.columns}
    return rel.renamed(new, name), new


def pull_dimensions(db: Database, task: str) -> Database:
    """Tables on no many side and not beside the task table go into each neighbour, until none is left."""
    while True:
        found = next((n for n in db.tables if n != task and db.of(n) and not db.many_roles(n) and task not in neighbours(db.edges, n)), None)
        if found is None:
            return drop_unreachable(db, task)
        taken: set[str] = set()
        for i, e in enumerate(db.of(found)):
            many = e.source if e.target == found else e.target
            if many in taken:  # a second reference to the same table takes a copy under another name
                copy, new = _renamed_copy(db.tables[found], f"{found}#{i}")
                again = Edge(many, e.source_col if e.source == many else e.target_col, copy.name, new[e.target_col if e.target == found else e.source_col])
                db = db.replace(copy, edges=(*[x for x in db.edges if x != e], again))
                db = pull(db, many, copy.name, again).replace(drop=(copy.name,))
            else:
                db = pull(db, many, found, e)
            taken.add(many)
        db = drop_unreachable(db, task)


def unroll_junction(db: Database, name: str, depth: int = 1) -> Database:
    """A junction of n references as copies, one per reference, with the other neighbours joined in.

    Copy i keeps reference i and takes in the rows the others point to. While
    depth is left the junction stays, linked to every copy by the equal key,
    and is unrolled again; then it goes.
    """
    edges = [e if e.source == name else e.inverse for e in db.of(name)]
    rel = db.tables[name]
    db = db.replace(drop=(name,), edges=tuple(e for e in db.edges if not e.touches(name)))
    if depth == 0:
        return db
    for _ in range(depth):
        links = []
        for i, own in enumerate(edges):
            n = next(k for k in range(1, 10_000) if f"{name}#{k}" not in db.tables)
            copy, new = _renamed_copy(rel, f"{name}#{n}")
            df = copy.df
            times = copy.times
            for j, e in enumerate(edges):
                if j != i:
                    other, cols = _renamed_copy(db.tables[e.target], f"{copy.name}{SEPARATOR}{e.target}")
                    df = join(df, other.df, [new[e.source_col]], [cols[e.target_col]], "left", drop_right=True)
                    times += tuple(t for t in other.times if t in df.columns)
            made = Edge(copy.name, new[own.source_col], own.target, own.target_col, own.type)
            db = db.replace(Rel(copy.name, df, copy.keys, times), edges=(*db.edges, made))
            links.append(Edge(name, own.source_col, copy.name, new[own.source_col], own.type))
        edges = links
    return db


def eliminate_junctions(db: Database, task: str, depth: int = 1) -> Database:
    """Tables on no one side, on several many sides and not beside the task table are unrolled."""
    while True:
        found = next((n for n in list(db.tables) if n != task and "#" not in n and not db.one_roles(n) and db.many_roles(n) > 1 and task not in neighbours(db.edges, n)), None)
        if found is None:
            return db
        db = drop_unreachable(unroll_junction(db, found, depth), task)


def contract_task(db: Database, task: str) -> Database:
    """The entity table joined into the task table, which takes over its other references."""
    own = db.of(task)
    if db.many_roles(task) != 1 or db.one_roles(task) != 0:
        raise ValueError("the task table must refer to exactly one table and be referred to by none")
    edge = own[0] if own[0].source == task else own[0].inverse
    entity = edge.target
    rest = tuple(e for e in db.of(entity) if not e.touches(task))
    db = pull(db, task, entity, own[0])
    moved = tuple(Edge(task if e.source == entity else e.source, e.source_col, task if e.target == entity else e.target, e.target_col, e.type) for e in rest)
    return db.replace(drop=(entity,), edges=tuple(e for e in db.edges if not e.touches(entity)) + moved)


def simplify(db: Database, task: str, counts: str | None = "before", junction_depth: int = 1) -> Database:
    """All rewrites in order: names, counts, self references, dimensions, junctions, the task's own edge, counts."""
    db = normalize(db)
    if counts == "before":
        db = add_count_features(db)
    db = eliminate_junctions(pull_dimensions(drop_self_references(db), task), task, junction_depth)
    db = contract_task(db, task)
    return add_count_features(db) if counts == "after" else db


def join_longest_path(db: Database) -> Rel:
    """Tables along the longest simple path of references, outer-joined from its end."""
    path = longest_path([(e.source, e.target) for e in db.edges if e.source != e.target])
    out = db.tables[path[0]]
    for a, b in zip(path, path[1:]):
        e = next(e for e in db.edges if {e.source, e.target} == {a, b})
        e = e if e.source == a else e.inverse
        df = join(out.df, db.tables[b].df, [e.source_col], [e.target_col], "outer")
        out = Rel(f"{out.name}+{b}", df, out.keys, out.times + db.tables[b].times)
    return out


def _longest_from(arcs: dict[tuple[str, str], tuple[list[str], list[str]]], starts: list[str]) -> list[str]:
    """The simple directed path of most tables; of equals the first in order."""

    def walk(path: list[str]) -> list[str]:
        best = path
        for a, b in arcs:
            if a == path[-1] and b not in path:
                got = walk([*path, b])
                best = got if len(got) > len(best) else best
        return best

    return max((walk([n]) for n in starts), key=len, default=[])


def join_paths(db: Database, arcs: dict[tuple[str, str], tuple[list[str], list[str]]], start: str | None = None, how: str = "outer") -> Database:
    """Tables joined along longest paths of ``arcs``, the first from ``start``, until every table is in one; a table is joined once."""
    left, tables, owner = list(db.tables), {}, {}
    while left:
        path = _longest_from({k: v for k, v in arcs.items() if k[0] in left and k[1] in left}, [start] if start in left else left)
        out = db.tables[path[0]]
        for a, b in zip(path, path[1:]):
            on = arcs[a, b]
            out = Rel(out.name, join(out.df, db.tables[b].df, on[0], on[1], how), out.keys, out.times + db.tables[b].times)
        name = "+".join(path)
        tables[name] = Rel(name, out.df, out.keys, out.times)
        owner |= dict.fromkeys(path, name)
        left = [t for t in left if t not in path]
    return Database(tables, tuple(Edge(owner[e.source], e.source_col, owner[e.target], e.target_col, e.type) for e in db.edges))


def key_matches(db: Database) -> dict[tuple[str, str], tuple[list[str], list[str]]]:
    """Pairs of tables that can be joined on what they refer to in common.

    A set of a table's references is a key if no two rows agree in it. Two
    tables match if what a key of one refers to is part of what a key of the
    other does; of several keys the first, smaller ones first.
    """
    keys: dict[str, list[dict[str, str]]] = {}
    for name, rel in db.tables.items():
        refs = [(e.source_col, e.target_col) for e in db.edges if e.source == name]
        sets = [list(c) for n in range(1, len(refs) + 1) for c in combinations(refs, n)]
        keys[name] = []
        if sets:
            found = {r.cols: r.is_key for r in empirical_keys(rel.df, [[c for c, _ in s] for s in sets]).collect()}  # a row a set
            keys[name] = [{target: col for col, target in s} for s in sets if found[",".join(c for c, _ in s)]]
    out = {}
    for a in keys:
        for b in keys:
            match = next(((x, y) for x in keys[a] for y in keys[b] if x.keys() <= y.keys()), None) if a != b else None
            if match:
                out[a, b] = (list(match[0].values()), [match[1][t] for t in match[0]])
    return out


def simplify_by_paths(db: Database, task: str) -> Database:
    """The older way to shrink a schema: joins along references from the task table, then along matching keys, then no self references.

    The task table is the one whose name, a list of joined tables, holds it.
    """
    db = normalize(db)
    arcs = {(e.source, e.target): ([e.source_col], [e.target_col]) for e in db.edges if e.source != e.target}
    db = join_paths(db, arcs, task)
    return drop_self_references(join_paths(db, key_matches(db)))


def plan_graph(rel: Rel) -> tuple[list[tuple[int, str, int]], list[tuple[int, int, str]]]:
    """A relation's plan as nodes (id, operation, columns) and edges (input, operation, side); the root has id 0."""
    nodes: list[tuple[int, str, int]] = []
    edges: list[tuple[int, int, str]] = []

    def visit(plan) -> int:
        own = len(nodes)
        nodes.append((own, plan.nodeName(), plan.output().size()))
        inputs = plan.children()
        for i in range(inputs.size()):
            side = "" if inputs.size() == 1 else ("left", "right")[i] if inputs.size() == 2 else str(i + 1)
            edges.append((visit(inputs.apply(i)), own, side))
        return own

    visit(rel.df._jdf.queryExecution().analyzed())
    return nodes, edges


def plan_dot(rel: Rel) -> str:
    """``plan_graph`` as text for graph tools."""
    nodes, edges = plan_graph(rel)
    lines = [f'  n{i} [label="{name} ({columns})"];' for i, name, columns in nodes]
    lines += [f'  n{a} -> n{b} [label="{side}"];' for a, b, side in edges]
    return "\n".join([f'digraph "{rel.name}" {{', *lines, "}"])
