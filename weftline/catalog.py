"""Metadata of a linked set of tables: relations, references, and a task over them.

Data never lives here. A relation holds a DataFrame, that is, a plan; a schema
change is another plan over the same files.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from enum import Enum

from pyspark.sql import DataFrame

SEPARATOR = "__"


class RefType(Enum):
    MANY_TO_ONE = "many_to_one"
    ONE_TO_MANY = "one_to_many"
    MANY_TO_MANY = "many_to_many"

    @property
    def inverse(self) -> RefType:
        return {"many_to_one": RefType.ONE_TO_MANY, "one_to_many": RefType.MANY_TO_ONE}.get(self.value, self)

    @property
    def from_many(self) -> bool:
        return self is not RefType.ONE_TO_MANY

    @property
    def to_many(self) -> bool:
        return self is not RefType.MANY_TO_ONE


@dataclass(frozen=True)
class Edge:
    """A reference of one column of ``source`` to one column of ``target``."""

    source: str
    source_col: str
    target: str
    target_col: str
    type: RefType = RefType.MANY_TO_ONE

    @property
    def inverse(self) -> Edge:
        return Edge(self.target, self.target_col, self.source, self.source_col, self.type.inverse)

    def touches(self, name: str) -> bool:
        return name in (self.source, self.target)


@dataclass(frozen=True)
class Rel:
    """A named plan with its key and time columns."""

    name: str
    df: DataFrame
    keys: tuple[str, ...] = ()
    times: tuple[str, ...] = ()

    def with_df(self, df: DataFrame) -> Rel:
        return replace(self, df=df)

    def renamed(self, columns: dict[str, str], name: str | None = None) -> Rel:
        """Columns, and with them tracked keys and times, under new names."""
        new = lambda cs: tuple(columns.get(c, c) for c in cs)
        return Rel(name or self.name, self.df.withColumnsRenamed(columns), new(self.keys), new(self.times))


@dataclass(frozen=True)
class Database:
    """Relations by name and the references between them."""

    tables: dict[str, Rel]
    edges: tuple[Edge, ...] = ()

    def __post_init__(self) -> None:
        for e in self.edges:
            for name, col in ((e.source, e.source_col), (e.target, e.target_col)):
                if name not in self.tables or col not in self.tables[name].df.columns:
                    raise ValueError(f"reference to a missing column: {name}.{col}")

    def replace(self, *rels: Rel, drop: tuple[str, ...] = (), edges: tuple[Edge, ...] | None = None) -> Database:
        tables = {n: r for n, r in self.tables.items() if n not in drop} | {r.name: r for r in rels}
        return Database(tables, self.edges if edges is None else edges)

    def of(self, name: str) -> tuple[Edge, ...]:
        return tuple(e for e in self.edges if e.touches(name))

    def one_roles(self, name: str) -> int:
        """How often the relation is on the one side of a reference."""
        return sum((e.target == name and not e.type.to_many) + (e.source == name and not e.type.from_many) for e in self.edges)

    def many_roles(self, name: str) -> int:
        """How often the relation is on the many side of a reference."""
        return sum((e.target == name and e.type.to_many) + (e.source == name and e.type.from_many) for e in self.edges)


@dataclass(frozen=True)
class Task:
    """A database with the roles of its task relation's columns; the split is a column."""

    db: Database
    table: str
    entity_col: str
    time_col: str
    target_col: str
    kind: str = "binary"
    id_col: str = "__task_id"
    split_col: str = "split"
