"""The logical operators: frozen dataclasses, free of Spark."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Union

OPERATORS = ("=", "<>", "<", "<=", ">", ">=")


@dataclass(frozen=True)
class Ref:
    """A column on the right-hand side of a predicate."""

    name: str


Literal = Union[str, int, float]


@dataclass(frozen=True)
class Predicate:
    """``column op value``; ``value`` is a literal or a :class:`Ref`.

    A null on either side makes it unknown, so the row is not kept.
    """

    column: str
    op: str
    value: Union[Literal, Ref]

    def __post_init__(self) -> None:
        if self.op not in OPERATORS:
            raise ValueError(f"unknown comparison {self.op!r}; known: {', '.join(OPERATORS)}")
        if isinstance(self.value, bool) or not isinstance(self.value, (str, int, float, Ref)):
            raise TypeError(f"a predicate compares with text, a number or a column, not {self.value!r}")


@dataclass(frozen=True)
class SortKey:
    """Nulls come first ascending and last descending."""

    column: str
    ascending: bool = True


@dataclass(frozen=True)
class Scan:
    """All rows of a table; its columns are named ``table.column``."""

    table: str


@dataclass(frozen=True)
class Filter:
    """Rows for which every predicate holds; no predicate keeps all."""

    child: "Query"
    predicates: tuple[Predicate, ...] = field(default=())


@dataclass(frozen=True)
class Project:
    """Picks, renames, reorders and repeats columns; ``columns`` holds (from, to). Duplicates among rows stay."""

    child: "Query"
    columns: tuple[tuple[str, str], ...]


@dataclass(frozen=True)
class Cross:
    """The Cartesian product. Under a Filter, Catalyst turns it into the join that the predicates ask for."""

    left: "Query"
    right: "Query"


@dataclass(frozen=True)
class Sort:
    """A total order by the keys in turn. It holds for the result where nothing but Filter and Project stands above."""

    child: "Query"
    keys: tuple[SortKey, ...]


Query = Union[Scan, Filter, Project, Cross, Sort]
