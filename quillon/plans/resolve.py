"""Name lookup over columns that carry unique internal ids."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ResolutionError(ValueError):
    """A name that no column, or more than one, answers to."""


@dataclass(frozen=True)
class Field:
    """``name`` as the query sees it; ``id`` as the DataFrame has it."""

    name: str
    id: str
    kind: T.DataType

    @property
    def column(self) -> Column:
        return F.col(self.id)


def _parts(name: str) -> tuple[str, str]:
    head, _, tail = name.rpartition(".")
    return head, tail


def resolve(name: str, fields: list[Field]) -> Field:
    """The exact name, else the one whose last part agrees and whose qualifier does not contradict."""
    found = [f for f in fields if f.name == name]
    if not found:
        head, tail = _parts(name)
        found = [f for f in fields if _parts(f.name)[1] == tail and ("" in (head, _parts(f.name)[0]))]
    if len({f.id for f in found}) == 1:
        return found[0]
    have = ", ".join(f.name for f in fields)
    raise ResolutionError(f"{'ambiguous' if found else 'unknown'} column {name!r} among: {have}")
