"""Typed comparisons, checked when the plan is built; and a loose one, by what values look like."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions.render import render_double

_COMPARE = {
    "=": lambda a, b: a == b,
    "<>": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}
_TIME = (T.DateType, T.TimestampType, T.TimestampNTZType)


def family(kind: T.DataType) -> str:
    if isinstance(kind, T.NumericType):
        return "number"
    return "time" if isinstance(kind, _TIME) else kind.typeName()


def comparison(op: str, left: Column, kind: T.DataType, right: Column, other: T.DataType) -> Column:
    """Two columns. Numbers compare by Spark's promotion, times among times, anything else within its own type."""
    if family(kind) != family(other):
        raise TypeError(f"cannot compare {kind.simpleString()} with {other.simpleString()}")
    return _COMPARE[op](left, right)


def comparison_with_literal(op: str, left: Column, kind: T.DataType, value: str | int | float) -> Column:
    """A column and a literal, which takes the column's type, so that the filter can be pushed to the scan.

    A fraction against an integer column stays a double, and an integer beyond
    the column's range a wider one: no rounding changes the outcome. Text
    against a time is parsed now; a bad time fails here, not in a task.
    """
    text = isinstance(value, str)
    if family(kind) == "number" and not text:
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            return _COMPARE[op](left, F.lit(float(value)).cast(kind))
        return _COMPARE[op](left, F.lit(value))
    if family(kind) == "string" and text:
        return _COMPARE[op](left, F.lit(value))
    if family(kind) == "time" and text:
        from datetime import datetime

        datetime.fromisoformat(value)
        return _COMPARE[op](left, F.lit(value).cast(kind))
    raise TypeError(f"cannot compare {kind.simpleString()} with {value!r}")


def as_text(column: Column, kind: T.DataType) -> Column:
    """A value as the text protocol shows it."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return render_double(column.cast("double"))
    return column.cast("string")


def loose_comparison(op: str, left: Column, right: Column) -> Column:
    """Two texts: as numbers where both read as numbers, else as texts. Nothing of it can be pushed to a scan or become a join key."""
    a, b = left.try_cast("double"), right.try_cast("double")
    return F.when(a.isNotNull() & b.isNotNull(), _COMPARE[op](a, b)).otherwise(_COMPARE[op](left, right))
