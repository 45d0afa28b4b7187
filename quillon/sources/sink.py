"""The text protocol of results."""

from __future__ import annotations

from typing import TextIO

from pyspark.sql import DataFrame

from quillon.functions.render import render_rows


def write_rows(df: DataFrame, out: TextIO) -> int:
    """``validate``, a ``v1|v2|`` line for each row in order, ``!``; returns the number of rows.

    Rows are rendered on the executors and come partition by partition, so the
    driver holds one partition at a time.
    """
    n = 0
    out.write("validate\n")
    for row in render_rows(df).toLocalIterator(prefetchPartitions=True):
        out.write(row[0] + "\n")
        n += 1
    out.write("!\n")
    return n
