"""Connected components by contraction within tasks, and large-star and small-star rounds between them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import written


def _mark(edges: DataFrame) -> tuple:
    """Two numbers that change when the set of edges does."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


#: About so many edges are contracted by one task.
TASK_EDGES = 200_000
#: A node with so many edges is hot: its edges are not gathered in one task.
HOT_EDGES = 1000


def _contract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a task to as few that connect the same: each node of them with the smallest that it reaches."""
    parent: dict = {}

    def top(x):
        while (p := parent[x]) != x:
            parent[x] = x = parent[p]
        return x

    schema = None
    for batch in batches:
        schema = batch.schema
        for a, b in zip(*(c.to_pylist() for c in batch.columns)):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            a, b = top(a), top(b)
            if a < b:
                parent[b] = a
            elif b < a:
                parent[a] = b
    if schema is not None:
        pairs = [(x, t) for x in parent if (t := top(x)) != x]
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], schema.field(k).type) for k in (0, 1)], schema=schema)


def _nearest(edges: DataFrame, most: int) -> DataFrame:
    """``u, v, m``: each of up to ``most`` edges with the smallest neighbour of its ``u``.

    Of hot nodes there is at most one per HOT_EDGES edges; they are written, so
    that Spark broadcasts them where they are few and splits their partitions
    where they are not.
    """
    if most < HOT_EDGES:  # none can be hot
        return edges.join(edges.groupBy("u").agg(F.min("v").alias("m")), "u")
    low = written(edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")))
    hot = written(low.where(F.col("n") >= HOT_EDGES).select("u", "m"))
    cold = edges.join(hot.select("u"), "u", "left_anti").join(low.where(F.col("n") < HOT_EDGES).select("u", "m"), "u")
    return edges.join(hot, "u").unionByName(cold)


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node, component`` for every node of an edge; the component is its smallest node.

    Tasks contract about TASK_EDGES edges each. What one task has contracted is
    done; what several have goes through rounds, each of which hangs every
    node's neighbours on the smallest one around it, larger neighbours first and
    then the others, and contracts again. Rounds needed grow as the logarithm of
    the nodes. Every round is written to the shared folder; only two numbers
    come to the driver.
    """
    u, v, m = F.col("u"), F.col("v"), F.col("m")
    now = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(u != v))
    many = now.count()
    mark = None
    while many:
        tasks = -(-many // TASK_EDGES)
        now = now.coalesce(tasks).mapInArrow(_contract, now.schema)
        if tasks == 1:
            now = written(now)
            break
        now = written(now.distinct())
        both = _nearest(now.unionByName(now.select(v.alias("u"), u.alias("v"))), 2 * many)
        large = written(both.where(v > u).select(v.alias("u"), F.least("u", "m").alias("v")).distinct())
        small = _nearest(large, 2 * many)
        now = written(small.where(v != m).select(v.alias("u"), m.alias("v")).unionByName(small.select("u", m.alias("v"))).distinct())
        before, mark = mark, _mark(now)
        many = mark[0]
        if before == mark:
            break
    return now.select(u.alias("node"), v.alias("component")).unionByName(now.select(v.alias("node"), v.alias("component")).distinct())
