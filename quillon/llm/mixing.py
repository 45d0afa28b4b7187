"""Mixing sources to target weights by a time-varying curriculum.

Each source's weight schedule is integrated over the training time 0..1; its
documents, in hash order, meet the source's cumulative token demand, and the
inverse of that demand gives the time at which each document is due.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.llm.common import WORD, Bitmap, fresh, named, row_hash, written

#: (time, weight) knots, straight between them. The mean weight over 0..1 is the source's weight.
Schedule = Sequence[tuple[float, float]]

#: For sources by code point, null last, in turn: mean weights 5, 2 and 1. The first ends weaker than it begins.
SCHEDULES: tuple[Schedule, ...] = (((0.0, 6.0), (1.0, 4.0)), ((0.0, 2.0), (1.0, 2.0)), ((0.0, 0.0), (1.0, 2.0)))

#: Each source's documents are dealt to so many hash buckets for the running sums.
BUCKETS_HEX = 3


def integral(schedule: Schedule) -> float:
    """The schedule's integral over 0..1."""
    _checked(schedule)
    return sum((b - a) * (u + v) / 2 for (a, u), (b, v) in zip(schedule, schedule[1:]))


def _checked(schedule: Schedule) -> None:
    times = [t for t, _ in schedule]
    if times[:1] != [0.0] or times[-1:] != [1.0] or sorted(set(times)) != times or min(w for _, w in schedule) < 0:
        raise ValueError(f"a schedule runs from time 0 to 1 in rising steps and has no negative weight: {schedule}")


def inverse(schedule: Schedule, done: Column) -> Column:
    """The time at which the integral reaches the part ``done`` (0..1) of its whole."""
    y = done * F.lit(integral(schedule))
    out, before = None, 0.0
    for (a, u), (b, v) in zip(schedule, schedule[1:]):
        z = F.greatest(y - F.lit(before), F.lit(0.0))
        root = F.sqrt(F.greatest(F.lit(u * u) + F.lit(2.0 * (v - u) / (b - a)) * z, F.lit(0.0))) + F.lit(u)
        t = F.lit(a) + F.when(root > 0, F.lit(2.0) * z / root).otherwise(F.lit(0.0))
        t = F.least(t, F.lit(b))
        out = t if out is None else F.when(y > F.lit(before), t).otherwise(out)
        before += (b - a) * (u + v) / 2
    return out


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, schedules: Sequence[Schedule] = SCHEDULES, budget: float = 1.5, epochs: int = 2) -> DataFrame:
    """``source, source_size`` to the same with ``turn`` (its schedule) and ``target``.

    The budget times all words is shared by weight; no target passes ``epochs``
    times its source, and the excess is shared again by weight until none does.
    Sources in rising order of cap over weight: the first ones are capped, and
    the level of the others follows from running sums, without iteration. Its
    input is a row per source, so the windows over all of it are small.
    """
    turn = F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(schedules)))
    weight = F.element_at(F.array(*(F.lit(float(integral(s))) for s in schedules)), F.col("turn") + 1)
    rows = sizes.withColumn("turn", turn).withColumn("weight", weight).withColumn("cap", (F.col("source_size") * epochs).cast("double"))
    every = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    rows = (
        rows.withColumn("wanted", F.least(F.sum("source_size").over(every) * F.lit(float(budget)), F.sum("cap").over(every)))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("wanted") - F.col("cap_before")) / F.col("weight_left"))
        .withColumn("capped", F.col("level") * F.col("weight") >= F.col("cap"))
        # the level of the first source that is not capped holds for all after it
        .withColumn("level", F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), "source_size", "level"))).over(every)["level"])
    )
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level") * F.col("weight")))
    return rows.select("source", "source_size", "turn", target.alias("target"))


def mix_sources(
    docs: DataFrame,
    schedules: Sequence[Schedule] = SCHEDULES,
    budget: float = 1.5,
    epochs: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per input row: ``doc_id, row_key, source, size, source_size, target, taken, plays``.

    ``plays`` has for each time the document is taken its position (0..1, the
    order of training) and the words taken then. A source's documents stand in
    the order of a hash; the mix takes the first ``target`` words of that order,
    again from the start after the last, so all sources meet their targets to a
    word: the document on which a target ends is taken in part.

    Sources may be of any size: running sums go over hash buckets of a source,
    then over the buckets' sums. ``row_key`` is a hash of the row's id and text.

    Null text has no words; such documents are taken 0 words, at no time. Null
    source is a source, the last. Null ids stand in the order of their text's
    hash. Repeated rows each count. An empty table gives an empty result.
    Further columns are ignored.
    """
    order = F.md5(F.coalesce(named(id_col).cast("string"), named(text_col), F.lit("")))
    light = written(
        docs.select(
            named(id_col).alias("doc_id"),
            named(source_col).alias("source"),
            word_count(named(text_col)).alias("size"),
            order.alias("place"),
            F.xxhash64(named(id_col), named(text_col)).alias("row_key"),
        )
    ).withColumn("bucket", F.substring("place", 1, BUCKETS_HEX))
    sums = light.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"))
    totals = sums.groupBy("source").agg(F.sum("in_bucket").alias("source_size"))
    targets = source_targets(totals, schedules, budget, epochs).withColumnRenamed("source", "t_source")
    before = F.sum("in_bucket").over(Window.partitionBy("source").orderBy("bucket")) - F.col("in_bucket")
    starts = (
        sums.withColumn("before", before)
        .join(targets, F.col("source").eqNullSafe(F.col("t_source")))
        .select(F.col("source").alias("b_source"), F.col("bucket").alias("b_bucket"), "before", "source_size", "target", "turn")
    )
    within = Window.partitionBy("source", "bucket").orderBy("place", "doc_id", "size", "row_key").rowsBetween(Window.unboundedPreceding, 0)
    rows = (
        light.withColumn("upto", F.sum("size").over(within))
        .join(starts, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("bucket") == F.col("b_bucket")))
        .withColumn("start", F.col("before") + F.col("upto") - F.col("size"))
    )
    plays = []
    for e in range(epochs):
        start = F.col("start") + F.lit(e) * F.col("source_size")
        words = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.floor("target") - start))
        done = start / F.col("target")
        at = F.element_at(F.array(*(inverse(s, done) for s in schedules)), F.col("turn") + 1)
        plays.append(F.when(words > 0, F.struct(at.alias("position"), words.alias("words"))))
    rows = rows.withColumn("plays", F.array_compact(F.array(*plays)))
    taken = F.aggregate("plays", F.lit(0).cast("long"), lambda a, p: a + p["words"])
    return rows.select("doc_id", "row_key", "source", "size", "source_size", "target", taken.alias("taken"), "plays")


def training_order(docs: DataFrame, **how) -> DataFrame:
    """The documents with all their columns, once per play, range-sorted by ``position``.

    ``position`` and ``taken_words`` follow the columns of ``docs`` (with
    underscores behind them where those names are taken). Repeated rows share
    their plays: each of n rows with one id and text is at the positions of one
    of the n.
    """
    id_col, text_col = how.get("id_col", "doc_id"), how.get("text_col", "text")
    key, copy, at = (fresh(n, docs.columns) for n in ("m_key", "m_copy", "m_plays"))
    own_key, own_copy = fresh("own_key", docs.columns), fresh("own_copy", docs.columns)
    position, words = fresh("position", docs.columns), fresh("taken_words", docs.columns)
    mixed = written(mix_sources(docs, **how).select("row_key", "doc_id", "plays"))
    repeated = Bitmap(written(mixed.groupBy("row_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("row_key")))
    own = F.xxhash64(named(id_col), named(text_col))
    plays = lambda found: repeated.split(mixed, F.col("row_key"), found)
    # a row of its own is joined by its key alone; only what may be repeated is numbered on both sides
    single = plays(False).where(F.size("plays") > 0).select(F.col("row_key").alias(key), F.col("plays").alias(at))
    rows = repeated.split(docs, own, False).withColumn(own_key, own).join(single, F.col(own_key) == F.col(key)).select(*map(named, docs.columns), at)
    numbered = F.row_number().over(Window.partitionBy("row_key").orderBy("doc_id", "plays"))
    several = plays(True).select("row_key", numbered.alias("copy"), "plays").where(F.size("plays") > 0).toDF(key, copy, at)
    again = repeated.split(docs, own, True).withColumn(own_key, own)
    again = again.withColumn(own_copy, F.row_number().over(Window.partitionBy(own_key).orderBy(named(id_col), row_hash(docs, text_col))))
    again = again.join(several, (F.col(own_key) == F.col(key)) & (F.col(own_copy) == F.col(copy))).select(*map(named, docs.columns), at)
    out = rows.unionByName(again).select(*map(named, docs.columns), F.explode(at).alias(at))
    out = out.select(*map(named, docs.columns), F.col(at)["position"].alias(position), F.col(at)["words"].alias(words))
    return out.orderBy(named(position), named(id_col))
