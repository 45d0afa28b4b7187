"""Exact dedup: group by 128-bit content hash, keep the smallest stable id, compare bytes inside groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import SPACE, Bitmap, matching_rows, named, written


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def content_hash(body: Column) -> Column:
    return F.unhex(F.md5(body))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256, copies`` (rows of this id and text).

    Texts are equal when identical after each run of white space became one
    space. Hashes of some 60 bytes a document are grouped first. Only texts
    whose ``digest`` occurs twice are shuffled, grouped by it and by the bytes
    themselves, so colliding texts part; copies merge before that shuffle, which
    carries each text once per map task at most however large its group is.
    Every document then looks its group up by digests alone, in a join whose hot
    keys Spark may split.

    Null text counts as empty. A null id is larger than any other; a group with
    null ids only keeps one of them. Repeated rows (same id and text) are
    members like others and exactly one of them is kept. An empty table gives
    an empty result; further columns are ignored.
    """
    rows = docs.select(named(id_col).alias("id"), normalised(named(text_col)).alias("body"))
    rows = rows.select("id", "body", digest(F.col("body")).alias("key"))
    sha = F.unhex(F.sha2(F.col("body"), 256)).alias("sha")
    light = written(rows.select("id", "key", sha))
    repeated = written(light.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.xxhash64("key")))
    groups = (
        Bitmap(repeated)
        .split(rows, F.xxhash64("key"), True)
        .groupBy("key", "body")
        .agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
        .select(F.col("key").alias("g_key"), sha.alias("g_sha"), "keep_id", "group_size")
    )
    members = light.groupBy("id", "key", "sha").agg(F.count(F.lit(1)).alias("copies"))
    found = members.join(written(groups), (F.col("key") == F.col("g_key")) & (F.col("sha") == F.col("g_sha")), "left")
    alone = F.col("group_size").isNull()
    return found.select(
        F.col("id").alias("doc_id"),
        F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"),
        "copies",
    ).select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256", "copies")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that :func:`exact_dedup` keeps, with all their columns.

    Documents whose hash occurs once are never shuffled. Of repeated rows the
    one with the smallest hash over all its columns stays, so reruns agree. Null
    text counts as empty, null ids are larger than any other, and an empty table
    gives an empty result.
    """
    hashed = F.xxhash64(content_hash(normalised(named(text_col))))
    repeated = written(docs.select(hashed.alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"))
    known = Bitmap(repeated)
    doubtful = written(known.split(docs, hashed, True))
    kept = exact_dedup(doubtful, id_col, text_col).where("kept")
    own = F.xxhash64(named(id_col), F.sha2(normalised(named(text_col)), 256))
    settled = matching_rows(doubtful, id_col, text_col, own, kept.select("doc_id", F.xxhash64("doc_id", "text_sha256"), "copies"))
    return known.split(docs, hashed, False).unionByName(settled)
