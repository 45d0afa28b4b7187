"""From raw documents to a training order, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is
written as Parquet and read again as the next stage's documents. All but the
last return the columns of the documents; the last adds ``position`` (0..1, the
time of training) and ``taken_words``.

Nulls in any column, empty and very long texts, ties, repeated rows, empty
tables and extra columns are handled as the operators' docstrings say: a null
text is an empty one and is judged as such; of repeated rows one stays; extra
columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm.common import written
from quillon.llm.decontaminate import drop_leaks
from quillon.llm.exact_dedup import drop_exact_copies
from quillon.llm.mixing import training_order
from quillon.llm.near_dedup import drop_near_copies
from quillon.llm.quality import keep_good


#: Documents whose sets of shingles are so many percent similar are near copies; op2_near_dedup has a stricter bound of its own.
NEAR_PERCENT = 80


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; it learns from ``labels`` outside the held-out fold."""
    return keep_good(docs, _table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the document with the smallest id."""
    return drop_exact_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that near-duplicate links connect, the one with the smallest id."""
    return drop_near_copies(docs, percent=NEAR_PERCENT)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of ``benchmark``, short items and edited or cut passages included."""
    return drop_leaks(docs, _table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their target weights, in training order; a document stands there as often as the mix takes it."""
    return training_order(docs)


STAGES = [
    ("quality classifier", good_documents),
    ("exact dedup", without_copies),
    ("MinHash near-dedup", without_near_copies),
    ("benchmark decontamination", without_leaks),
    ("mixing sources", mixed),
]

#: SQL cannot express the trained classifier and the near-duplicate groups; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
