"""What the operators share: words, names that clash with nothing, and written intermediate tables."""

from __future__ import annotations

import atexit
import functools
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed by the contracts: white space, and a word.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def named(name: str) -> Column:
    """A column by its exact name, dots and back-ticks included."""
    return F.col(f"`{name.replace('`', '``')}`")


def fresh(base: str, taken: Iterable[str]) -> str:
    """``base``, or with underscores behind it, so that no taken name equals it (Spark ignores case)."""
    low = {t.lower() for t in taken}
    while base.lower() in low:
        base += "_"
    return base


def shared_folder(spark: SparkSession) -> str:
    """A new folder where the driver and all executors can write and read.

    It lies in ``spark.checkpoint.dir``. Where that is unset and Spark runs in
    this one process, as in tests, it lies in a temporary folder that goes with
    the process; on a cluster it is an error.
    """
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*)?", conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _temporary_folder()
    _made.append(f"{root.rstrip('/')}/quillon/{uuid.uuid4().hex}")
    return _made[-1]


#: Folders that this process has made, and tables over some of them.
_made: list[str] = []
_tables: list[str] = []


def clear(spark: SparkSession) -> None:
    """Deletes all that the operators have written for this process; for the end of a job, as results that are still to be read may need it."""
    while _tables:
        spark.sql(f"DROP TABLE IF EXISTS {_tables.pop()}")
    while _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@functools.cache
def _temporary_folder() -> str:
    path = tempfile.mkdtemp(prefix="quillon-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def written(df: DataFrame) -> DataFrame:
    """The rows by way of a Parquet table in the shared folder: made once, and safe when executors go."""
    path = f"{shared_folder(df.sparkSession)}/table"
    plain = df.toDF(*(f"c{k}" for k in range(len(df.columns))))  # files cannot hold any name
    plain.write.parquet(path)
    return df.sparkSession.read.schema(plain.schema).parquet(path).toDF(*df.columns)


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """The rows as :func:`written`, in as many buckets by ``key`` as there are shuffle partitions, so that joins by it leave them where they are."""
    spark = df.sparkSession
    _tables.append(f"quillon_{uuid.uuid4().hex}")
    writer = df.write.format("parquet").option("path", f"{shared_folder(spark)}/table")
    writer.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).saveAsTable(_tables[-1])
    return spark.table(_tables[-1])


def row_hash(docs: DataFrame, *without: str) -> Column:
    """A hash of a row, for an order among rows that are alike otherwise; maps, which Spark does not hash, are left out."""
    return F.xxhash64(*(named(f.name) for f in docs.schema.fields if "map" not in f.dataType.simpleString() and f.name not in without))


#: A bitmap has at most so many words of 64 bits; broadcast, a word takes some 60 bytes.
BITMAP_WORDS = 1 << 20


class Bitmap:
    """A set of long keys as a table (word, bits) of bounded size, which may be broadcast whatever the number of keys.

    A key of the set is always found. Others are found now and then: one in 64
    while there are fewer keys than BITMAP_WORDS, more often beyond, so what is
    found has to be settled by a join, and what is not found needs none.
    """

    def __init__(self, keys: DataFrame):
        keys = keys.toDF("key")
        self._words = min(BITMAP_WORDS, 1 << max(0, keys.count() - 1).bit_length())
        self._table = written(keys.groupBy(self._word(F.col("key")).alias("word")).agg(F.bit_or(self._bit(F.col("key"))).alias("bits")))

    def _word(self, key: Column) -> Column:
        return F.pmod(key, F.lit(self._words))

    @staticmethod
    def _bit(key: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(key, 58).cast("int"))

    def split(self, rows: DataFrame, key: Column, found: bool) -> DataFrame:
        """The rows whose key is found, or those whose key is not. A null key is never found."""
        own, word, bits = (fresh(n, rows.columns) for n in ("key", "word", "bits"))
        marked = rows.withColumn(own, key).withColumn(word, self._word(F.col(own)))
        marked = marked.join(F.broadcast(self._table.toDF(word, bits)), word, "inner" if found else "left")
        hit = F.col(bits).bitwiseAND(self._bit(F.col(own))) != 0
        return marked.where(hit if found else ~F.coalesce(hit, F.lit(False))).select(*map(named, rows.columns))


def matching_rows(docs: DataFrame, id_col: str, text_col: str, own: Column, keys: DataFrame) -> DataFrame:
    """The rows, with all their columns, whose id and key ``own`` stand in ``keys`` (id, key, copies).

    Where ``copies`` is over 1, so many rows agree in both and one of them
    stays, by an aggregation that merges them before the shuffle; 0 keeps all.
    """
    mine, its, key, copies, one = (fresh(n, docs.columns) for n in ("mine", "its", "key", "copies", "one"))
    found = docs.withColumn(mine, own).join(keys.toDF(its, key, copies), (F.col(mine) == F.col(key)) & named(id_col).eqNullSafe(F.col(its)))
    several = found.where(F.col(copies) > 1).groupBy(key, its).agg(F.min_by(F.struct(*map(named, docs.columns)), row_hash(docs, text_col)).alias(one))
    columns = [F.col(one).getField(c).alias(c) for c in docs.columns]
    return found.where(F.col(copies) <= 1).select(*map(named, docs.columns)).unionByName(several.select(*columns))
