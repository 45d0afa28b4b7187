"""Benchmark decontamination by spaced-seed hashing.

Fixed masks pick six of eight or twelve neighbouring tokens and ignore the
others; a benchmark item and a document that agree under a mask are compared
along that diagonal, token by token. Items too short for the masks are cut into
one piece more than tokens may differ, one of which is equal in every leak.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import Bitmap, fresh, named, written

#: A leak: of so many tokens in a row so many are equal. MASKS miss none: whichever 3 of 16 differ, one mask fits somewhere.
WINDOW, EQUAL = 16, 13
#: Offsets of the tokens that a mask compares. Found by search; tests go through all 560 cases.
MASKS = ((0, 1, 2, 4, 6, 7), (0, 2, 3, 9, 10, 11))
#: Up to so many seeds (some 100 bytes each in memory) are broadcast with their items; more are joined by shuffle.
BROADCAST_SEEDS = 500_000


def tokens(text: Column) -> Column:
    """Runs of letters and digits in lower case; null has none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _seeds(words: str, at: str) -> Column:
    """The hash under each mask at a position, null where the mask passes the end."""
    seed = lambda k, m: F.when(F.col(at) + m[-1] < F.size(words), F.xxhash64(F.lit(k), *(F.get(F.col(words), F.col(at) + o) for o in m)))
    return F.array(*(seed(k, m) for k, m in enumerate(MASKS)))


def _differing(size: Column) -> Column:
    """So many tokens of a window of an item may differ: as many in proportion as of WINDOW."""
    return F.floor(F.least(size, F.lit(WINDOW)) * (WINDOW - EQUAL) / WINDOW).cast("int")


def _gram(words: Column, at: Column, n: int) -> Column:
    """The hash of ``n`` tokens in a row; those of other lengths and masks are others."""
    return F.xxhash64(F.lit(-n), *(F.get(words, at + k) for k in range(n)))


def _pieces(words: Column) -> Column:
    """An item cut into one piece more than tokens may differ: structs (piece, i_at)."""
    n, parts = F.size(words), _differing(F.size(words)) + 1
    cut = lambda k: F.floor(k * n / parts).cast("int")
    return F.transform(F.sequence(F.lit(0), parts - 1), lambda k: F.struct((cut(k + 1) - cut(k)).alias("piece"), cut(k).alias("i_at")))


def _along_diagonal(shift: Column) -> tuple[Column, Column]:
    """Equal tokens in the best window of the item's diagonal, and on all of it; those beyond the document's edges differ."""
    last, width = F.size("i_words") - 1, F.least(F.lit(WINDOW), F.size("i_words"))
    same = F.transform(F.sequence(F.lit(0), last), lambda j: F.when(F.get(F.col("i_words"), j) == F.get(F.col("words"), j + shift), 1).otherwise(0))
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
    windows = F.transform(F.sequence(F.lit(1), last + 2 - width), lambda s: total(F.slice(same, s, width)))
    return F.array_max(windows), total(same)


def _benchmark_seeds(items: DataFrame) -> tuple[DataFrame, list[int]]:
    """``item, i_at, i_seed``, and the lengths of the pieces that short items are cut into (15 tokens at most)."""
    masked = items.where(F.size("i_words") >= WINDOW).select("item", "i_words", F.explode(F.sequence(F.lit(0), F.size("i_words") - 1)).alias("i_at"))
    seeds = masked.select("item", "i_at", F.explode(_seeds("i_words", "i_at")).alias("i_seed")).where("i_seed is not null")
    pieces = items.where(F.size("i_words") < WINDOW).select("item", "i_words", F.inline(_pieces(F.col("i_words"))))
    lengths = sorted(r.piece for r in pieces.select("piece").distinct().collect())
    gram = F.coalesce(F.lit(None).cast("long"), *(F.when(F.col("piece") == n, _gram(F.col("i_words"), F.col("i_at"), n)) for n in lengths))
    return written(seeds.unionByName(pieces.select("item", "i_at", gram.alias("i_seed")))), lengths


def _hits_in_place(rows: DataFrame, seeds: DataFrame, items: DataFrame) -> DataFrame:
    """Documents with items along a diagonal, ``shift``; the document does not move. Of a run of hits the first is enough, as the whole diagonal is compared."""
    hits = rows.join(F.broadcast(seeds), F.col("seed") == F.col("i_seed")).join(F.broadcast(items), "item")
    goes_on = lambda m: reduce(and_, (F.get(F.col("words"), F.col("at") + (o - 1)) == F.get(F.col("i_words"), F.col("i_at") + (o - 1)) for o in m))
    inside = (F.col("at") > 0) & (F.col("i_at") > 0) & (F.size("i_words") >= WINDOW)  # short items have no masks
    run = F.coalesce(inside & reduce(or_, (goes_on(m) for m in MASKS)), F.lit(False))
    return hits.where(~run).withColumn("shift", F.col("at") - F.col("i_at"))


def _hits_by_shuffle(rows: DataFrame, documents: DataFrame, seeds: DataFrame, items: DataFrame) -> DataFrame:
    """The same for a benchmark of any size: only positions whose seed a bitmap of all seeds finds move, and only documents with a hit."""
    positions = Bitmap(seeds.select("i_seed").distinct()).split(rows.select("doc_id", "text_key", "at", "seed"), F.col("seed"), True)
    pairs = positions.join(seeds, F.col("seed") == F.col("i_seed"))
    pairs = written(pairs.select(F.col("doc_id").alias("h_id"), F.col("text_key").alias("h_key"), "item", (F.col("at") - F.col("i_at")).alias("shift")).distinct())
    some = Bitmap(pairs.select("h_key").distinct()).split(documents, F.col("text_key"), True)
    found = some.join(pairs, (F.col("text_key") == F.col("h_key")) & F.col("doc_id").eqNullSafe(F.col("h_id")))
    return found.join(items, "item")


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document and item that it leaks: ``doc_id, text_key, item_id, best_window, aligned``.

    An item leaks where, along one alignment, EQUAL of WINDOW tokens in a row
    are equal. An item of fewer tokens is one window, of which as many may
    differ in proportion: none of up to five, one from six on, two from eleven.
    Tokens of a window that lie beyond an edge of the document count as
    differing, so that a document that is part of an item is found.
    ``best_window`` and ``aligned`` are the equal tokens in the best such window
    and on the whole alignment, the best of all.

    Documents are read once and not shuffled where the benchmark has up to
    BROADCAST_SEEDS seeds: these are broadcast, and hits are verified in place.
    A larger benchmark is joined by shuffle, with the documents' positions that
    a bitmap of its seeds finds.

    Null texts have no tokens; null ids are ids. Repeated rows of one id and
    text (``text_key`` is its hash) merge to one. Empty tables give an empty
    result; further columns are ignored.
    """
    items = benchmark.select(named(item_col).alias("item_id"), tokens(named(item_text_col)).alias("i_words")).where(F.size("i_words") >= 1)
    items = written(items.distinct().withColumn("item", F.xxhash64("item_id", "i_words")))
    seeds, lengths = _benchmark_seeds(items)
    documents = docs.select(named(id_col).alias("doc_id"), F.xxhash64(named(text_col)).alias("text_key"), tokens(named(text_col)).alias("words"))
    rows = documents.select("*", F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)))).alias("at"))
    grams = F.array(*(F.when(F.col("at") + n <= F.size("words"), _gram(F.col("words"), F.col("at"), n)) for n in lengths))
    rows = rows.select("*", F.explode(F.concat(_seeds("words", "at"), grams) if lengths else _seeds("words", "at")).alias("seed")).where("seed is not null")
    hits = _hits_in_place(rows, seeds, items) if seeds.count() <= BROADCAST_SEEDS else _hits_by_shuffle(rows, documents, seeds, items)
    best, aligned = _along_diagonal(F.col("shift"))
    hits = hits.select("doc_id", "text_key", "item_id", F.size("i_words").alias("size"), F.struct(best.alias("best_window"), aligned.alias("aligned")).alias("m"))
    hits = hits.where(F.col("m.best_window") >= F.least(F.col("size"), F.lit(WINDOW)) - _differing(F.col("size")))
    return hits.groupBy("doc_id", "text_key", "item_id").agg(F.max("m").alias("m")).select("doc_id", "text_key", "item_id", "m.best_window", "m.aligned")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows, with all their columns, that leak no item; rows with a null id or text and repeated ones like others.

    Only rows whose text may be that of a leak are shuffled. Without items all
    rows stay; an empty table gives an empty result.
    """
    bad = written(leaks(docs, benchmark, id_col, text_col, **how).select("doc_id", "text_key").distinct())
    known, own = Bitmap(bad.select("text_key").distinct()), F.xxhash64(named(text_col))
    its, key = fresh("its", docs.columns), fresh("key", docs.columns)
    doubtful = known.split(docs, own, True).join(bad.toDF(its, key), named(id_col).eqNullSafe(F.col(its)) & (own == F.col(key)), "left_anti")
    return known.split(docs, own, False).unionByName(doubtful)
