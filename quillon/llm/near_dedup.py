"""Near-dedup by HyperMinHash.

One hash per word shingle falls into one of BUCKETS buckets; a bucket's
register keeps the leading zeros of its smallest hash and a few bits behind
them. Bands of registers propose documents; registers estimate their
similarity, corrected for registers that agree by chance; full shingle sets
decide. Sets are sets of 64-bit hashes of shingles: two different shingles of a
pair of documents fall together at odds of about 1e-13 for 1,000 shingles each.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import Bitmap, matching_rows, named, written
from quillon.llm.graph import components

SHINGLE = 5
#: Two sets link where 100 * intersection >= percent * union, unless told otherwise with this percentage.
PERCENT = 85
#: Simulated, a pair meets in no band at a rate of up to 5e-10 at exactly 85 percent and 1.1e-6 at 80, beyond it more rarely.
BANDS, BAND_ROWS = 36, 5
BUCKETS = BANDS * BAND_ROWS
MANTISSA = 10
#: Estimates that lie so many standard errors under the threshold are not verified.
SLACK = 7.0
#: Sets compared in one go: so many, and of so many shingles together.
BLOCK_SETS, BLOCK_SHINGLES = 256, 1_000_000

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """Word to hash; emptied when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hash_of = _Words()
#: For each bucket the order in which an empty one asks the others.
_DONORS = np.argsort(_mixed(np.arange(BUCKETS * BUCKETS, dtype=np.uint64) + np.uint64(1)).reshape(BUCKETS, BUCKETS), axis=1)


def shingle_set(text: bytes | None) -> np.ndarray:
    """Sorted hashes of the distinct shingles; A-Z is lower-cased, words part at ASCII white space."""
    words = (text or b"").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_hash_of.__getitem__, words), np.uint64, n)
    if n < SHINGLE:
        return _mixed((h * _ODD[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n))
    s = h[: n - 4] * _ODD[0]
    for k in range(1, SHINGLE):
        s += h[k : n - 4 + k] * _ODD[k]
    return np.unique(_mixed(s))


def registers(shingles: np.ndarray) -> np.ndarray:
    """BUCKETS registers of 16 bits; an empty bucket takes the register of the first in its order that is not."""
    a = _mixed(shingles + _ODD[0])
    bucket = ((a >> np.uint64(32)) * np.uint64(BUCKETS)) >> np.uint64(32)
    keyed = (bucket << np.uint64(56)) | (_mixed(a + _ODD[1]) >> np.uint64(8))
    keyed.sort()
    bucket = (keyed >> np.uint64(56)).astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    part, exponent = np.frexp((keyed[first] & np.uint64((1 << 56) - 1)).astype(np.float64))
    zeros = 56 - np.minimum(exponent, 56)
    out = np.zeros(BUCKETS, np.uint16)
    full = np.zeros(BUCKETS, bool)
    out[bucket[first]] = (zeros << MANTISSA) | np.clip((part * 2 - 1) * (1 << MANTISSA), 0, (1 << MANTISSA) - 1).astype(np.int64)
    full[bucket[first]] = True
    empty = np.flatnonzero(~full)
    if len(empty):
        out[empty] = out[_DONORS[empty, full[_DONORS[empty]].argmax(1)]]
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    rows = regs.reshape(BANDS, BAND_ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64)
    for k in range(BAND_ROWS):
        key = _mixed(key * _ODD[0] + rows[:, k] + np.uint64(1))
    return key.view(np.int64)


def chance(size: float) -> float:
    """How often two registers of different hashes agree: same leading zeros, of which each number is as likely as ``size`` shingles make it, and same mantissa."""
    k = np.arange(60)
    beyond = 1 - (1 - 2.0**-k) ** max(size / BUCKETS, 1.0)
    return float(((beyond[:-1] - beyond[1:]) ** 2).sum()) / (1 << MANTISSA)


def estimates(regs: np.ndarray, one: np.ndarray, size: float) -> np.ndarray:
    """Jaccard estimates of ``one`` against each row of ``regs``, without the agreement that chance makes."""
    c = chance(size)
    return ((regs == one).mean(axis=1) - c) / (1 - c)


def least_estimate(size: np.ndarray, percent: int) -> np.ndarray:
    """The estimate from which on a pair is verified, by the size of its smaller set.

    Only as many registers tell something as buckets are filled; those that
    borrow a register repeat it, which adds to the error. Sets of a few shingles
    are always verified, as the bound is negative there.
    """
    t = percent / 100
    full = -BUCKETS * np.expm1(np.maximum(size, 1) * np.log1p(-1 / BUCKETS))
    return t - SLACK * np.sqrt(t * (1 - t) * (1 / full + (BUCKETS - full) / BUCKETS**2))


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def spanning_links(sets: list[np.ndarray], side: np.ndarray | None = None, percent: int = PERCENT, group: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect all that linked pairs connect; with ``side``, of pairs from different sides.

    A pair is skipped only if links found before, or those that made ``group``,
    connect it, if sizes alone rule it out, or if its estimate lies far under
    the threshold.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets])
    regs = np.stack([registers(s) for s in sets])
    group = np.arange(n) if group is None else group.copy()
    found = []
    for i in range(n - 1):
        j = np.arange(i + 1, n)
        j = j[(group[j] != group[i]) & (100 * np.minimum(size[j], size[i]) >= percent * np.maximum(size[j], size[i]))]
        if side is not None:
            j = j[side[j] != side[i]]
        if not len(j):
            continue
        guess = estimates(regs[j], regs[i], float(size[i]))
        ok = guess >= least_estimate(np.minimum(size[j], size[i]), percent)
        for k in j[ok][np.argsort(-guess[ok], kind="stable")]:
            if group[k] != group[i] and linked(sets[i], sets[k], percent):
                found.append((i, int(k)))
                group[group == group[k]] = group[i]
    return found


def _sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text_key, text) to (doc_id, text_key, n_shingles, digest, bands)."""
    for batch in batches:
        sizes, digests, bands = [], [], []
        for text in batch.column(2):
            s = shingle_set(text.as_py())
            sizes.append(len(s))
            digests.append(xxhash.xxh3_128_digest(s.tobytes()))
            bands.append(band_keys(registers(s)) if len(s) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
            ["doc_id", "text_key", "n_shingles", "digest", "bands"],
        )


def _sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, node, n, digest, text) to (part, node, n, digest, registers, shingles)."""
    for batch in batches:
        sets = [shingle_set(t.as_py()) for t in batch.column(4)]
        regs = [registers(s).tobytes() for s in sets]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(regs, pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], _SETS_NAMES)


_SETS = "part long, node long, n long, digest binary, registers binary, shingles binary"
_SETS_NAMES = [c.split()[0] for c in _SETS.split(", ")]


def _pairs(rows: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], pa.binary()) for k in (0, 1)], ["a", "b"])


def _links(batches: Iterable[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (part, low, high, block, digest, label, shingles) in the order of the first three to links between digests."""

    def of(rows: list) -> list[tuple[bytes, bytes]]:
        rows = list({d: (d, s, b, g) for b, d, g, s in rows}.values())  # one of each set
        if len(rows) < 2:
            return []
        side = np.array([b != rows[0][2] for _, _, b, _ in rows])
        sets = [np.frombuffer(s, np.uint64) for _, s, _, _ in rows]
        labels: dict[bytes, int] = {}
        group = np.array([labels.setdefault(g, len(labels)) for *_, g in rows])
        return [(rows[i][0], rows[j][0]) for i, j in spanning_links(sets, side if side.any() else None, percent, group)]

    key, rows = None, []
    for batch in batches:
        out = []
        for k0, k1, k2, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if (k0, k1, k2) != key:
                out += of(rows)
                key, rows = (k0, k1, k2), []
            rows.append(row)
        yield _pairs(out)
    yield _pairs(of(rows))


def _likely(batches: Iterable[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(node, low, n, registers, l_n, l_registers) to the (node, low) whose estimate may reach the threshold."""
    for batch in batches:
        node, low, n, regs, l_n, l_regs = batch.columns
        keep = []
        for k, (x, a, y, b) in enumerate(zip(n.to_pylist(), regs.to_pylist(), l_n.to_pylist(), l_regs.to_pylist())):
            guess = estimates(np.frombuffer(a, np.uint16)[None], np.frombuffer(b, np.uint16), float(x))[0]
            if guess >= least_estimate(np.int64(min(x, y)), percent):
                keep.append(k)
        at = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([node.take(at), low.take(at)], ["node", "low"])


def _confirmed(batches: Iterable[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(digest, shingles, l_digest, l_shingles) to links between digests."""
    for batch in batches:
        yield _pairs([(a, b) for a, x, b, y in zip(*(c.to_pylist() for c in batch.columns)) if a != b and linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent)])


def _similar_sizes(percent: int):
    return 100 * F.least("n", "l_n") >= percent * F.greatest("n", "l_n")


def _star_links(sets: DataFrame, proposed: DataFrame, percent: int) -> DataFrame:
    """Links among the proposed edges: registers rule most of the others out, full sets are sent for the rest only."""
    light = sets.select("node", "n", "registers")
    centre = light.toDF("low", "l_n", "l_registers")
    pairs = proposed.join(light, "node").join(centre, "low").where(_similar_sizes(percent)).select("node", "low", "n", "registers", "l_n", "l_registers")
    likely = written(pairs.mapInArrow(partial(_likely, percent=percent), "node long, low long"))
    full = sets.select("node", "digest", "shingles")
    both = likely.join(full, "node").join(full.toDF("low", "l_digest", "l_shingles"), "low").select("digest", "shingles", "l_digest", "l_shingles")
    return both.mapInArrow(partial(_confirmed, percent=percent), "a binary, b binary")


def _hashes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, n, label, shingles) with the shingles as numbers."""
    for batch in batches:
        lists = [np.frombuffer(s, np.int64) for s in batch.column(3).to_pylist()]
        ends = np.cumsum([0, *map(len, lists)])
        flat = pa.array(np.concatenate(lists) if lists else np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), flat).cast(pa.list_(pa.int64()))], ["node", "n", "label", "shingles"])


def _refined(sets: DataFrame, percent: int) -> DataFrame:
    """``node, part`` for the sets that may have a link across labels, by the prefix filter; no such link is lost.

    Shingles are put in one order for all sets: first those that one label only
    has, then by rising number of sets. Of two linked sets of n and m shingles,
    the first n - ceil(t n) + 1 of the one and the first m - ceil(t m) + 1 of the
    other have one in common. Templates that many documents share stand last and
    propose nothing.
    """
    rows = sets.select("node", "n", F.xxhash64("label").alias("label"), "shingles").mapInArrow(_hashes, "node long, n long, label long, shingles array<long>")
    tokens = rows.select("node", "n", "label", F.explode("shingles").alias("s"))
    spread = tokens.groupBy("s").agg(F.count(F.lit(1)).alias("many"), F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    held = tokens.join(written(spread.select("s", "many")), "s").groupBy("node", "n", "label").agg(F.array_sort(F.collect_list(F.struct("many", "s"))).alias("held"))
    least = F.floor((F.col("n") * percent + 99) / 100).cast("long")
    take = (F.size("held") - least + 1).cast("int")  # the shingles of one label come first and use up the rest
    first = held.where(take > 0).select("node", "label", F.explode(F.slice("held", F.lit(1), take)).alias("t")).select("node", "label", F.col("t.s").alias("s"))
    first = written(first)
    meet = first.groupBy("s").agg(F.min("node").alias("low"), F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("s", "low")
    edges = first.join(written(meet), "s").where("node != low").select("node", "low").distinct()
    return components(edges, "node", "low").select("node", F.col("component").alias("part"))


def _wide_links(sets: DataFrame, proposed: DataFrame, percent: int) -> DataFrame:
    """Links that connect all that linked pairs of parts of any size connect.

    Near copies link to the smallest node of a band and get its label; what is
    left to compare are sets of different labels that the prefix filter lets
    meet. These are dealt into blocks, large labels into blocks of their own,
    and blocks are compared in pairs but for those of one label.
    """
    star = written(_star_links(sets, proposed, percent))
    label = components(star, "a", "b").select(F.col("node").alias("l_digest"), F.col("component").alias("label"))
    labelled = written(sets.join(label, F.col("digest") == F.col("l_digest"), "left").select("node", "n", "digest", "shingles", F.coalesce("label", "digest").alias("label")))
    parts = written(_refined(labelled, percent))
    rows = labelled.join(parts, "node")
    sizes = written(rows.groupBy("part", "label").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("shingles")))
    need = F.greatest(F.ceil(F.col("sets") / BLOCK_SETS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    own = sizes.select("part", "label", need.alias("blocks")).where("blocks > 1").select(F.col("part").alias("o_part"), F.col("label").alias("o_label"), "blocks")
    own = written(own)
    rest = sizes.join(own, (F.col("part") == F.col("o_part")) & (F.col("label") == F.col("o_label")), "left_anti")
    pool = written(rest.groupBy("part").agg(F.sum("sets").alias("sets"), F.sum("shingles").alias("shingles")).select(F.col("part").alias("p_part"), need.alias("pool")))
    # a block is (number, label); in the pool the label is empty
    none = F.lit(b"").cast("binary")
    many = own.select(F.col("o_part").alias("part"), F.col("o_label").alias("of"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("k"))
    many = written(many.unionByName(pool.select(F.col("p_part").alias("part"), none.alias("of"), F.explode(F.sequence(F.lit(0), F.col("pool") - 1)).alias("k"))))
    block = F.struct("of", "k")
    one, other = many.select("part", block.alias("low")), many.select("part", block.alias("high"))
    meet = one.join(other, "part").where((F.col("low") <= F.col("high")) & ((F.col("low.of") == none) | (F.col("low.of") != F.col("high.of"))))
    sides = meet.select("part", "low", "high", F.explode(F.array_distinct(F.array("low", "high"))).alias("block"))
    at = F.pmod(F.xxhash64("digest"), F.coalesce("blocks", "pool")).cast("int")
    rows = rows.join(own, (F.col("part") == F.col("o_part")) & (F.col("label") == F.col("o_label")), "left").join(pool, F.col("part") == F.col("p_part"), "left")
    rows = rows.select("part", F.struct(F.when(F.col("blocks").isNull(), none).otherwise(F.col("label")).alias("of"), at.alias("k")).alias("block"), "digest", "label", "shingles")
    dealt = rows.join(written(sides), ["part", "block"])
    key = lambda c: F.concat_ws(":", F.hex(F.col(f"{c}.of")), F.col(f"{c}.k"))
    dealt = dealt.select("part", key("low").alias("low"), key("high").alias("high"), key("block").alias("block"), "digest", "label", "shingles")
    dealt = dealt.repartition("part", "low", "high").sortWithinPartitions("part", "low", "high")
    return star.unionByName(dealt.mapInArrow(partial(_links, percent=percent), "a binary, b binary"))


def _grouped(docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """``doc_id, text_key, n_shingles, component``; the component is null for documents without shingles."""
    kind = docs.schema[id_col].dataType
    rows = docs.select(named(id_col).alias("doc_id"), F.xxhash64(named(id_col), named(text_col)).alias("text_key"), named(text_col).cast("binary").alias("text"))
    schema = T.StructType().add("doc_id", kind).add("text_key", "long").add("n_shingles", "long").add("digest", "binary").add("bands", T.ArrayType(T.LongType()))
    light = written(rows.select("doc_id", "text_key", "text").mapInArrow(_sketch, schema))
    # equal sets are one node from here on; they merge before the shuffle. Aggregates are written before they are joined,
    # so that Spark may split a band or part that many nodes share
    node = F.xxhash64("digest").alias("node")
    nodes = light.where("n_shingles > 0").groupBy("digest").agg(F.first("bands").alias("bands"))
    keys = written(nodes.select(node, F.explode("bands").alias("key")))
    shared = keys.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("key", "low")
    proposed = written(keys.join(written(shared), "key").where("node != low").select("node", "low").distinct())
    parts = components(proposed, "node", "low").withColumnRenamed("component", "part")
    members = light.where("n_shingles > 0").groupBy("digest").agg(F.min(F.struct("text_key", "doc_id")).alias("first"), F.first("n_shingles").alias("n"))
    members = written(members.select("digest", "first.*", "n", node).join(parts, "node"))
    sizes = members.groupBy("part").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("shingles"))
    wide = written(sizes.where((F.col("sets") > BLOCK_SETS) | (F.col("shingles") > BLOCK_SHINGLES)).select("part"))

    def sets_of(how: str) -> DataFrame:
        some = written(members.join(wide, "part", how).select("part", "node", "n", "digest", F.col("text_key").alias("m_key"), F.col("doc_id").alias("m_id")))
        texts = Bitmap(some.select("m_key")).split(rows, F.col("text_key"), True).join(some, (F.col("text_key") == F.col("m_key")) & F.col("doc_id").eqNullSafe(F.col("m_id")))
        return texts.select("part", "node", "n", "digest", "text").mapInArrow(_sets, _SETS)

    # a part of a bounded size is compared in one place
    whole = sets_of("left_anti").select("part", F.lit("").alias("low"), F.lit("").alias("high"), F.lit("").alias("block"), "digest", F.col("digest").alias("label"), "shingles")
    whole = whole.repartition("part").sortWithinPartitions("part")
    links = whole.mapInArrow(partial(_links, percent=percent), "a binary, b binary")
    if wide.count():
        sets = written(sets_of("left_semi"))
        links = links.unionByName(_wide_links(sets, proposed.join(sets.select("node"), "node", "left_semi"), percent))
    found = components(links, "a", "b")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "digest")).alias("component")
    return light.drop("bands").join(found, F.col("digest") == F.col("node"), "left").select("doc_id", "text_key", "n_shingles", component)


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept``.

    Documents link where their sets of five-word shingles (A-Z lower-cased; all
    words as one where there are fewer) are at least ``percent`` percent similar.
    ``component_id`` is the smallest id that links reach, ``kept`` whether it is
    the document's own.

    Copies of a set are one node. Documents that share a band are proposed by an
    edge to the band's smallest node, never pair by pair. A part of that graph of
    up to BLOCK_SETS sets is compared in one place. In larger ones the proposed
    edges are verified, first by registers, then by full sets; what they leave
    apart goes through a prefix filter over full sets, and only what that lets
    meet is compared, in blocks. A pair is left out only if links already connect
    it, so a large group of near copies costs few comparisons, a large group of
    texts from one template costs its shingles, and no link is lost.

    Null and empty texts have no shingles and are alone. Null ids are larger
    than any other: a group of null ids only has a null component. Repeated rows
    share their verdict. An empty table gives an empty result; further columns
    are ignored.
    """
    rows = written(_grouped(docs, id_col, text_col, percent))
    low = rows.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("low")).withColumnRenamed("component", "of")
    found = rows.join(written(low), F.col("component") == F.col("of"), "left")
    own = F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("low"))
    return found.select("doc_id", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row of each component, with all its columns: that of the smallest id, of repeated rows one.

    Documents that are alone are not shuffled. Null and empty texts are in no
    component and stay; a null id is larger than any other; an empty table gives
    an empty result.
    """
    rows = written(_grouped(docs, id_col, text_col, percent))
    groups = rows.where("component is not null").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("first"), F.count(F.lit(1)).alias("n"))
    groups = written(groups.where("n > 1").withColumnRenamed("component", "of"))
    shared = written(rows.join(groups.select("of"), F.col("component") == F.col("of"), "left_semi").select("doc_id", "text_key"))
    known, own = Bitmap(shared.select("text_key")), F.xxhash64(named(id_col), named(text_col))
    # of the documents that may be in a group, its first stays, and so do those that the bitmap found by chance
    stay = groups.select("first.doc_id", "first.text_key")
    keys = shared.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n"))
    same = F.col("k.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("k.text_key") == F.col("s.text_key"))
    keys = keys.alias("k").join(stay.alias("s"), same, "left_semi").select("doc_id", "text_key", "n")
    chance = known.split(rows, F.col("text_key"), True).select("doc_id", "text_key").join(shared.select(F.col("text_key").alias("of")), F.col("text_key") == F.col("of"), "left_anti")
    keys = keys.unionByName(chance.distinct().withColumn("n", F.lit(0).cast("long")))
    return known.split(docs, own, False).unionByName(matching_rows(known.split(docs, own, True), id_col, text_col, own, keys))
