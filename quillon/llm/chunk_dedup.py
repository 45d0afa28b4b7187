"""Substring dedup by content-defined chunking.

A gear hash rolls over the bytes; a chunk ends where its top bits are zero, so
cuts depend on the 32 bytes before them alone and fall alike in any copy,
whatever was inserted elsewhere. Chunks are deduplicated by 128-bit digest.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from quillon.llm.packs import Pack, asked, pack_documents, range_bounds, range_count, repeated_keys, rows_of, unmask

#: A cut where the hash has so many leading zero bits: every 32 bytes on average, but no chunk under LEAST bytes (a document's last excepted) or over MOST.
ZERO_BITS, LEAST, MOST = 5, 32, 256
#: Bytes that the hash sees, one for each of its bits.
SIGHT = 32

_ENTRY = np.dtype([("key", "<u8"), ("rest", "<u8"), ("low", "<i8"), ("high", "<i8")])
_FOUND = np.dtype([("entry", "<u4"), ("low", "<i8")])


def _gear() -> np.ndarray:
    """256 numbers from a 64-bit mixer."""
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)).astype(np.uint32)


GEAR = _gear()


def cut_points(pack: Pack) -> np.ndarray:
    """Starts of all chunks in the pack, and its end. A document's start is a cut, and the hash cuts none of its first SIGHT bytes short."""
    h = GEAR[pack.bytes]
    for step in (1, 2, 4, 8, 16):  # h[i] = sum of gear[i - k] << k
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
    hits = np.flatnonzero(h < np.uint32(1 << (32 - ZERO_BITS))) + 1
    starts = pack.starts.tolist()
    where = np.searchsorted(hits, pack.starts + SIGHT).tolist()
    stop = np.searchsorted(hits, pack.starts[1:]).tolist()
    hits = hits.tolist()
    out: list[int] = []
    for d, (a, b) in enumerate(zip(starts, starts[1:])):
        if a == b:
            continue
        out.append(a)
        for c in [*hits[where[d] : stop[d]], b]:
            while c - a > MOST:
                a += MOST
                out.append(a)
            if c - a >= LEAST and c < b:
                a = c
                out.append(a)
    out.append(starts[-1])
    return np.array(out, np.int64)


def digests(pack: Pack, cuts: np.ndarray) -> np.ndarray:
    """Two numbers for each chunk."""
    of, body, at = xxhash.xxh3_128_digest, pack.body, cuts.tolist()
    return np.frombuffer(b"".join([of(body[a:b]) for a, b in zip(at, at[1:])]), "<u8").reshape(-1, 2)


class Chunks:
    """The pack's chunks in the order of their digests, equal ones together."""

    def __init__(self, pack: Pack):
        self.cuts = cut_points(pack)
        d = digests(pack, self.cuts)
        self.order = np.lexsort((d[:, 1], d[:, 0]))
        self.key, self.rest = d[self.order].T if len(d) else (np.zeros(0, np.uint64),) * 2
        self.ids = pack.order[pack.doc_at(self.cuts[:-1][self.order])] if len(d) else np.zeros(0, np.int64)
        new = np.append(True, (self.key[1:] != self.key[:-1]) | (self.rest[1:] != self.rest[:-1])) if len(d) else np.zeros(0, bool)
        self.begins = np.flatnonzero(new)


def chunk_keys(pack: Pack) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct first halves of digests, which of them several documents have, and how often each occurs."""
    c = Chunks(pack)
    new = np.flatnonzero(np.append(True, c.key[1:] != c.key[:-1])) if len(c.key) else np.zeros(0, np.int64)
    if not len(new):
        return c.key, np.zeros(0, bool), new
    return c.key[new], np.minimum.reduceat(c.ids, new) < np.maximum.reduceat(c.ids, new), np.diff(np.append(new, len(c.key)))


def entries(pack: Pack, ranges: int, found: list[dict]) -> tuple[Chunks, np.ndarray, np.ndarray]:
    """The chunks, the numbers of the distinct ones whose key recurs, and their rows."""
    c = Chunks(pack)
    key = c.key[c.begins]
    distinct = np.unique(key)
    again = np.flatnonzero(unmask(distinct, ranges, found)[np.searchsorted(distinct, key)]) if len(key) else np.zeros(0, np.int64)
    rows = np.zeros(len(again), _ENTRY)
    if len(again):
        rows["key"], rows["rest"] = key[again], c.rest[c.begins][again]
        rows["low"], rows["high"] = np.minimum.reduceat(c.ids, c.begins)[again], np.maximum.reduceat(c.ids, c.begins)[again]
    return c, again, rows


def _lowest(pieces: list[tuple]) -> list[tuple | None]:
    """For each (pack, entries) of a key range: the smallest id that has a chunk, where an id of the pack is larger."""
    split = [np.frombuffer(r, _ENTRY) for _, r in pieces]
    rows = np.concatenate(split)
    order = np.lexsort((rows["rest"], rows["key"]))
    k, s = rows["key"][order], rows["rest"][order]
    begins = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (s[1:] != s[:-1])))
    low = np.empty(len(rows), np.int64)
    low[order] = np.repeat(np.minimum.reduceat(rows["low"][order], begins), np.diff(np.append(begins, len(order))))
    out, at = [], 0
    for piece in split:
        mine = low[at : at + len(piece)]
        at += len(piece)
        hit = np.flatnonzero(mine < piece["high"])
        got = np.empty(len(hit), _FOUND)
        got["entry"], got["low"] = hit, mine[hit]
        out.append((got.tobytes(),) if len(hit) else None)
    return out


def _without(pack: Pack, ranges: int, masks: list[dict] | None, results: list[dict] | None) -> pa.RecordBatch:
    """One row per document: ``doc_id, n_bytes, spans, kept``."""
    removed: dict[int, list[list[int]]] = {}
    if results:
        c, again, rows = entries(pack, ranges, masks)
        parts, ends = range_bounds(rows["key"], ranges)
        offset = dict(zip(parts.tolist(), ends))
        edges = np.append(c.begins, len(c.order))
        low = np.full(len(c.order), np.iinfo(np.int64).max)  # of each chunk, in the order of the text
        for r in results:
            got = np.frombuffer(r["a0"], _FOUND)
            for e, v in zip(again[got["entry"].astype(np.int64) + offset[r["part"]]].tolist(), got["low"].tolist()):
                low[c.order[edges[e] : edges[e + 1]]] = v
        doc = pack.doc_at(c.cuts[:-1])
        gone = np.flatnonzero(low < pack.order[doc])
        for k, d, a, b, v in zip(gone.tolist(), doc[gone].tolist(), c.cuts[gone].tolist(), c.cuts[gone + 1].tolist(), low[gone].tolist()):
            mine = removed.setdefault(d, [])
            if mine and mine[-1][1] == a:
                mine[-1][1], mine[-1][2] = b, min(v, mine[-1][2])
            else:
                mine.append([a, b, v])
    spans, kept = [], []
    for d, (a, b) in enumerate(zip(pack.starts.tolist(), pack.starts[1:].tolist())):
        at, pieces, mine = a, [], removed.get(d, ())
        for x, y, _ in mine:
            pieces.append(pack.body[at:x])
            at = y
        spans.append([{"start": x - a, "end": y - a, "first_id": v} for x, y, v in mine])
        kept.append(b"".join([*pieces, pack.body[at:b]]))
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("first_id", pa.int64())])
    columns = [pa.array(pack.ids, pa.int64()), pa.array(np.diff(pack.starts)), pa.array(spans, pa.list_(span)), pa.array(kept, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "spans", "kept"])


def chunk_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, spans, kept``.

    A chunk goes if a document with a smaller id has a chunk of the same digest;
    neighbouring removed chunks are one span. ``first_id`` of a span is the smallest id that has a chunk of it, and
    ``kept`` the bytes that stay, as binary.

    Digests are compared by key range, first by a few bytes of which only bit
    masks come back, then whole for those that recur, each once per pack with
    its smallest and largest id. However often a chunk occurs, a pack sends it
    once.

    Null text is empty. Ids are integers; a null id is larger than any other.
    Rows of one id remove nothing from each other. An empty table gives an
    empty result; further columns are ignored.
    """
    packs = pack_documents(docs, id_col, text_col)
    ranges = range_count(packs)
    found = repeated_keys(packs, ranges, chunk_keys)

    def pieces_of(pack: int, ids: list, sizes: list, body: bytes, masks: list[dict]) -> Iterator[tuple]:
        _, _, rows = entries(Pack(ids, sizes, body), ranges, masks)
        parts, ends = range_bounds(rows["key"], ranges)
        for part, a, b in zip(parts.tolist(), ends, ends[1:]):
            yield part, pack, rows[a:b].tobytes()

    masked = packs.join(found, "pack").select("pack", "ids", "sizes", "body", "found")
    results = asked(masked, ranges, pieces_of, 1, _lowest, 1).withColumnRenamed("found", "results")

    def finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sizes, body, masks, lows in rows_of(batches):
            yield _without(Pack(ids, sizes, body), ranges, masks, lows)

    known = found.join(results, "pack", "left")
    all_ = packs.join(known, "pack", "left").select("ids", "sizes", "body", "found", "results")
    return all_.mapInArrow(finish, "doc_id long, n_bytes long, spans array<struct<start:long,end:long,first_id:long>>, kept binary")
