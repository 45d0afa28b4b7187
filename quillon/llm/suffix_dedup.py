"""Suffix-array dedup: removes every byte under a WIDTH-byte string that a smaller id's document also has.

Suffixes are compared to WIDTH bytes. Anchors chosen by content (the smallest
hash of a GRAM-byte string in each window) say which windows could recur at
all. The suffixes from anchors of more than one document, and the bytes before
them backwards, are sorted deep-shallow, range by range of the anchors' hashes;
what recurs stands side by side in that order, and common prefixes of neighbours
say how far.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillon.llm.packs import Pack, asked, pack_documents, range_bounds, range_count, repeated_keys, rows_of, unmask
from quillon.llm.suffix_sort import deep_shallow

#: Fixed by the contract.
WIDTH = 50
GRAM = 20
#: Windows start at most SPREAD - 1 bytes before their anchor, so a context has at most CONTEXT bytes: ten words of eight.
SPREAD = WIDTH - GRAM + 1
CONTEXT = WIDTH + SPREAD - 1
#: Contexts of a key with more uses are sent window by window, dealt by the windows' own hashes, so that no task gets them all.
HOT_USES = 20_000
#: About so many contexts are sorted at once; a single key has HOT_USES at most.
SORT_CONTEXTS = 100_000
#: Bytes hashed at once, for the sake of the processor's cache.
SLICE = 1 << 17

_A = 0x9E3779B97F4A7C15
_POWER = {k: np.uint64(pow(_A, k, 1 << 64)) for k in (1, 2, 4, 8)}
_ENTRY = np.dtype([("key", "<u8"), ("low", "<i8"), ("high", "<i8"), ("size", "u1"), ("lead", "u1")])
_RUN = np.dtype([("entry", "<u4"), ("first", "u1"), ("last", "u1"), ("low", "<i8")])


def anchors(pack: Pack) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Key, position, first and last window start of each anchor. Windows are those within one document; equal windows have equal keys and lie equally around their anchor."""
    data = pack.bytes
    inside = np.ones(len(data) + 1, bool)
    for a, b in zip(pack.starts, pack.starts[1:]):
        inside[max(a, b - WIDTH + 1) : b] = False
    keys, at, first, last = [], [], [], []
    for s in range(0, len(data) - WIDTH + 1, SLICE):
        x = data[s : s + SLICE + WIDTH - 1].astype(np.uint64) + np.uint64(1)
        h2 = x[:-1] * _POWER[1] + x[1:]
        h4 = h2[:-2] * _POWER[2] + h2[2:]
        h8 = h4[:-4] * _POWER[4] + h4[4:]
        h16 = h8[:-8] * _POWER[8] + h8[8:]
        h = h16[:-4] * _POWER[4] + h4[16:]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        h *= np.uint64(_A)
        h ^= h >> np.uint64(32)
        m = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)  # the leftmost of equal ones
        for step in (1, 2, 4, 8):
            m = np.minimum(m[:-step], m[step:])
        m = np.minimum(m[: -(SPREAD - 16)], m[SPREAD - 16 :])
        pos = (m & np.uint64(0xFFFFFFFF)).astype(np.int64)
        ok = inside[s : s + len(pos)]
        new = np.flatnonzero(np.append(True, (pos[1:] != pos[:-1]) | (ok[1:] != ok[:-1])))
        end = np.append(new[1:], len(pos)) - 1
        used = ok[new]
        new, end = new[used], end[used]
        keys.append(h[pos[new]])
        at.append(pos[new] + s)
        first.append(new + s)
        last.append(end + s)
    if not keys:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    keys, at, first, last = map(np.concatenate, (keys, at, first, last))
    # anchors have small hashes, as the smallest was chosen; another mixing spreads their keys evenly over the ranges
    keys = (keys ^ (keys >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    keys ^= keys >> np.uint64(32)
    keys *= np.uint64(0xD6E8FEB86659FD93)
    keys ^= keys >> np.uint64(29)
    # a run that a slice's end cut in two
    new = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (first[1:] != last[:-1] + 1))) if len(at) else np.zeros(0, np.int64)
    return keys[new], at[new], first[new], last[np.append(new[1:], len(at)) - 1] if len(at) else last


def anchor_keys(pack: Pack) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys in order, which of them several documents have, and how often each occurs."""
    keys, _, first, _ = anchors(pack)
    doc = pack.doc_at(first)
    order = np.lexsort((doc, keys))
    keys, doc = keys[order], doc[order]
    new = np.append(True, keys[1:] != keys[:-1]) if len(keys) else np.zeros(0, bool)
    other = np.append(False, (doc[1:] != doc[:-1])) & ~new
    begins = np.flatnonzero(new)
    return keys[begins], np.logical_or.reduceat(other, begins) if len(begins) else other, np.diff(np.append(begins, len(keys)))


def _contexts(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CONTEXT bytes from each start, zero beyond its size, as words. ``flat`` goes on for CONTEXT bytes behind the last."""
    got = np.lib.stride_tricks.sliding_window_view(flat, CONTEXT)[starts]
    got[np.arange(CONTEXT) >= sizes[:, None]] = 0
    return got.view(np.uint64)


def _equal_runs(keys: np.ndarray, sizes: np.ndarray, leads: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by key in which equal contexts are neighbours, and where each distinct one begins in it."""
    shape = sizes.astype(np.uint64) * np.uint64(256) + leads
    mark = shape.copy()
    for k in range(words.shape[1]):
        mark = (mark ^ words[:, k]) * np.uint64(_A)
        mark ^= mark >> np.uint64(29)
    order = np.lexsort((mark, keys))
    k, s, w = keys[order], shape[order], words[order]
    new = np.append(True, (k[1:] != k[:-1]) | (s[1:] != s[:-1]) | (w[1:] != w[:-1]).any(axis=1)) if len(k) else np.zeros(0, bool)
    return order, np.flatnonzero(new)


class Entries:
    """The pack's distinct contexts of repeated anchors, in order, with the occurrences of each.

    The contexts of hot anchors are their single windows, each under a key that
    hashes the window.
    """

    def __init__(self, pack: Pack, ranges: int, found: list[dict]):
        keys, at, first, last = anchors(pack)
        distinct = np.unique(keys)
        where = np.searchsorted(distinct, keys)
        none = np.zeros(0, bool)
        again = unmask(distinct, ranges, found)[where] if len(keys) else none
        hot = unmask(distinct, ranges, found, 1)[where][again] if len(keys) else none
        keys, at, first, last = keys[again], at[again], first[again], last[again]
        flat = np.append(pack.bytes, np.zeros(CONTEXT, np.uint8))
        sizes = (last - first + WIDTH).astype(np.uint8)
        leads = (at - first).astype(np.uint8)
        if hot.any():
            row, start = spread(first[hot], (last - first + 1)[hot])
            size = np.full(len(row), WIDTH, np.uint8)
            key = keys[hot][row]
            for w in _contexts(flat, start, size).T:
                key = (key ^ w) * np.uint64(_A)
                key ^= key >> np.uint64(32)
            keep = ~hot
            first, sizes = np.append(first[keep], start), np.append(sizes[keep], size)
            keys, leads = np.append(keys[keep], key), np.append(leads[keep], (at[hot][row] - start).astype(np.uint8))
        words = _contexts(flat, first, sizes)
        order, self.begins = _equal_runs(keys, sizes, leads, words)
        self.starts = first[order]  # of each occurrence
        self.ids = pack.order[pack.doc_at(self.starts)]
        one = order[self.begins]
        self.keys, self.sizes = keys[one], sizes[one]
        self.rows = np.zeros(len(one), _ENTRY)
        self.rows["key"], self.rows["size"], self.rows["lead"] = self.keys, self.sizes, leads[one]
        if len(one):
            self.rows["low"], self.rows["high"] = np.minimum.reduceat(self.ids, self.begins), np.maximum.reduceat(self.ids, self.begins)
        self._bytes, self._of = words.view(np.uint8), one

    def texts(self, a: int, b: int) -> bytes:
        got, sizes = self._bytes[self._of[a:b]], self.sizes[a:b]
        return got[np.arange(CONTEXT) < sizes[:, None]].tobytes()


def spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row ``count`` numbers from ``first`` up; the row of each, and the numbers."""
    row = np.repeat(np.arange(len(count)), count)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)


class Side:
    """One side of the anchors, as strings of the key and ``width`` bytes away from it, sorted; neighbours share so many bytes."""

    def __init__(self, keys: np.ndarray, flat: np.ndarray, at: np.ndarray, size: np.ndarray, width: int, step: int):
        record = np.zeros((len(keys), 8 + width), np.uint8)
        record[:, :8] = keys.astype(">u8")[:, None].view(np.uint8)
        for k in range(width):  # zero beyond the size
            on = size > k
            record[on, 8 + k] = flat[at[on] + step * k]
        self._order, _ = deep_shallow(record.ravel(), np.arange(len(keys)) * (8 + width), 8 + width)
        record = record[self._order]
        differ = record[1:] != record[:-1]
        self._shared = np.where(differ.any(axis=1), differ.argmax(axis=1), 8 + width) - 8

    def classes(self, depth: int) -> np.ndarray:
        """Equal numbers for strings that share ``depth`` bytes, which stand side by side; they rise in the order of the strings."""
        out = np.empty(len(self._order), np.int64)
        out[self._order] = np.append(0, np.cumsum(self._shared < depth))
        return out


def _smallest(rows: np.ndarray, body: bytes) -> np.ndarray:
    """For entries of one key range: runs of windows, each with the smallest id that has them, where an id of the entry is larger.

    Equal windows have one key and lie equally around its anchor. So suffixes
    are sorted from the anchor on, and what stands before it backwards; a window
    of so many bytes on either side is known by what its strings share there.
    """
    flat = np.frombuffer(body, np.uint8)
    sizes, leads = rows["size"].astype(np.int64), rows["lead"].astype(np.int64)
    anchor = np.cumsum(sizes) - sizes + leads
    ahead = Side(rows["key"], flat, anchor, sizes - leads, WIDTH, 1)
    behind = Side(rows["key"], flat, anchor - 1, leads, SPREAD - 1, -1)
    # an entry for each distinct context, in the order of their keys
    whole, shape = ahead.classes(WIDTH) * len(rows) + behind.classes(SPREAD - 1), leads * 256 + sizes
    order = np.lexsort((shape, whole))
    begins = np.flatnonzero(np.append(True, (whole[order][1:] != whole[order][:-1]) | (shape[order][1:] != shape[order][:-1])))
    one = order[begins]
    low = np.minimum.reduceat(rows["low"][order], begins)
    windows, lead = sizes[one] - WIDTH + 1, leads[one]
    key = rows["key"][one]
    alone = np.append(True, key[1:] != key[:-1]) & np.append(key[1:] != key[:-1], True)
    several = np.flatnonzero(~alone)  # contexts of keys that have several may share some windows only
    value = np.repeat(low[several][:, None], SPREAD, axis=1)  # the smallest id of each window
    for around in range(SPREAD):
        at = lead[several] - around
        row = np.flatnonzero((at >= 0) & (at < windows[several]))
        if len(row) < 2:
            continue
        same = (ahead.classes(WIDTH - around) * len(rows) + behind.classes(around))[one[several[row]]]
        by = np.argsort(same, kind="stable")
        heads = np.flatnonzero(np.append(True, same[by][1:] != same[by][:-1]))
        least = np.minimum.reduceat(low[several[row]][by], heads)
        value[row[by], at[row[by]]] = np.repeat(least, np.diff(np.append(heads, len(by))))
    begins_run = np.arange(SPREAD) < windows[several][:, None]
    begins_run[:, 1:] &= value[:, 1:] != value[:, :-1]
    row, first = np.nonzero(begins_run)
    last = np.append(np.where(row[1:] == row[:-1], first[1:], windows[several][row[:-1]]), windows[several][row[-1:]]) - 1
    run_of = np.concatenate([np.flatnonzero(alone), several[row]])
    run_first = np.concatenate([np.zeros(alone.sum(), np.int64), first])
    run_last = np.concatenate([windows[alone] - 1, last])
    run_low = np.concatenate([low[alone], value[row, first]])
    by = np.argsort(run_of, kind="stable")
    run_of, run_first, run_last, run_low = run_of[by], run_first[by], run_last[by], run_low[by]
    # each entry gets the runs of its context
    context = np.empty(len(rows), np.int64)
    context[order] = np.repeat(np.arange(len(one)), np.diff(np.append(begins, len(order))))
    begin = np.searchsorted(run_of, context)
    entry, run = spread(begin, np.searchsorted(run_of, context, side="right") - begin)
    useful = run_low[run] < rows["high"][entry]
    entry, run = entry[useful], run[useful]
    out = np.empty(len(run), _RUN)
    out["entry"], out["first"], out["last"], out["low"] = entry, run_first[run], run_last[run], run_low[run]
    return out


def _sorted(pieces: list[tuple]) -> list[tuple | None]:
    """For each (pack, entries, texts) of a key range its runs, or None; the range is sorted in parts of a bounded number of contexts."""
    rows = [np.frombuffer(r, _ENTRY) for _, r, _ in pieces]
    texts = [pa.decompress(t, int(r["size"].sum()), codec="zstd", asbytes=True) for r, (*_, t) in zip(rows, pieces)]
    places = [np.append(0, np.cumsum(r["size"], dtype=np.int64)) for r in rows]
    low, high = min(int(r["key"][0]) for r in rows), max(int(r["key"][-1]) for r in rows)
    steps = 1 + sum(map(len, rows)) // SORT_CONTEXTS
    cuts = [np.uint64(low + (high - low) * k // steps) for k in range(1, steps)]
    ends = [[0, *np.searchsorted(r["key"], cuts).tolist(), len(r)] for r in rows]
    out: list[list[bytes]] = [[] for _ in rows]
    for k in range(steps):
        spans = [(e[k], e[k + 1]) for e in ends]
        some = np.concatenate([r[a:b] for r, (a, b) in zip(rows, spans)])
        if not len(some):
            continue
        body = b"".join([*(t[at[a] : at[b]] for t, at, (a, b) in zip(texts, places, spans)), bytes(CONTEXT)])
        found = _smallest(some, body)
        begin = np.cumsum([0, *(b - a for a, b in spans)])
        cut = np.searchsorted(found["entry"], begin)
        for j, (a, _) in enumerate(spans):
            mine = found[cut[j] : cut[j + 1]].copy()
            mine["entry"] = mine["entry"].astype(np.int64) + (a - begin[j])
            out[j].append(mine.tobytes())
    return [(b"".join(o),) if any(o) else None for o in out]


def covered(pack: Pack, entries: Entries, ranges: int, results: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the maximal runs of bytes that go; none crosses documents."""
    parts, ends = range_bounds(entries.keys, ranges)
    offset = dict(zip(parts.tolist(), ends))
    edges = np.append(entries.begins, len(entries.starts))
    begin, end = [], []
    for r in results:
        found = np.frombuffer(r["a0"], _RUN)
        entry = found["entry"].astype(np.int64) + offset[r["part"]]
        row, place = spread(edges[entry], edges[entry + 1] - edges[entry])
        later = entries.ids[place] > found["low"][row]
        row, start = row[later], entries.starts[place[later]]
        begin.append(start + found["first"][row])
        end.append(start + found["last"][row] + WIDTH)
    begin, end = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (begin, end))
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order]) if len(end) else end
    doc = pack.doc_at(begin)
    new = np.flatnonzero(np.append(True, (begin[1:] > end[:-1]) | (doc[1:] != doc[:-1]))) if len(begin) else order
    return begin[new], end[np.append(new[1:], len(end)) - 1] if len(end) else end


def without(pack: Pack, begin: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """One row per document: ``doc_id, n_bytes, spans, kept``."""
    ids, sizes, spans, kept = [], [], [], []
    first = np.searchsorted(begin, pack.starts).tolist()
    begin, end = begin.tolist(), end.tolist()
    for d, (i, a, b) in enumerate(zip(pack.ids, pack.starts.tolist(), pack.starts[1:].tolist())):
        mine = range(first[d], first[d + 1])
        at, pieces = a, []
        for k in mine:
            pieces.append(pack.body[at : begin[k]])
            at = end[k]
        ids.append(i)
        sizes.append(b - a)
        spans.append([{"start": begin[k] - a, "end": end[k] - a} for k in mine])
        kept.append(b"".join([*pieces, pack.body[at:b]]))
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(span)), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, spans, kept``.

    A byte goes if a WIDTH-byte string over it also starts in a document with a
    smaller id, judged on the input; ``spans`` are the maximal runs of removed
    bytes, ``kept`` the others as binary.

    Steps: documents are packed; keys of anchors that occur in one document only
    are ruled out; contexts of the others, each distinct one once per pack with
    its smallest and largest id, are sorted by key range; the runs of windows
    that a smaller id has go back to the packs. However often a passage occurs,
    a pack sends it once.

    Null text is empty. Ids are integers; a null id is larger than any other.
    Rows of one id remove nothing from each other. Texts shorter than WIDTH stay
    whole. An empty table gives an empty result; further columns are ignored.
    """
    packs = pack_documents(docs, id_col, text_col)
    ranges = range_count(packs)
    found = repeated_keys(packs, ranges, anchor_keys, HOT_USES)

    def pieces_of(pack: int, ids: list, sizes: list, body: bytes, masks: list[dict]) -> Iterator[tuple]:
        e = Entries(Pack(ids, sizes, body), ranges, masks)
        parts, ends = range_bounds(e.keys, ranges)
        for part, a, b in zip(parts.tolist(), ends, ends[1:]):
            yield part, pack, e.rows[a:b].tobytes(), pa.compress(e.texts(a, b), codec="zstd", asbytes=True)

    masked = packs.select("pack", "ids", "sizes", "body").join(found, "pack").select("pack", "ids", "sizes", "body", "found")
    results = asked(masked, ranges, pieces_of, 2, _sorted, 1).withColumnRenamed("found", "results")

    def finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sizes, body, masks, results_ in rows_of(batches):
            pack = Pack(ids, sizes, body)
            none = np.zeros(0, np.int64)
            yield without(pack, *(covered(pack, Entries(pack, ranges, masks), ranges, results_) if results_ else (none, none)))

    known = found.join(results, "pack", "left")
    all_ = packs.join(known, "pack", "left").select("ids", "sizes", "body", "found", "results")
    return all_.mapInArrow(finish, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
