"""Documents packed by megabytes, and questions about keys that many packs share.

Byte-level operators handle millions of small keys per task. They pack
documents into rows of some megabytes, send sorted arrays by key range, and get
answers back, so that Spark moves few, large rows: what a task has for a range
goes as one row, however many packs it comes from, and so do the answers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import bucketed, named, written

#: A pack is closed when it has so many bytes or documents; one longer document is a pack of its own.
PACK_BYTES, PACK_DOCS = 4 << 20, 20_000
#: A key range is settled in one task; there is one for so many bytes of text, and at least LEAST_RANGES.
RANGE_BYTES, LEAST_RANGES = 32 << 20, 256
#: A task gathers so many bytes of its packs' pieces before it sends a row to each range.
UNIT_BYTES = 48 << 20
#: Packs are written once and read three times, so a better level than the fastest pays: 0.36 of the text's size where that has 0.45.
PACK_LEVEL = 5
#: Null ids stand after all others.
NULL_ID = np.iinfo(np.int64).max
#: Bytes of a key that the presence step moves. Keys that agree in these only cost a comparison later.
SHORT = 6


class Pack:
    """The bytes of some documents one after the other; ``starts`` has one entry more than documents."""

    def __init__(self, ids: list, sizes: list[int], body: bytes):
        self.ids = ids
        self.order = np.array([NULL_ID if i is None else i for i in ids], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))]).astype(np.int64)
        self.body = pa.decompress(body, int(self.starts[-1]), codec="zstd", asbytes=True) if self.starts[-1] else b""
        self.bytes = np.frombuffer(self.body, np.uint8)

    def doc_at(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, positions, side="right") - 1


def _packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, n = TaskContext.get().partitionId(), 0
    ids, texts, size = [], [], 0

    def row():
        body = b"".join(texts)
        columns = [[(task << 33) + n], [ids], [[len(t) for t in texts]], [len(body)], [pa.Codec("zstd", compression_level=PACK_LEVEL).compress(body, asbytes=True) if body else b""]]
        kinds = pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["pack", "ids", "sizes", "raw", "body"])

    for batch in batches:
        for i, t in zip(batch.column(0), batch.column(1)):
            ids.append(i.as_py())
            texts.append(t.as_py() or b"")
            size += len(texts[-1])
            if size >= PACK_BYTES or len(ids) >= PACK_DOCS:
                yield row()
                n, ids, texts, size = n + 1, [], [], 0
    if ids:
        yield row()


def pack_documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Written once, so that every later step sees the same packs: ``pack, ids, sizes, raw, body``. Ids are integers."""
    rows = docs.select(named(id_col).cast("long").alias("id"), named(text_col).cast("binary").alias("text"))
    return bucketed(rows.mapInArrow(_packed, "pack long, ids array<long>, sizes array<long>, raw long, body binary"), "pack")


def range_count(packs: DataFrame) -> int:
    return max(LEAST_RANGES, (packs.agg(F.sum("raw")).first()[0] or 0) // RANGE_BYTES)


def range_bounds(keys: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """For sorted keys: the ranges that they fall into, and where each begins (with the end)."""
    at = ((keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
    first = np.flatnonzero(np.diff(at.astype(np.int64), prepend=-1))
    return at[first].astype(np.int64), np.append(first, len(keys))


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows one by one, so that only one large value at a time is copied."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield tuple(c[k].as_py() for c in batch.columns)


def runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows with the same first column, which come together; the key and the other columns."""
    key, rows = None, []
    for k, *row in rows_of(batches):
        if k != key and rows:
            yield key, rows
            rows = []
        key = k
        rows.append(tuple(row))
    if rows:
        yield key, rows


def together(df: DataFrame, key: str, ranges: int) -> DataFrame:
    """Rows of one key come together; with many ranges in as many partitions, so that none grows with the text."""
    dealt = df.repartition(key) if ranges <= LEAST_RANGES else df.repartition(ranges, key)
    return dealt.sortWithinPartitions(key)


def _short(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys).view(np.uint8).reshape(-1, 8)[:, 8 - SHORT :].tobytes()


def _long(short: bytes) -> np.ndarray:
    out = np.zeros((len(short) // SHORT, 8), np.uint8)
    out[:, 8 - SHORT :] = np.frombuffer(short, np.uint8).reshape(-1, SHORT)
    return out.view(np.uint64).ravel()


Piece = tuple  # (pack, bytes, ...)


def _piece_rows(rows: Iterable[tuple[tuple, list[Piece]]], heads: Sequence[str], blobs: int) -> Iterator[pa.RecordBatch]:
    """Rows of two numbers and pieces: the numbers, the pieces' packs, and for each blob the sizes of its pieces and all of them in a row."""
    names = [*heads, "packs", *(x for k in range(blobs) for x in (f"sizes{k}", f"blob{k}"))]
    kinds = [pa.int64()] * len(heads) + [pa.list_(pa.int64())] + [pa.list_(pa.int64()), pa.binary()] * blobs
    for head, pieces in rows:
        row = [*head, [p[0] for p in pieces]]
        for k in range(1, blobs + 1):
            row += [[len(p[k]) for p in pieces], b"".join(p[k] for p in pieces)]
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names)


def _piece_schema(heads: Sequence[str], blobs: int) -> str:
    return ", ".join([*(f"{h} long" for h in heads), "packs array<long>", *(f"sizes{k} array<long>, blob{k} binary" for k in range(blobs))])


def _pieces(packs: list[int], *blobs: list | bytes) -> list[Piece]:
    out: list[list] = [[p] for p in packs]
    for sizes, body in zip(blobs[::2], blobs[1::2]):
        at = 0
        for piece, n in zip(out, sizes):
            piece.append(body[at : at + n])
            at += n
    return [tuple(p) for p in out]


def asked(rows: DataFrame, ranges: int, pieces_of: Callable[..., Iterable[tuple]], blobs: int, answer: Callable[[list[Piece]], list[tuple | None]], answers: int) -> DataFrame:
    """``pack, found``: for each pack the answers that its pieces got, by key range.

    ``pieces_of`` makes (range, pack, bytes, ...) of a row; ``answer`` gets all
    pieces of a range and gives bytes for each, or None. A task sends one row to
    a range for all its packs, up to UNIT_BYTES, and gets one back from it; so
    rows are as many as units times ranges, of kilobytes each up to terabytes of
    text. ``pieces_of`` must give the same whenever it is asked.
    """

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, held = TaskContext.get().partitionId(), 0, 0
        box: dict[int, list[Piece]] = {}
        for row in rows_of(batches):
            for part, *piece in pieces_of(*row):
                box.setdefault(part, []).append(tuple(piece))
                held += sum(map(len, piece[1:]))
            if held >= UNIT_BYTES:
                yield from _piece_rows((((part, (task << 33) + n), box.pop(part)) for part in list(box)), ("part", "unit"), blobs)
                n, held = n + 1, 0
        yield from _piece_rows((((part, (task << 33) + n), box.pop(part)) for part in list(box)), ("part", "unit"), blobs)

    def settle(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows_ in runs(batches):
            units = [(unit, _pieces(*columns)) for unit, *columns in rows_]
            got = iter(answer([p for _, pieces in units for p in pieces]))
            back = [(unit, [(p[0], *a) for p in pieces if (a := next(got)) is not None]) for unit, pieces in units]
            yield from _piece_rows((((unit, part), pieces) for unit, pieces in back if pieces), ("unit", "part"), answers)

    def give(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [("part", pa.int64()), *((f"a{k}", pa.binary()) for k in range(answers))]
        for _, rows_ in runs(batches):
            by_pack: dict[int, list[dict]] = {}
            for part, *columns in rows_:
                for pack, *data in _pieces(*columns):
                    by_pack.setdefault(pack, []).append({"part": part} | {f"a{k}": d for k, d in enumerate(data)})
            for pack in sorted(by_pack):
                yield pa.RecordBatch.from_arrays([pa.array([pack], pa.int64()), pa.array([by_pack.pop(pack)], pa.list_(pa.struct(fields)))], ["pack", "found"])

    questions = rows.mapInArrow(emit, _piece_schema(("part", "unit"), blobs))
    solved = together(questions, "part", ranges).mapInArrow(settle, _piece_schema(("unit", "part"), answers))
    fields = ",".join(["part:long", *(f"a{k}:binary" for k in range(answers))])
    return written(together(solved, "unit", ranges).mapInArrow(give, f"pack long, found array<struct<{fields}>>"))


def repeated_keys(packs: DataFrame, ranges: int, keys_of: Callable[[Pack], tuple[np.ndarray, np.ndarray, np.ndarray]], hot_uses: int = 1 << 62) -> DataFrame:
    """``pack, found``: bit masks over the pack's sorted distinct keys, by key range.

    The first marks keys that two packs have, or one pack in two documents; the
    second those with more than ``hot_uses`` uses. ``keys_of`` gives the keys,
    which of them several documents of the pack have, and how often each is used.
    """

    def pieces_of(pack: int, ids: list, sizes: list, body: bytes) -> Iterator[tuple]:
        keys, several, uses = keys_of(Pack(ids, sizes, body))
        weight = np.ceil(np.log2(np.maximum(uses, 1))).astype(np.uint8)  # as a power of two, rounded up
        parts, ends = range_bounds(keys, ranges)
        for part, a, b in zip(parts.tolist(), ends, ends[1:]):
            yield part, pack, _short(keys[a:b]), np.packbits(several[a:b]).tobytes(), weight[a:b].tobytes()

    def present(pieces: list[Piece]) -> list[tuple]:
        sizes = [len(w) for *_, w in pieces]
        keys = np.concatenate([_long(k) for _, k, _, _ in pieces])
        several = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=n) for (_, _, m, _), n in zip(pieces, sizes)]).astype(bool)
        uses = np.int64(1) << np.frombuffer(b"".join(w for *_, w in pieces), np.uint8).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        begins = np.flatnonzero(np.append(True, keys[order][1:] != keys[order][:-1]))
        size = np.diff(np.append(begins, len(keys)))
        again, hot = np.empty(len(keys), bool), np.empty(len(keys), bool)
        again[order] = np.repeat(size > 1, size)
        hot[order] = np.repeat(np.add.reduceat(uses[order], begins) > hot_uses, size)
        ends = np.cumsum(sizes).tolist()
        return [tuple(np.packbits(x[e - n : e]).tobytes() for x in (again | several, hot)) for e, n in zip(ends, sizes)]

    return asked(packs.select("pack", "ids", "sizes", "body"), ranges, pieces_of, 3, present, 2)


def unmask(keys: np.ndarray, ranges: int, found: list[dict] | None, which: int = 0) -> np.ndarray:
    """A mask of :func:`repeated_keys` as one boolean for each key."""
    parts, ends = range_bounds(keys, ranges)
    masks = {f["part"]: f[f"a{which}"] for f in found or ()}
    pieces = [np.unpackbits(np.frombuffer(masks[p], np.uint8), count=b - a) for p, a, b in zip(parts.tolist(), ends, ends[1:])]
    return np.concatenate(pieces).astype(bool) if pieces else np.zeros(0, bool)
