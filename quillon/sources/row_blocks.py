"""Row-block files: fixed-size blocks of packed rows, the row count in a block's last two bytes.

Int and long are little-endian, float and double IEEE little-endian, strings
UTF-8 and end with a zero byte. Rows do not cross blocks.
"""

from __future__ import annotations

import struct
from collections.abc import Collection, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

_FIXED = {T.IntegerType(): "<i", T.LongType(): "<q", T.FloatType(): "<f", T.DoubleType(): "<d"}


#: Blocks that are decoded together, by bytes.
BATCH_BYTES = 8 << 20


def _gathered(flat: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of stretches one after the other, and where each begins in them (with the end)."""
    ends = np.append(0, np.cumsum(size))
    return flat[np.repeat(at - ends[:-1], size) + np.arange(ends[-1])], ends


def _strings(flat: np.ndarray, at: np.ndarray, end: np.ndarray) -> pa.Array:
    data, ends = _gathered(flat, at, end - at)
    out = pa.StringArray.from_buffers(len(at), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data))
    try:
        out.validate(full=True)
    except pa.ArrowInvalid:  # bytes that are no UTF-8 become replacement characters
        body = flat.tobytes()
        out = pa.array([body[a:b].decode("utf-8", "replace") for a, b in zip(at.tolist(), end.tolist())], pa.string())
    return out


def decode_blocks(data: bytes, block_size: int, kinds: list[T.DataType], wanted: Collection[int] | None = None) -> list[pa.Array]:
    """The wanted columns (by number; all without it) of whole blocks, rows in order. NaN and infinities are values like others.

    All blocks are decoded at the same time, one row of each per step.
    """
    flat = np.frombuffer(data, np.uint8)
    blocks = len(flat) // block_size
    wanted = range(len(kinds)) if wanted is None else sorted(wanted)
    starts = np.arange(blocks) * block_size
    count = flat[starts + block_size - 2].astype(np.int64) | flat[starts + block_size - 1].astype(np.int64) << 8
    zero = np.zeros(0, np.int64)
    if any(k not in _FIXED for k in kinds):
        zeros = np.flatnonzero(flat == 0)
        zero = np.append(zeros, len(flat))
    found: dict[int, list] = {k: [] for k in wanted}
    live, at = np.flatnonzero(count > 0), starts[count > 0]
    row, block_of = 0, []
    while len(live):
        block_of.append(live)
        for k, kind in enumerate(kinds):
            if kind in _FIXED:
                if k in found:
                    found[k].append(at)
                at = at + struct.calcsize(_FIXED[kind])
            else:
                end = zero[np.searchsorted(zero, at)]
                if k in found:
                    found[k].append((at, end))
                at = end + 1
        if (at > starts[live] + block_size - 2).any():
            raise ValueError("a row-block file has a row that passes its block's end; is the block size right?")
        row += 1
        on = count[live] > row
        live, at = live[on], at[on]
    if not block_of:
        return [pa.array([], pa.string() if kinds[k] not in _FIXED else pa.from_numpy_dtype(_FIXED[kinds[k]])) for k in wanted]
    order = np.argsort(np.concatenate(block_of), kind="stable")  # by block, then row
    out = []
    for k in wanted:
        if kinds[k] in _FIXED:
            size = struct.calcsize(_FIXED[kinds[k]])
            places = np.concatenate(found[k])[order]
            out.append(pa.array(np.ascontiguousarray(flat[places[:, None] + np.arange(size)]).view(_FIXED[kinds[k]]).ravel()))
        else:
            out.append(_strings(flat, *(np.concatenate([x[j] for x in found[k]])[order] for j in (0, 1))))
    return out


def encode_rows(rows: Iterable[tuple], kinds: list[T.DataType], block_size: int) -> bytes:
    """Blocks of the rows, as many to a block as fit. A row that fits in none, or has a null or a zero byte in a string, is an error."""
    out, body, count = [], b"", 0

    def close() -> bytes:
        return body.ljust(block_size - 2, b"\0") + struct.pack("<H", count)

    for row in rows:
        parts = []
        for v, kind in zip(row, kinds):
            if v is None or kind not in _FIXED and "\0" in v:
                raise ValueError(f"row-block files cannot hold {v!r}")
            parts.append(struct.pack(_FIXED[kind], v) if kind in _FIXED else v.encode() + b"\0")
        packed = b"".join(parts)
        if len(packed) > block_size - 2:
            raise ValueError(f"a row of {len(packed)} bytes does not fit a block of {block_size}")
        if len(body) + len(packed) > block_size - 2 or count == 0xFFFF:
            out.append(close())
            body, count = b"", 0
        body += packed
        count += 1
    return b"".join([*out, close()] if count else out)


def read_row_blocks(spark: SparkSession, path: str, schema: T.StructType, block_size: int, columns: Collection[str] | None = None) -> DataFrame:
    """A file, or folder of files, of such blocks. Files are split at blocks, so one large file is read by many tasks.

    With ``columns`` only those are decoded, in the order of the schema. A file
    that is no whole number of blocks is an error, found by the task that reads
    its end.
    """
    for f in schema.fields:
        if f.dataType not in _FIXED and not isinstance(f.dataType, T.StringType):
            raise TypeError(f"row-block files have no {f.dataType.simpleString()} ({f.name})")
    kinds = [f.dataType for f in schema.fields]
    wanted = [k for k, f in enumerate(schema.fields) if columns is None or f.name in columns] or [0]
    read = T.StructType([schema.fields[k] for k in wanted])
    arrow = to_arrow_schema(read)

    def joined(blocks: Iterable[bytes]) -> Iterator[tuple[bytearray]]:
        some = bytearray()
        for b in blocks:
            some += b
            if len(some) >= BATCH_BYTES:
                yield (some,)
                some = bytearray()
        if some:
            yield (some,)

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                found = decode_blocks(data.as_py(), block_size, kinds, wanted)
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(found, arrow)], schema=arrow)

    blocks = spark.sparkContext.binaryRecords(path, block_size).mapPartitions(joined)
    return spark.createDataFrame(blocks, "block binary").mapInArrow(decode, read)
