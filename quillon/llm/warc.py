"""WARC records in ZIP archives, read by range without extraction.

An archive holds stored members: records, each a gzip member of its own, and a
CDXJ index of where each record begins. A reader parses the central directory
(of ZIP64 where there is one), finds the members, and reads records by their
offsets in the file. It takes archives of others too: several members of
records, indexes by any name, packed or not, or none.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import named, shared_folder, written

#: Equal payloads of so many bytes are stored once.
LEAST_REVISIT = 1000
#: An archive is closed at so many bytes; a reader takes so many bytes of records at once, and a task so many in all.
ARCHIVE_BYTES, READ_BYTES, TASK_BYTES = 64 << 20, 1 << 20, 8 << 20
#: Fixed names and texts of the format.
RECORDS, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE, STAMP = "2000-01-01T00:00:00Z", "20000101000000"
_BIG = 0xFFFFFFFF


def record(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None, revisit: bool) -> bytes:
    """One uncompressed WARC record. A revisit has the HTTP head only, with the full payload's length."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    uri = "".join(c if " " < c < "\x7f" or c > "\x9f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{_name(page_id)}>", f"WARC-Target-URI: {uri}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{sha1}"]
    if revisit:
        lines += [f"WARC-Refers-To: <urn:page:{_name(refers_to)}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def _name(page_id: int | None) -> str:
    return "none" if page_id is None else str(page_id)


def _fields(head: bytes) -> dict[str, str]:
    lines = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in lines}


def _page(record_id: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?[0-9]+)>", record_id or "")
    return int(m[1]) if m else None


def _agrees(label: str | None, payload: bytes) -> bool:
    """Whether a digest such as ``sha1:`` with hexadecimal or base-32 digits is that of the payload; unknown kinds agree."""
    kind, _, value = (label or "").partition(":")
    if kind.lower() not in ("sha1", "sha256", "md5"):
        return True
    found = hashlib.new(kind.lower(), payload).digest()
    return value.lower() == found.hex() or value.upper().rstrip("=") == base64.b32encode(found).decode().rstrip("=")


#: A record that cannot be read: all but ``damaged`` is null.
DAMAGED = dict.fromkeys(("page_id", "record_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "refers_to_record", "payload")) | {"damaged": True}


def parse(raw: bytes) -> dict:
    """A record's parts. Length and SHA-1 of a payload that is there come from its bytes; ``damaged`` says that its digest disagrees or its end is missing."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    f = _fields(head)
    if "warc-type" not in f or not f.get("content-length", "").isdigit():
        return DAMAGED
    block = rest[: int(f["content-length"])]
    kind, url = f["warc-type"], f.get("warc-target-uri")
    out = {"page_id": _page(f.get("warc-record-id")), "record_id": f.get("warc-record-id"), "url": url and url.removeprefix("<").removesuffix(">"), "record_type": kind}
    out |= {"refers_to": _page(f.get("warc-refers-to")), "refers_to_record": f.get("warc-refers-to"), "damaged": len(block) < int(f["content-length"])}
    http, payload = b"", block
    if f.get("content-type", "").replace(" ", "").lower().startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
    if kind == "revisit":
        length = _fields(http).get("content-length", "")
        return out | {"payload_bytes": int(length) if length.isdigit() else None, "payload_digest": (f.get("warc-payload-digest") or "").removeprefix("sha1:") or None, "payload": None}
    out["damaged"] |= not _agrees(f.get("warc-payload-digest"), payload)
    return out | {"payload_bytes": len(payload), "payload_digest": hashlib.sha1(payload).hexdigest(), "payload": payload}


def url_key(url: str | None) -> str:
    """The host's parts in reverse, then the path, in lower case: what an index is sorted by. Without a host it is ``-``."""
    m = re.match(r"(?s)[^:/?#]+://(?:[^/?#@]*@)?([^/?#:]*)[^/?#]*(.*)", url or "")
    if not m:
        return "-"
    key = ",".join(reversed(m[1].lower().split("."))) + ")" + (m[2].partition("#")[0].lower() or "/")
    return re.sub(r"\s", lambda c: "".join(f"%{b:02x}" for b in c[0].encode()), key)


def index_line(url: str | None, sha1: str, revisit: bool, offset: int, length: int) -> str:
    """A line of a CDXJ index: key, time stamp, JSON."""
    about = {"url": url or "", "mime": "warc/revisit" if revisit else "text/html", "status": "200", "digest": f"sha1:{sha1}"}
    about |= {"length": str(length), "offset": str(offset), "filename": RECORDS.rpartition("/")[2]}
    return f"{url_key(url)} {STAMP} {json.dumps(about)}\n"


def index_entries(data: bytes) -> list[tuple[str, int, int]]:
    """(file name, offset, length) of each line of an index that has them; other lines are left out."""
    if data[:2] == b"\x1f\x8b":
        plain = b""
        while data[:2] == b"\x1f\x8b":  # a member each so many lines
            unpack = zlib.decompressobj(31)
            plain += unpack.decompress(data)
            data = unpack.unused_data
        data = plain
    out = []
    for line in data.decode("utf-8", "replace").splitlines():
        about = line[line.find("{") :] if "{" in line else ""
        try:
            found = json.loads(about)
            out.append((str(found["filename"]).rpartition("/")[2], int(found["offset"]), int(found["length"])))
        except (ValueError, KeyError, TypeError):
            continue
    return out


def scanned(read: Callable[[int, int], bytes], at: int, size: int, piece: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """(offset, length) of each gzip member between ``at`` and ``at + size``, for archives without an index."""
    begin, pos, end, unpack = at, at, at + size, zlib.decompressobj(31)
    while pos < end:
        data = read(pos, min(piece, end - pos))
        pos += len(data)
        while data:
            try:
                unpack.decompress(data)
            except zlib.error:
                return
            if not unpack.eof:
                break
            data = unpack.unused_data
            yield begin - at, pos - len(data) - begin
            begin, unpack = pos - len(data), zlib.decompressobj(31)


def zip_stored(members: list[tuple[str, list[bytes]]], zip64: bool = False) -> Iterator[bytes]:
    """The bytes of a ZIP archive of stored members; in ZIP64 form where sizes ask for it, or always."""
    at, entries = 0, []
    for name, parts in members:
        size, crc = sum(map(len, parts)), 0
        for p in parts:
            crc = zlib.crc32(p, crc)
        big = zip64 or size >= _BIG
        extra = struct.pack("<HHQQ", 1, 16, size, size) if big else b""
        short = _BIG if big else size
        head = struct.pack("<IHHHHHIIIHH", 0x04034B50, 45 if big else 20, 0x800, 0, 0, 33, crc, short, short, len(name.encode()), len(extra)) + name.encode() + extra
        entries.append((name.encode(), size, crc, at))
        yield head
        yield from parts
        at += len(head) + size
    begin = at
    for name, size, crc, offset in entries:
        wide = [v for v in (size, size, offset) if zip64 or v >= _BIG]
        extra = struct.pack(f"<HH{len(wide)}Q", 1, 8 * len(wide), *wide) if wide else b""
        cap = lambda v: _BIG if zip64 or v >= _BIG else v
        head = struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45, 0x800, 0, 0, 33, crc, cap(size), cap(size), len(name), len(extra), 0, 0, 0, 0, cap(offset))
        yield head + name + extra
        at += len(head) + len(name) + len(extra)
    n, length = len(entries), at - begin
    if zip64 or at >= _BIG or n >= 0xFFFF:
        yield struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, n, n, length, begin) + struct.pack("<IIQI", 0x07064B50, 0, at, 1)
        yield struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, 0xFFFF, 0xFFFF, _BIG, _BIG, 0)
    else:
        yield struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, n, n, length, begin, 0)


def zip_members(read: Callable[[int, int], bytes], size: int) -> dict[str, tuple[int, int, int]]:
    """Of each member: 0 if it is stored, 8 if deflated; where its data begins, and their length. ``read`` takes offset and length."""
    tail = read(max(0, size - 65_557), min(size, 65_557))  # the end record, behind at most 65,535 bytes of comment
    at = tail.rfind(b"PK\5\6")
    if at < 0:
        raise ValueError("no ZIP archive: it has no end record")
    count, length, begin = struct.unpack_from("<HII", tail, at + 10)
    end = max(0, size - 65_557) + at
    if count == 0xFFFF or _BIG in (length, begin):
        sign, _, where, _ = struct.unpack("<IIQI", read(end - 20, 20))
        if sign != 0x07064B50:
            raise ValueError("ZIP64 archive without a locator")
        sign, _, _, _, _, _, _, count, length, begin = struct.unpack("<IQHHIIQQQQ", read(where, 56))
        if sign != 0x06064B50:
            raise ValueError("ZIP64 archive without its end record")
    directory, out, p = read(begin, length), {}, 0
    for _ in range(count):
        sign, _, _, _, method, _, _, _, packed, plain, name, extra, comment, _, _, _, offset = struct.unpack_from("<IHHHHHHIIIHHHHHII", directory, p)
        if sign != 0x02014B50:
            raise ValueError("ZIP directory is damaged")
        title = directory[p + 46 : p + 46 + name].decode("utf-8", "replace")
        q, stop = p + 46 + name, p + 46 + name + extra
        while q + 4 <= stop:
            kind, n = struct.unpack_from("<HH", directory, q)
            if kind == 1:  # only what did not fit stands here, in this order
                wide = iter(struct.unpack_from(f"<{n // 8}Q", directory, q + 4))
                plain = next(wide) if plain == _BIG else plain
                packed = next(wide) if packed == _BIG else packed
                offset = next(wide) if offset == _BIG else offset
            q += 4 + n
        p = stop + comment
        local_name, local_extra = struct.unpack("<HH", read(offset + 26, 4))
        out[title] = (method, offset + 30 + local_name + local_extra, packed)
    return out


def stored_members(read: Callable[[int, int], bytes], size: int) -> dict[str, tuple[int, int]]:
    """Where the data of each stored member begins, and its length; compressed members are left out."""
    return {k: (at, n) for k, (method, at, n) in zip_members(read, size).items() if method == 0}


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    """Hadoop's spellings of a scheme are not all Arrow's."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", re.sub(r"^s3[an]://", "s3://", uri)))


def with_verdicts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, payload, sha1, refers_to, revisit`` for each page; equal payloads merge before they are shuffled."""
    rows = pages.select(named(id_col).cast("long").alias("page_id"), named(url_col).alias("url"), F.coalesce(named(html_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.select("*", F.sha1("payload").alias("sha1"), F.unhex(F.sha2("payload", 256)).alias("same"))
    groups = rows.where(F.length("payload") >= LEAST_REVISIT).groupBy("same").agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("n"))
    groups = written(groups.where("n > 1").select(F.col("same").alias("of"), "top", "n"))  # so that the join may split a payload of many pages
    found = rows.join(groups, F.col("same") == F.col("of"), "left")
    revisit = F.col("n").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))
    return found.select("page_id", "url", "payload", "sha1", F.when(revisit, F.col("top")).alias("refers_to"), revisit.alias("revisit"))


def write_archives(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", zip64: bool = False) -> DataFrame:
    """Writes a record for each page and returns ``path, n_records, n_bytes`` of the archives.

    ``folder`` is one that all executors reach; without it, one in the shared
    folder. Tasks write archives under names of their own, and only those of
    tasks that succeed are returned, so a task may run again.

    Of equal payloads of LEAST_REVISIT bytes or more, the one with the largest
    id is a response and the others revisit it; repeated rows share their
    verdict. Null html is empty, a null id smaller than any other; of equal
    payloads without any id, all are responses. An empty table makes no archive;
    further columns are ignored.
    """
    folder = folder or f"{shared_folder(pages.sparkSession)}/warc"

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, index, size = [], [], 0

        def close() -> pa.RecordBatch:
            uri = f"{folder}/{uuid.uuid4().hex}.wacz"
            system, path = _open(uri)
            system.create_dir(path.rpartition("/")[0], recursive=True)
            n = 0
            with system.open_output_stream(path) as out:
                for piece in zip_stored([(RECORDS, parts), (INDEX, ["".join(sorted(index)).encode()])], zip64):
                    out.write(piece)
                    n += len(piece)
            return pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([len(index)]), pa.array([n])], ["path", "n_records", "n_bytes"])

        for batch in batches:
            for row in zip(*batch.columns):
                packer = zlib.compressobj(3, zlib.DEFLATED, 31)
                data = packer.compress(record(*(v.as_py() for v in row))) + packer.flush()
                index.append(index_line(row[1].as_py(), row[3].as_py(), row[5].as_py(), size, len(data)))
                parts.append(data)
                size += len(data)
                if size >= ARCHIVE_BYTES:
                    yield close()
                    parts, index, size = [], [], 0
        if parts:
            yield close()

    rows = with_verdicts(pages, id_col, url_col, html_col)
    return written(rows.mapInArrow(emit, "path string, n_records long, n_bytes long"))


def located(read: Callable[[int, int], bytes], size: int) -> list[tuple[int, int]]:
    """Offset in the file and length of every record of an archive: those that an index names, and all of a member of records that none names."""
    members = zip_members(read, size)
    base = {k.rpartition("/")[2]: v for k, v in members.items() if re.search(r"\.warc(\.gz)?$", k) and v[0] == 0}
    found: dict[str, list] = {k: [] for k in base}
    for name, (method, at, n) in members.items():
        if re.search(r"\.cdxj?(\.gz)?$", name) and method in (0, 8):
            data = read(at, n)
            for file, offset, length in index_entries(zlib.decompress(data, -15) if method else data):
                if file in base and 0 <= offset and offset + length <= base[file][2]:
                    found[file].append((base[file][1] + offset, length))
    for k, (_, at, n) in base.items():
        found[k] = found[k] or [(at + offset, length) for offset, length in scanned(read, at, n)]
    return sorted({x for records in found.values() for x in records})


def _ranges(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Archive paths to stretches of records: (path, offset in the file, offsets from there, lengths)."""
    for batch in batches:
        for uri in batch.column(0).to_pylist():
            system, path = _open(uri)
            with system.open_input_file(path) as f:
                rows = located(lambda at, n: f.read_at(n, at), f.size())
            out, k = [], 0
            while k < len(rows):
                first, offsets, lengths = rows[k][0], [], []
                while k < len(rows) and (not lengths or rows[k][0] + rows[k][1] - first <= READ_BYTES):
                    offsets.append(rows[k][0] - first)
                    lengths.append(rows[k][1])
                    k += 1
                out.append((uri, first, offsets, lengths))
            kinds = pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], kind) for j, kind in enumerate(kinds)], ["path", "offset", "offsets", "lengths"])


def _record(data: bytes) -> dict:
    try:
        return parse(zlib.decompress(data, 31) if data[:2] == b"\x1f\x8b" else data)
    except zlib.error:  # its check sum disagrees, too
        return DAMAGED


def read_archives(spark: SparkSession, archives: DataFrame, payloads: bool = True) -> DataFrame:
    """Records of ``archives`` (path, n_bytes): ``page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload, record_id, refers_to_record, damaged``.

    Indexes are read first, then stretches of records by range, in tasks of
    their own however large an archive is. A member of records that no index
    names is scanned. ``payload`` is null for revisits, and for all without
    ``payloads``; ``page_id`` and ``refers_to`` are null in archives of others,
    whose records are named by ``record_id``.

    Records are held against the check sum of their gzip member and their
    payload digest: one that is cut off, disagrees or is no record gives a row
    with ``damaged``. A file that is no ZIP archive is an error; a null path or
    size is none; an empty table gives an empty result; further columns are
    ignored.
    """
    kinds = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary(), "record_id": pa.string(), "refers_to_record": pa.string(), "damaged": pa.bool_()}

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, offset, offsets, lengths in zip(*(c.to_pylist() for c in batch.columns)):
                system, path = _open(uri)
                with system.open_input_file(path) as f:
                    data = f.read_at(max(a + n for a, n in zip(offsets, lengths)), offset)
                out = [_record(data[a : a + n]) for a, n in zip(offsets, lengths)]
                if not payloads:
                    out = [r | {"payload": None} for r in out]
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in kinds.items()], list(kinds))

    # rows that stand for much work are small: without a number, Spark would put them all into one task
    tasks = (archives.agg(F.sum("n_bytes")).first()[0] or 0) // TASK_BYTES + 1
    stretches = archives.select("path").where("path is not null").repartition(tasks, "path").mapInArrow(_ranges, "path string, offset long, offsets array<long>, lengths array<long>").repartition(tasks, "path", "offset")
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, record_id string, refers_to_record string, damaged boolean"
    return stretches.mapInArrow(emit, schema)
