import io
import json
import os
import struct
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import types as T

from quillon import Catalog, Filter, Predicate, Project, Scan, Sort, SortKey, compile_query
from quillon.plans.codec import to_json
from quillon.sources import read_row_blocks, write_rows
from quillon.sources.row_blocks import decode_blocks, encode_rows

SCHEMA = T.StructType().add("i", "integer").add("n", "long").add("f", "float").add("d", "double").add("s", "string")
ROWS = [(k, 2**53 + k, 0.5 * k, k / 3, "é" * (k % 30)) for k in range(500)] + [(-1, -(2**63), float("inf"), float("-inf"), "")]
KINDS = [f.dataType for f in SCHEMA.fields]


def test_row_blocks(spark, tmp_path):
    data = encode_rows(ROWS, KINDS, 256)
    assert len(data) % 256 == 0 and len(data) > 40 * 256
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "part").write_bytes(data)
    df = read_row_blocks(spark, str(tmp_path / "t"), SCHEMA, 256)
    assert df.schema == SCHEMA and sorted(map(tuple, df.collect())) == sorted(ROWS)
    config = {"tables": [{"name": "t", "path": str(tmp_path / "t"), "format": "row_blocks", "block_size": 256, "columns": [{"name": f.name, "type": f.dataType.simpleString()} for f in SCHEMA.fields]}]}
    got = compile_query(Filter(Scan("t"), (Predicate("i", "<", 3),)), Catalog.from_config(spark, config))
    assert sorted(r.i for r in got.collect()) == [-1, 0, 1, 2]
    # only named columns are decoded, where a projection says what is asked for
    catalog = Catalog.from_config(spark, config)
    some = compile_query(Project(Filter(Scan("t"), (Predicate("i", "<", 3),)), (("s", "s"),)), catalog)
    assert sorted(r.s for r in some.collect()) == sorted(s for i, *_, s in ROWS if i < 3)
    assert catalog.table("t", {"s", "i"}).columns == ["i", "s"] and read_row_blocks(spark, str(tmp_path / "t"), SCHEMA, 256, columns=()).count() == len(ROWS)
    (tmp_path / "t" / "part").write_bytes(data[:-100])
    with pytest.raises(Exception):
        read_row_blocks(spark, str(tmp_path / "t"), SCHEMA, 256).collect()


def one_by_one(block):
    """The rows of a block, value by value."""
    rows, at = [], 0
    for _ in range(struct.unpack_from("<H", block, len(block) - 2)[0]):
        row = []
        for form in ("<i", "<q", "<f", "<d"):
            row.append(struct.unpack_from(form, block, at)[0])
            at += struct.calcsize(form)
        end = block.index(b"\0", at)
        rows.append((*row, block[at:end].decode("utf-8", "replace")))
        at = end + 1
    return rows


def test_blocks_decode_as_value_by_value():
    rows = [(k * 256, k << 40, 0.25 * k, -k / 7, "aé\u20ac"[: k % 4] * (k % 11)) for k in range(300)]
    data = encode_rows(rows, KINDS, 200)
    data += encode_rows(rows[:1], KINDS, 200).replace(struct.pack("<d", 0.0) + b"\0", struct.pack("<d", 0.0) + b"\xff\xfe\0", 1)[:200].ljust(200, b"\0")
    blocks = [data[k : k + 200] for k in range(0, len(data), 200)]
    blocks[-1] = blocks[-1][:198] + struct.pack("<H", 1)
    want = [r for b in blocks for r in one_by_one(b)]
    found = decode_blocks(b"".join(blocks), 200, KINDS)
    assert list(zip(*(c.to_pylist() for c in found))) == want
    assert decode_blocks(b"".join(blocks), 200, KINDS, [4, 0])[1].to_pylist() == [r[4] for r in want]


def test_row_block_limits(spark):
    assert encode_rows([], KINDS, 64) == b""
    assert [c.to_pylist() for c in decode_blocks(b"x" * 6 + struct.pack("<H", 0), 8, KINDS)] == [[], [], [], [], []]
    with pytest.raises(ValueError):
        decode_blocks(b"x" * 62 + struct.pack("<H", 9), 64, KINDS[:4])
    for bad in ((1, 1, 1.0, 1.0, None), (1, 1, 1.0, 1.0, "a\0b"), (1, 1, 1.0, 1.0, "x" * 300)):
        with pytest.raises(ValueError):
            encode_rows([bad], KINDS, 256)
    with pytest.raises(TypeError):
        read_row_blocks(spark, "none", T.StructType().add("b", "boolean"), 64)


def test_write_rows(spark):
    c = Catalog(spark, tables={"t": spark.createDataFrame([(2, 1.0), (1, 0.25), (3, None)], "k int, v double")})
    out = io.StringIO()
    assert write_rows(compile_query(Sort(Scan("t"), (SortKey("k", False),)), c), out) == 3
    assert out.getvalue() == "validate\n3||\n2|1.0|\n1|0.25|\n!\n"


def test_config(spark):
    tables = [{"name": "n", "path": "/root/testdata/sf0.001/nation.parquet", "columns": [{"name": "n_name", "type": "string"}]}]
    assert Catalog.from_config(spark, json.dumps({"tables": tables})).table("n").columns == ["n_name"]
    with pytest.raises(ValueError):
        Catalog.from_config(spark, {"tables": [{"name": "n", "path": "x", "format": "csv"}]})


def test_command_line(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"tables": [{"name": "region", "path": "/root/testdata/sf0.001/region.parquet"}]}))
    query = Project(Sort(Scan("region"), (SortKey("r_name"),)), (("r_name", "r"), ("r_regionkey", "k")))
    root = str(Path(__file__).resolve().parents[1])
    run = subprocess.run([sys.executable, "-m", "quillon", "--config", str(tmp_path / "c.json")], input=to_json(query), capture_output=True, text=True, cwd=root, env=os.environ | {"PYTHONPATH": root}, timeout=300)
    lines = run.stdout.splitlines()
    assert lines[lines.index("validate") :] == ["validate", "AFRICA|0|", "AMERICA|1|", "ASIA|2|", "EUROPE|3|", "MIDDLE EAST|4|", "!"]
