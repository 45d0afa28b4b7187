import hashlib
import random

import numpy as np
import pyarrow.parquet as pq
import pytest

from quillon.llm import packs, registry, suffix_sort
from quillon.llm import suffix_dedup as suffix
from quillon.llm.suffix_dedup import WIDTH, suffix_dedup
from quillon.llm.suffix_sort import BlindTrie, deep_shallow, multikey_quicksort


@pytest.mark.parametrize("seed", range(6))
def test_deep_shallow(seed):
    rnd = random.Random(seed)
    flat = bytes(rnd.choice(b"ab") for _ in range(2000)) + b"ab" * 400 + b"\0\xff" * 50
    flat = np.frombuffer(flat * 2 + bytes(100), np.uint8)
    starts = np.array([rnd.randrange(len(flat) - 100) for _ in range(3000)])
    for width, shallow in ((50, 24), (50, 0), (50, 8), (24, 24), (13, 24), (51, 16)):
        order, same = deep_shallow(flat, starts, width, shallow)
        got = [flat[s : s + width].tobytes() for s in starts[order]]
        assert sorted(order) == list(range(len(starts))) and got == sorted(got)
        assert same.tolist() == [k > 0 and got[k] == got[k - 1] for k in range(len(got))]
    order, same = deep_shallow(flat, np.zeros(0, np.int64), 50)
    assert len(order) == len(same) == 0


def test_blind_trie():
    rnd = random.Random(2)
    strings = [bytes(rnd.choice(b"ab\0") for _ in range(9)) for _ in range(300)]
    got = BlindTrie(strings).order()
    assert [strings[g[0]] for g in got] == sorted(set(strings))
    assert sorted(k for g in got for k in g) == list(range(300)) and all(len({strings[k] for k in g}) == 1 for g in got)
    assert BlindTrie([b"x"]).order() == [[0]]


def test_multikey_quicksort_ties_are_the_shared_prefixes():
    rnd = random.Random(4)
    flat = np.frombuffer(bytes(rnd.choice(b"ab") for _ in range(3000)), np.uint8)
    starts = np.array([rnd.randrange(2900) for _ in range(2000)])
    for width in (0, 3, 8, 12, 24):
        order, head = multikey_quicksort(flat, starts, width)
        got = [flat[s : s + width].tobytes() for s in starts[order]]
        assert got == sorted(got) and [got.index(x) for x in got] == head.tolist()


@pytest.mark.parametrize("part", ["trie", "quicksort"])
def test_the_sort_decides(spark, monkeypatch, part):
    """Without the order that either half of the sort makes, copies are no neighbours and stay."""
    # of one key, in turn: contexts that agree before the anchor and in 20 bytes after it
    texts = [b"x" * 30 + (b"a" if k % 2 else b"b") * 30 for k in range(8)]
    rows, body = np.zeros(8, suffix._ENTRY), b"".join(texts) + bytes(200)
    rows["size"], rows["lead"], rows["low"], rows["high"], rows["key"] = 60, 10, np.arange(8), np.arange(8), 5
    assert {(r["entry"], r["low"]) for r in suffix._smallest(rows, body)} == {(k, k % 2) for k in range(2, 8)}
    if part == "trie":
        monkeypatch.setattr(suffix_sort.BlindTrie, "order", lambda self: [[k] for k in range(len(self.strings))])
    else:
        monkeypatch.setattr(suffix_sort, "multikey_quicksort", lambda flat, starts, width: (np.arange(len(starts)), np.arange(len(starts))))
    assert len(suffix._smallest(rows, body)) == 0


def brute(docs):
    lows = {}
    key = lambda i: float("inf") if i is None else i
    bodies = [(i, t.encode() if isinstance(t, str) else t or b"") for i, t in docs]
    for i, t in bodies:
        for p in range(len(t) - WIDTH + 1):
            w = hash(t[p : p + WIDTH])
            if lows.get(w, float("inf")) >= key(i):
                lows[w] = key(i)
    out = []
    for i, t in bodies:
        gone = bytearray(len(t))
        for p in range(len(t) - WIDTH + 1):
            if lows[hash(t[p : p + WIDTH])] < key(i):
                gone[p : p + WIDTH] = b"\1" * WIDTH
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def digests(df):
    return [tuple(r) for r in registry.removal_digests(df).collect()]


def same(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_against_brute_force(spark, sf, monkeypatch):
    if sf == "sf0.001":
        monkeypatch.setattr(packs, "RANGE_BYTES", 10_000)
    docs = [(r["doc_id"], r["text"]) for r in pq.read_table(f"/root/testdata/{sf}/documents.parquet", columns=["doc_id", "text"]).to_pylist()]
    got = [tuple(r) for r in registry.QUERIES["op1_suffix_dedup"](spark, f"/root/testdata/{sf}").collect()]
    same(got, brute(docs))


@pytest.mark.parametrize("seed", range(4))
def test_random(spark, seed, monkeypatch):
    monkeypatch.setattr(packs, "RANGE_BYTES", 2000)
    monkeypatch.setattr(packs, "UNIT_BYTES", 3000)
    monkeypatch.setattr(suffix, "SORT_CONTEXTS", 7)
    if seed > 1:
        monkeypatch.setattr(suffix, "HOT_USES", 4 - seed)  # some keys, or all that are used twice
    rnd = random.Random(seed)
    letters = "ab" if seed % 2 else "abcdefgh é\n"
    piece = lambda n: "".join(rnd.choice(letters) for _ in range(n))
    pool = [piece(rnd.choice([30, 49, 50, 51, 80, 200])) for _ in range(8)] + ["x" * 120, "yz" * 60]
    docs = [(rnd.choice([k, k, None]), "".join(rnd.choice([rnd.choice(pool), piece(rnd.randint(0, 60))]) for _ in range(rnd.randint(0, 6)))) for k in range(60)]
    same(digests(suffix_dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(5))), brute(docs))


def test_awkward(spark):
    body = "".join(random.Random(1).choice("abcdefghij ") for _ in range(400_000))
    docs = [(1, None), (2, ""), (3, body), (3, body), (4, body[1000:1050]), (5, body[1000:1049]), (None, body[500:700]), (None, body[500:700] + "!"), (6, "x" * 500), (7, "x" * 49), (-8, "x" * 60)]
    df = spark.createDataFrame([(*d, 1, "p") for d in docs], "doc_id long, text string, pack int, spans string")
    same(digests(suffix_dedup(df)), brute(docs))
    assert suffix_dedup(df.limit(0)).count() == 0
    rows = {r.doc_id: r for r in suffix_dedup(df).collect() if r.doc_id in (4, 5)}
    assert [tuple(s) for s in rows[4].spans] == [(0, 50)] and rows[4].kept == b"" and rows[5].spans == [] and rows[5].kept == body[1000:1049].encode()
