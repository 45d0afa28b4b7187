import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from quillon.llm import packs, registry
from quillon.llm.chunk_dedup import GEAR, LEAST, MOST, SIGHT, ZERO_BITS, chunk_dedup, cut_points


def brute_chunks(t):
    """Byte by byte."""
    out, a, h = [], 0, 0
    for k, c in enumerate(t):
        h = ((h << 1) + int(GEAR[c])) & 0xFFFFFFFF
        end = k + 1
        while end - a > MOST:
            out.append((a, a + MOST))
            a += MOST
        if k + 1 >= SIGHT and h >> (32 - ZERO_BITS) == 0 and end - a >= LEAST and end < len(t):
            out.append((a, end))
            a = end
    while len(t) - a > MOST:
        out.append((a, a + MOST))
        a += MOST
    return out + [(a, len(t))] if len(t) else []


def brute(docs):
    docs = [(i, float("inf") if i is None else i, t.encode() if isinstance(t, str) else t or b"") for i, t in docs]
    low = {}
    for _, o, t in docs:
        for a, b in brute_chunks(t):
            low[t[a:b]] = min(o, low.get(t[a:b], o))
    out = []
    for i, o, t in docs:
        spans = []
        for a, b in brute_chunks(t):
            v = low[t[a:b]]
            if v < o:
                if spans and spans[-1][1] == a:
                    spans[-1] = (spans[-1][0], b, min(v, spans[-1][2]))
                else:
                    spans.append((a, b, v))
        kept, at = b"", 0
        for a, b, _ in spans:
            kept, at = kept + t[at:a], b
        out.append((i, len(t), spans, kept + t[at:]))
    return out


def same(df, docs):
    got = [(r.doc_id, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in df.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute(docs)))


def words(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghijkl") for _ in range(rnd.randint(1, 9))) for _ in range(n))


@pytest.mark.parametrize("seed", range(3))
def test_random(spark, seed, monkeypatch):
    monkeypatch.setattr(packs, "RANGE_BYTES", 3000)
    rnd = random.Random(seed)
    pool = [words(rnd, rnd.choice([20, 60, 300])) for _ in range(6)] + ["é" * 400, "xy" * 300]
    docs = [(rnd.choice([k, k, None]), " ".join(rnd.choice([rnd.choice(pool), words(rnd, rnd.randint(1, 40))]) for _ in range(rnd.randint(0, 5)))) for k in range(50)]
    same(chunk_dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)), docs)


def test_whole_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"]).to_pylist()]
    got = [tuple(r) for r in registry.QUERIES["op10_chunk_dedup"](spark, "/root/testdata/sf0.001").collect()]
    assert got and sorted(got) == sorted((i, v, a, b) for i, _, spans, _ in brute(docs) for a, b, v in spans)


def test_awkward(spark):
    rnd = random.Random(9)
    long, passage = words(rnd, 60_000), words(rnd, 80)
    docs = [(1, None), (2, ""), (3, long), (4, long), (4, long), (5, "x" * 5000), (6, "x" * 700), (None, passage), (None, passage), (-1, "z"), (7, "z"), (8, words(rnd, 30) + passage)]
    df = spark.createDataFrame([(*d, 1, "p") for d in docs], "doc_id long, text string, pack int, spans string")
    same(chunk_dedup(df), docs)
    assert chunk_dedup(df.limit(0)).count() == 0


def test_short_copies_go(spark):
    """Every chunk that a smaller id has goes, however short its span."""
    rnd = random.Random(6)
    short = words(rnd, 40)[:40]
    docs = [(1, short), (2, short), (3, "one\n"), (4, "one\n"), (5, short + "!")]
    got = {r.doc_id: bytes(r.kept) for r in chunk_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: short.encode(), 2: b"", 3: b"one\n", 4: b"", 5: got[5]}
    same(chunk_dedup(spark.createDataFrame(docs, "doc_id long, text string")), docs)


def test_planted_passages_are_caught():
    """Passages of 51 words at random places in texts of random words."""
    rnd = random.Random(8)
    vocabulary = [words(rnd, 1) for _ in range(3000)]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n)).encode()
    chunks = lambda t: {t[a:b] for a, b in brute_chunks(t)}
    caught = 0
    for _ in range(400):
        passage = text(51)
        one, two = (chunks(text(rnd.randint(0, 60)) + b" " + passage + b" " + text(rnd.randint(0, 60))) for _ in "ab")
        caught += bool(one & two)
    assert caught >= 0.97 * 400


def test_insertions_move_few_cuts():
    rnd = random.Random(4)
    a = words(rnd, 2000).encode()
    b = a[:3000] + b"inserted" + a[3000:]
    pack = lambda t: packs.Pack([1], [len(t)], pa.compress(t, codec="zstd", asbytes=True))
    chunks = lambda t, c: {t[x:y] for x, y in zip(c.tolist(), c[1:].tolist())}
    one, two = chunks(a, cut_points(pack(a))), chunks(b, cut_points(pack(b)))
    assert len(one - two) <= 6
