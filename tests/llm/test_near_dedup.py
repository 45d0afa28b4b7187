import random

import numpy as np
import pyarrow.parquet as pq
import pytest

from quillon.llm import graph, registry
from quillon.llm import near_dedup as nd
from quillon.llm.graph import components
from tests_llm_brute import brute_near as brute


def same(got, want):
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_against_brute_force(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in pq.read_table(f"/root/testdata/{sf}/documents.parquet", columns=["doc_id", "text"]).to_pylist()]
    same(registry.QUERIES["op2_near_dedup"](spark, f"/root/testdata/{sf}").collect(), brute(docs))


def family(seed, n):
    rnd = random.Random(seed)
    base = [f"w{rnd.randint(0, 300)}" for _ in range(rnd.choice([3, 7, 30, 200]))]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rnd.randint(0, max(1, len(w) // 40))):
            w[rnd.randrange(len(w))] = f"v{rnd.randint(0, 99)}"
        out.append(" ".join(w).upper() if rnd.random() < 0.1 else "\t".join(w))
    return out


@pytest.mark.parametrize("blocks", [256, 8])
def test_families(spark, monkeypatch, blocks):
    monkeypatch.setattr(nd, "BLOCK_SETS", blocks)
    texts = [t for s in range(25) for t in family(s, 40)]
    docs = list(enumerate(random.Random(1).sample(texts, len(texts))))
    same(nd.near_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect(), brute(docs))


def test_awkward(spark):
    long = " ".join(f"w{k}" for k in range(150_000))
    docs = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A\tb"), (None, "a b"), (None, "q"), (None, "q"), (6, "a b c d e"), (6, "a b c d e"), (8, long), (7, long + " x"), (9, "É é"), (10, "é é")]
    df = spark.createDataFrame([(*d, "s", 1, b"x") for d in docs], "doc_id long, text string, component string, n_shingles int, digest binary")
    same(nd.near_dedup(df).collect(), [(i, n, low, i == low or (i is None and low is None)) for i, n, low, _ in brute(docs)])
    kept = nd.drop_near_copies(df)
    assert kept.columns == df.columns
    assert sorted(map(repr, ((r.doc_id, len(r.text or "")) for r in kept.collect()))) == sorted(map(repr, [(1, 0), (2, 0), (3, 2), (4, 3), (None, 1), (6, 9), (7, len(long) + 2), (9, 3), (10, 3)]))
    assert nd.near_dedup(df.limit(0)).count() == nd.drop_near_copies(df.limit(0)).count() == 0


def test_estimates():
    rnd = np.random.default_rng(3)
    for n, t in ((40, 0.9), (400, 0.85), (5000, 0.3), (5000, 0.0)):
        got = []
        for _ in range(60):
            pool = np.unique(rnd.integers(0, 2**63, 3 * n, dtype=np.uint64))[: 2 * n]
            rnd.shuffle(pool)
            both = int(round(2 * n * t / (1 + t)))
            a, b = np.sort(pool[:n]), np.sort(np.concatenate([pool[:both], pool[n : 2 * n - both]]))
            got.append(nd.estimates(nd.registers(b)[None], nd.registers(a), n)[0])
        assert abs(np.mean(got) - t) < 0.02


@pytest.mark.parametrize("most", [200_000, 60])
def test_components(spark, monkeypatch, most):
    """In one task, and in rounds between tasks with hot nodes."""
    monkeypatch.setattr(graph, "TASK_EDGES", most)
    monkeypatch.setattr(graph, "HOT_EDGES", 5)
    rnd = random.Random(5)
    edges = [(rnd.randint(0, 400), rnd.randint(0, 400)) for _ in range(300)] + [(1000 + k, 1001 + k) for k in range(90)] + [(5, 5)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            lo, hi = sorted((find(a), find(b)))
            parent[hi] = lo
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()))
    assert got == {x: find(x) for x in parent}
