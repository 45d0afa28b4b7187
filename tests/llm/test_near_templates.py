"""Large groups of texts that share bands: of one template, and near copies."""

import random

from quillon.llm import near_dedup as nd
from tests_llm_brute import brute_near


def from_template(rnd, base, changes, k):
    w = list(base)  # changes lie apart, so each costs five shingles
    for j, at in enumerate(rnd.sample(range(5, len(w) - 5, 6), changes)):
        w[at] = f"own{k}x{j}"
    return " ".join(w)


def test_one_template(spark, monkeypatch):
    """20,000 texts, similar to each other by 0.52 to 0.73, and among them pairs that differ in one word: only those pairs meet."""
    rnd = random.Random(1)
    base = [f"t{k}" for k in range(100)]
    docs = [(k, from_template(rnd, base, 3, k)) for k in range(20_000)]
    pairs = {}
    for k in range(60):
        low = k * 300
        pairs[20_000 + k] = low
        docs.append((20_000 + k, " ".join([*docs[low][1].split(), "more"])))
    met, refined = [], nd._refined

    def counted(sets, percent):
        parts = refined(sets, percent)
        met.append((sets.count(), parts.count()))
        return parts

    monkeypatch.setattr(nd, "_refined", counted)
    got = nd.near_dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(8)).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: pairs.get(i, i) for i, _ in docs}
    assert met[0][0] > 19_000 and met[0][1] <= 200  # of all that share a band, only pairs are compared


def test_near_copies_in_blocks(spark, monkeypatch):
    """Groups larger than a block, whose members do not all link with the smallest one: as by brute force."""
    monkeypatch.setattr(nd, "BLOCK_SETS", 16)
    rnd = random.Random(2)
    docs = []
    for g in range(3):
        base = [f"g{g}w{k}" for k in range(120)]
        chain = list(base)
        for k in range(60):  # a chain that drifts away, and copies around its start
            chain[rnd.randrange(len(chain))] = f"d{g}{k}"
            docs.append(" ".join(chain if k % 2 else from_template(rnd, base, 1, 1000 * g + k).split()))
    rows = list(enumerate(rnd.sample(docs, len(docs))))
    for percent in (85, 80):
        got = nd.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent).collect()
        assert sorted(map(tuple, got)) == sorted(brute_near(rows, percent))
