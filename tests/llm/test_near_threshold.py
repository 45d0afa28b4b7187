import pyarrow.parquet as pq

import corpus_pipeline
from quillon.llm.near_dedup import drop_near_copies, near_dedup
from tests_llm_brute import shingles


def near_copy():
    """Two texts of 200 words, 82 percent similar."""
    words = [f"w{k}" for k in range(200)]
    other = [f"x{k}" if k in (40, 80, 120, 160) else w for k, w in enumerate(words)]
    a, b = shingles(" ".join(words)), shingles(" ".join(other))
    assert 0.8 <= len(a & b) / len(a | b) < 0.85
    return " ".join(words), " ".join(other)


def test_stage_links_from_80_percent(spark):
    rows = [(1, near_copy()[0]), (2, near_copy()[1]), (3, "a text of its own")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.without_near_copies(spark, docs, "").collect()) == [1, 3]
    assert sorted(r.doc_id for r in drop_near_copies(docs).collect()) == [1, 2, 3]
    assert {r.doc_id: r.component_id for r in near_dedup(docs, percent=80).collect()} == {1: 1, 2: 1, 3: 3}


def test_80_percent_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    sets = [(r["doc_id"], shingles(r["text"])) for r in rows]
    where, low = {}, {i: i for i, _ in sets}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    for i, s in sets:
        common = {}
        for x in s:
            for j, n in where.setdefault(x, []):
                common[j, n] = common.get((j, n), 0) + 1
            where[x].append((i, len(s)))
        for (j, n), c in common.items():
            if 100 * c >= 80 * (len(s) + n - c):
                a, b = sorted((find(i), find(j)))
                low[b] = a
    got = near_dedup(spark.read.parquet(f"{sf}/documents.parquet"), percent=80).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: find(i) for i, _ in sets}
