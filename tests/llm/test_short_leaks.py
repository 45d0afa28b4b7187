import random

import pytest

import corpus_pipeline
from quillon.llm import decontaminate
from quillon.llm.decontaminate import drop_leaks, leaks
from tests_llm_brute import brute_alignments


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("seed", range(4))
def test_short_items_and_edges(spark, seed, monkeypatch):
    rnd = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(12 if seed % 2 else 400)]
    text = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    items = [(j, text(n)) for j, n in enumerate([*range(1, 20), 30])]
    docs = []
    for i in range(160):
        cut = list(rnd.choice(items)[1])
        if rnd.random() < 0.5:
            cut = cut[rnd.randint(0, 3) : len(cut) - rnd.randint(0, 3)]
        for _ in range(rnd.randint(0, 3)):
            if cut:
                cut[rnd.randrange(len(cut))] = "zz"
        docs.append((i, text(rnd.choice([0, 0, 5, 20])) + cut + text(rnd.choice([0, 0, 5, 20]))))
    docs, items = ([(i, " ".join(w)) for i, w in t] for t in (docs, items))
    if seed > 1:
        monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", 0)
    assert {tuple(r)[:1] + tuple(r)[2:] for r in leaks(*frames(spark, docs, items)).collect()} == {(*k, *v) for k, v in brute_alignments(docs, items).items()}


def test_stage(spark, tmp_path):
    item = [f"p{k}" for k in range(15)]
    long = [f"q{k}" for k in range(30)]
    docs = [
        (1, " ".join(["some", *item[:7], "other", *item[8:], "words"])),  # one of 15 differs
        (2, " ".join(long[5:18])),  # 13 tokens out of the middle
        (3, " ".join([*long[16:], "more", "words"])),  # starts inside the item
        (4, "here is a short question"),  # an item of 4 tokens, whole
        (5, " ".join(long[5:17])),  # 12 tokens only
        (6, "a short answer is here"),
        (7, None),
    ]
    docs, bench = frames(spark, docs, [(1, " ".join(item)), (2, " ".join(long)), (3, "is a short question"), (4, None)])
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    assert sorted(r.doc_id for r in corpus_pipeline.without_leaks(spark, docs, str(tmp_path)).collect()) == [5, 6, 7]
    assert sorted(r.doc_id for r in drop_leaks(docs, bench).collect()) == [5, 6, 7]
    assert leaks(docs.limit(0), bench).count() == leaks(docs, bench.limit(0)).count() == 0


def test_no_item_is_too_short(spark, monkeypatch):
    """An item of five tokens, and one substitution among twelve; the same by broadcast and by shuffle."""
    docs = [(1, "what is the capital city"), (2, "so what is the capital city then"), (3, " ".join(f"p{k}" if k != 6 else "x" for k in range(12))), (4, "what is the main city")]
    docs, items = frames(spark, docs, [(1, "What is the capital city?"), (2, " ".join(f"p{k}" for k in range(12)))])
    want = [(1, 1, 5), (2, 1, 5), (3, 2, 11)]
    for most in (500_000, 0):
        monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", most)
        assert sorted((r.doc_id, r.item_id, r.best_window) for r in leaks(docs, items).collect()) == want
