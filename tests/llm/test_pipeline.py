import zlib

import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from quillon.llm import quality
from quillon.llm.mixing import SCHEDULES
from tests_llm_brute import brute_leaks, brute_near, brute_plays, brute_quality, brute_targets

SF = "/root/testdata/sf0.001"


def expected(sf):
    """Every stage by brute force, the classifier by its Python form."""
    read = lambda t, *c: [tuple(r[k] for k in c) for r in pq.read_table(f"{sf}/{t}.parquet").to_pylist()]
    docs = read("documents", "doc_id", "text", "source")
    labels = [(i, q) for i, q in read("labels", "doc_id", "quality") if zlib.crc32(str(i).encode()) % 5]
    text = {i: t for i, t, _ in docs}
    order = {i: k for k, i in enumerate(text)}
    return docs, labels, text, order


def test_stages(spark):
    docs, labels, text, _ = expected(SF)
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    names = frame.columns
    model = quality.train(frame, spark.read.parquet(f"{SF}/labels.parquet"))
    score = {i: brute_quality(model, (t or "").encode()) for i, t in text.items()}
    left = [d for d in docs if score[d[0]] >= quality.THRESHOLD]
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "exact dedup", "MinHash near-dedup", "benchmark decontamination", "mixing sources"]
    now = frame

    def step(name):
        out = stages[name](spark, now, SF)
        assert out.columns == names
        got = out.collect()
        assert sorted(r.doc_id for r in got) == sorted(i for i, *_ in left), name
        assert all(text[r.doc_id] == r.text for r in got)
        return spark.createDataFrame(got, frame.schema)

    now = step("quality classifier")
    first = {}
    for i, t, _ in left:
        body = " ".join(f".{t or ''}.".split())
        first[body] = min(i, first.get(body, i))
    left = [d for d in left if d[0] in first.values()]
    now = step("exact dedup")
    kept = {i for i, *_, k in brute_near([(i, t) for i, t, _ in left], percent=80) if k}
    left = [d for d in left if d[0] in kept]
    now = step("MinHash near-dedup")
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    bad = {i for i, _ in brute_leaks([(i, t) for i, t, _ in left], items)}
    left = [d for d in left if d[0] not in bad]
    now = step("benchmark decontamination")
    last = stages["mixing sources"](spark, now, SF)
    got = last.collect()
    sizes = {}
    for _, t, s in left:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    plays = brute_plays(left, brute_targets(sizes, [5, 2, 1]), SCHEDULES)
    mine = sorted((r.doc_id, r.position, r.taken_words) for r in got)
    assert [(i, n) for i, _, n in mine] == [(i, n) for i, _, n in sorted(plays)] and last.columns == [*names, "position", "taken_words"]
    assert max(abs(a - b) for (_, a, _), (_, b, _) in zip(mine, sorted(plays))) < 1e-6
    assert [r.position for r in got] == sorted(r.position for r in got)
    whole = corpus_pipeline.run(spark, SF).collect()
    assert sorted(map(repr, whole)) == sorted(map(repr, got))


def test_awkward(spark):
    good = "Plain words stand here in a quiet line. And more of them follow it."
    rows = [(1, None), (2, ""), (3, good), (3, good), (4, good + " "), (None, good), (None, None), (5, " ".join(f"word{k}" for k in range(100_000))), (6, "A$$$ B### C***")]
    docs = spark.createDataFrame([(i, t, None, "s", None, 1, 2) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, `key` int, position int")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.columns[: len(docs.columns)] == docs.columns, name
        out.collect()
        none = stage(spark, docs.limit(0), SF)
        assert none.count() == 0 and none.columns == out.columns


@pytest.mark.parametrize("name", ["llm", "corpus_pipeline"])
def test_the_rest_needs_neither(name):
    """The entry imports without the subpackage and the pipeline."""
    import subprocess
    import sys

    code = f"import sys; sys.modules['corpus_pipeline'] = None; sys.modules['quillon.{name}' if '{name}' == 'llm' else 'corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and 'scan_region' in q, list(q); assert ('op8_exact_dedup' in q) == ('{name}' != 'llm')"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=corpus_pipeline.__file__.rpartition("/")[0])
