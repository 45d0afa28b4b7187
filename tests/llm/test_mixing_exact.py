import random

import pytest
from pyspark.sql import functions as F

from quillon.llm.exact_dedup import drop_exact_copies, exact_dedup
from quillon.llm.mixing import SCHEDULES, integral, mix_sources, source_targets, training_order
from tests_llm_brute import brute_targets

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, `key` string, size int, `a.b` int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, s, None, True, "x", 1, None) for i, t, s in rows], DOCS)


AWKWARD = [
    (3, "a  b\tc", "s"), (1, "a b c", "s"), (1, "a b c", "s"), (None, "a b c", None), (7, None, "t"), (6, "", None),
    (8, " \n", "s"), (9, " ", "u"), (10, "x " * 300_000, "s"), (11, "x\n" * 300_000, "s"), (None, "q r", "s"), (None, "q r", "s"),
]


@pytest.mark.parametrize("digest", [None, lambda body: F.substring(F.md5(body), 1, 1)])
def test_exact_awkward(spark, digest):
    """With a digest of 16 values too: texts that collide are told apart by their bytes."""
    rows = AWKWARD + [(100 + i, f"text {i % 20}", "s") for i in range(60)]
    got = exact_dedup(docs(spark, rows), **({"digest": digest} if digest else {})).collect()
    groups = {}
    for i, t, _ in rows:
        body = " ".join(f".{t or ''}.".split())  # the same runs become one space each
        groups.setdefault(body, []).append(i)
    assert len(got) == len(rows)
    want = sorted((repr(i), repr(min((x for x in g if x is not None), default=None)), len(g)) for g in groups.values() for i in g)
    assert sorted((repr(r.doc_id), repr(r.keep_id), r.group_size) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    kept = drop_exact_copies(docs(spark, rows))
    assert kept.columns == docs(spark, rows).columns and kept.count() == len(groups)


def test_empty(spark):
    none = docs(spark, [])
    assert exact_dedup(none).count() == drop_exact_copies(none).count() == mix_sources(none).count() == training_order(none).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_targets(spark, seed):
    rnd = random.Random(seed)
    sizes = {s: rnd.choice([0, 1, 10, 500, 9000]) for s in rnd.sample(["a", "b", "é", "Z", None, "", "src9"], rnd.randint(1, 7))}
    got = source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    want = brute_targets(sizes, [integral(s) for s in SCHEDULES])
    assert {r.source: pytest.approx(r.target) for r in got} == want


def test_mix_awkward(spark):
    rows = AWKWARD + [(100 + i, "w " * (i % 50), random.Random(i).choice("stuvw")) for i in range(400)]
    got = mix_sources(docs(spark, rows)).collect()
    sizes, taken, target = {}, {}, {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and sum(p.words for p in r.plays) == r.taken and all(0 <= p.position <= 1 for p in r.plays)
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
    assert len(got) == len(rows) and {r.source: r.source_size for r in got} == sizes
    assert brute_targets(sizes, [5, 2, 1]) == {s: pytest.approx(t) for s, t in target.items()}
    assert all(abs(taken[s] - target[s]) < 1 for s in sizes)
    again = mix_sources(docs(spark, rows).repartition(5)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_training_order(spark):
    rows = AWKWARD + [(100 + i, "w " * (i % 50), "stuvw"[i % 5]) for i in range(400)]
    d = docs(spark, rows).withColumn("position", F.lit(1))
    out = training_order(d)
    assert out.columns == d.columns + ["position_", "taken_words"]
    got = out.collect()
    assert [r.position_ for r in got] == sorted(r.position_ for r in got)
    mixed = mix_sources(d).collect()
    assert sum(r.taken_words for r in got) == sum(r.taken for r in mixed) and len(got) == sum(len(r.plays) for r in mixed)
    # a source whose schedule falls has its demand earlier than one whose schedule rises
    mean = lambda s: sum(r.position_ * r.taken_words for r in got if r.source == s) / sum(r.taken_words for r in got if r.source == s)
    assert mean("s") < mean("u")
