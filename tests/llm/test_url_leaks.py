import hashlib
import itertools
import math
import random
import re
from collections import Counter

import pyarrow.parquet as pq
import pytest

from quillon.llm import decontaminate, registry, url_filter
from quillon.llm.decontaminate import EQUAL, MASKS, WINDOW, drop_leaks, leaks
from quillon.llm.url_filter import ORDER, PRIOR, RULES, SYMBOLS, filter_urls
from tests_llm_brute import brute_leaks


def brute_urls(rows):
    parsed = []
    for i, u in rows:
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", u or "")
        low = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s)
        host, path = (low(m[1]), m[2]) if m else ("", "")
        fit = [r for r in RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        rule = max(fit, key=lambda r: len(r[0] + r[1]), default=None)
        form = re.sub("[^a-z0./_?=&#:-]", "*", re.sub("[0-9]", "0", re.sub(r"(?s)^.*?://", "", low(u or ""), count=1)))
        parsed.append((i, host, path, rule, form))
    seen = {"allow": Counter(), "block": Counter()}
    gram = lambda f: [("^" * ORDER + f + "$")[k : k + ORDER + 1] for k in range(len(f) + 1)]
    held = lambda f: int(hashlib.md5(f.encode()).hexdigest()[:4], 16) % 5 == 0
    for *_, rule, form in parsed:
        if rule and not held(form):
            for g in gram(form):
                for o in range(ORDER + 1):
                    seen[rule[2]][("t", g[ORDER - o :])] += 1
                    seen[rule[2]][("c", g[ORDER - o : ORDER], o)] += 1

    def p(which, g, o=ORDER):
        if o < 0:
            return 1 / SYMBOLS
        return (seen[which][("t", g[ORDER - o :])] + PRIOR * p(which, g, o - 1)) / (seen[which][("c", g[ORDER - o : ORDER], o)] + PRIOR)

    score = lambda f: sum(math.log(p("allow", g)) - math.log(p("block", g)) for g in gram(f)) / (len(f) + 1)
    side = {k: [score(f) for *_, r, f in parsed if r and r[2] == k and held(f)] for k in seen}
    at = 0.0
    if side["allow"] and side["block"]:
        mean = {k: sum(v) / len(v) for k, v in side.items()}
        dev = {k: math.sqrt(sum((x - mean[k]) ** 2 for x in v) / len(v)) + 1e-9 for k, v in side.items()}
        at = (mean["allow"] * dev["block"] + mean["block"] * dev["allow"]) / (dev["allow"] + dev["block"])
    return [(i, h, q, r and r[0] + r[1], r[2] if r else ("allow" if score(f) >= at else "block"), None if r else score(f) - at) for i, h, q, r, f in parsed]


def same_urls(got, want):
    key = lambda r: (repr(r[0]), r[1:5])
    near = {k: v for k, v in ((key(w), w[5]) for w in want)}
    for r in got:
        if r.score is not None and abs(r.score) < 1e-5:
            continue
        assert tuple(key(r)) in near, r
        if r.score is not None:
            assert near[key(r)] == pytest.approx(r.score, abs=1e-5)
    assert len(got) == len(want)


def test_urls_against_brute_force(spark):
    rows = [tuple(r.values()) for r in pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["page_id", "url"]).to_pylist()]
    got = filter_urls(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).collect()
    same_urls(got, brute_urls(rows))
    assert {r.verdict for r in got if r.rule is None} == {"allow", "block"}


AWKWARD_URLS = [
    (1, None), (2, ""), (3, "no scheme"), (4, "http://NET/x"), (5, "http://a.net"), (6, "http://xnet/"), (7, "http://A.Example.NET/en/1?q#f"),
    (8, "x://example.net/en"), (None, "http://org/fr/"), (None, "http://org/fr/"), (9, "http://b.org/fr?x"), (10, "http://É.com/de/ü\n#"),
    (11, "http://h/" + "p" * 50_000), (12, "a://b://c.net/"), (13, "http://example.com/de/?://x"),
]


def test_urls_awkward(spark):
    df = spark.createDataFrame([(i, u, "x", 1) for i, u in AWKWARD_URLS], "page_id long, url string, form string, ratio int")
    got = filter_urls(df).collect()
    same_urls(got, brute_urls(AWKWARD_URLS))
    assert filter_urls(df.limit(0)).count() == 0


def test_urls_without_broadcast(spark, monkeypatch):
    df = spark.createDataFrame(AWKWARD_URLS, "page_id long, url string")
    want = sorted(map(repr, filter_urls(df).collect()))
    monkeypatch.setattr(url_filter, "BROADCAST_GRAMS", 0)
    assert sorted(map(repr, filter_urls(df).collect())) == want


def test_masks_miss_nothing():
    for wrong in itertools.combinations(range(WINDOW), WINDOW - EQUAL):
        assert any(all(p + o not in wrong for o in m) for m in MASKS for p in range(WINDOW - m[-1]))


def test_leaks_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    read = lambda t, c: [(r[c], r["text"]) for r in pq.read_table(f"{sf}/{t}.parquet").to_pylist()]
    got = registry.QUERIES["op7_decontaminate"](spark, sf).collect()
    assert got and {(r.doc_id, r.item_id) for r in got} == brute_leaks(read("documents", "doc_id"), read("benchmark", "item_id"))


def leaky(seed):
    rnd = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(12 if seed % 2 else 400)]
    text = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    items = [(j, text(rnd.choice([3, 8, 12, 15, 16, 17, 30]))) for j in range(12)]
    docs = []
    for i in range(60):
        part = list(rnd.choice(items)[1])
        cut = part[rnd.randint(0, 3) : len(part) - rnd.randint(0, 3)] if rnd.random() < 0.4 else part
        for _ in range(rnd.randint(0, 5)):
            if cut:
                cut[rnd.randrange(len(cut))] = "zz"
        docs.append((i, text(rnd.randint(0, 20)) + cut + text(rnd.randint(0, 20))))
    sep = lambda w: rnd.choice([" ", "\n", ", ", "*** "]).join(x.upper() if rnd.random() < 0.2 else x for x in w)
    return [(i, sep(w)) for i, w in docs], [(j, sep(w)) for j, w in items]


@pytest.mark.parametrize("seed", range(4))
def test_leaks_random(spark, seed, monkeypatch):
    docs, items = leaky(seed)
    if seed > 1:
        monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", 0)  # by shuffle
    got = leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute_leaks(docs, items)


def test_leaks_awkward(spark):
    passage = " ".join(f"p{k}" for k in range(20))
    rows = [(1, passage), (1, passage), (None, passage), (None, None), (2, ""), (3, "x " * 200_000 + passage), (4, "p1 p2"), (None, "clean")]
    docs = spark.createDataFrame([(i, t, 1, "s", None) for i, t in rows], "doc_id long, text string, item int, seed string, `l.id` int")
    bench = spark.createDataFrame([(9, passage, 1), (9, passage, 2), (None, passage, 3), (7, None, 4), (8, "p1", 5)], "item_id long, text string, at int")
    assert {(r.doc_id, r.item_id) for r in leaks(docs, bench).collect()} == {(i, j) for i in (1, None, 3) for j in (9, None)} | {(i, 8) for i in (1, None, 3, 4)}
    kept = drop_leaks(docs, bench)
    assert kept.columns == docs.columns and sorted(repr(r.text) for r in kept.collect()) == sorted(map(repr, [None, "", "clean"]))
    assert leaks(docs.limit(0), bench).count() == 0 and leaks(docs, bench.limit(0)).count() == 0
    assert drop_leaks(docs, bench.limit(0)).count() == len(rows)
