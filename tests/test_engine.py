"""The engine against DuckDB, its order, names, types and plans."""

import random
from functools import reduce

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quillon import Catalog, Cross, Filter, Predicate as P, Project, Ref, Scan, Sort, SortKey, compile_query
from quillon.functions.render import render_double, render_rows
from quillon.plans import compile as compiler
from quillon.plans.codec import from_json, to_json
from quillon.plans.compile import CrossTooLarge
from quillon.plans.library import LIBRARY, OPTIONS
from quillon.plans.resolve import ResolutionError

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def bag(rows):
    return sorted(map(repr, map(tuple, rows)))


@pytest.mark.parametrize("name", LIBRARY)
def test_library_matches_sql(spark, duck, name):
    query, sql = LIBRARY[name]
    df = compile_query(query, Catalog(spark, SF), **OPTIONS.get(name, {}))
    con = duck.execute(sql)
    assert df.columns == [d[0] for d in con.description]
    assert bag(df.collect()) == bag(con.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["n_name", "c_name", "o_orderkey", "o_orderdate", "l_extendedprice"]


def tables(spark, **rows):
    return Catalog(spark, tables={k: spark.createDataFrame(v, schema) for k, (v, schema) in rows.items()})


def test_sort_orders_by_every_key(spark):
    c = tables(spark, t=([(1, 1), (1, 3), (2, 5), (1, 2), (2, 4), (None, 9)], "a int, b int"))
    got = compile_query(Sort(Scan("t"), (SortKey("a"), SortKey("b", False))), c).collect()
    assert [tuple(r) for r in got] == [(None, 9), (1, 3), (1, 2), (1, 1), (2, 5), (2, 4)]
    got = compile_query(Project(Sort(Scan("t"), (SortKey("t.b", False),)), (("b", "x"),)), c).collect()
    assert [r.x for r in got] == [9, 5, 4, 3, 2, 1]


def test_residual_keeps_later_matches(spark):
    c = tables(spark, l=([(1, 5)], "k int, v int"), r=([(1, 4), (1, 5), (1, 6)], "k int, w int"))
    q = Filter(Cross(Scan("l"), Scan("r")), (P("l.k", "=", Ref("r.k")), P("v", "<>", Ref("w"))))
    assert bag(compile_query(Project(q, (("w", "w"),)), c).collect()) == bag([(4,), (6,)])


def test_project_over_joins_and_hidden_predicate_columns(spark):
    c = tables(spark, a=([(1, 2)], "x int, y int"), b=([(1, 3)], "x int, z int"), d=([(3, 4)], "z int, w int"))
    q = Filter(Cross(Cross(Scan("a"), Scan("b")), Scan("d")), (P("a.x", "=", Ref("b.x")), P("b.z", "=", Ref("d.z")), P("y", "<", Ref("w"))))
    assert compile_query(Project(q, (("w", "w"),)), c).collect() == [(4,)]


def test_aliases_attach_to_their_side(spark):
    c = tables(spark, t=([(1, "p"), (2, "q")], "k int, n string"))
    alias = lambda a: Project(Scan("t"), (("t.k", f"{a}.k"), ("t.n", f"{a}.n")))
    q = Filter(Cross(alias("m"), Scan("t")), (P("m.n", "=", "p"), P("t.n", "=", "q")))
    assert [tuple(r) for r in compile_query(q, c).collect()] == [(1, "p", 2, "q")]
    assert compile_query(q, c).columns == ["m.k", "m.n", "t.k", "t.n"]


def test_names(spark):
    c = tables(spark, t=([(1, 2)], "a int, `a.b` int"))
    assert compile_query(Project(Scan("t"), (("t.a.b", "v"),)), c).collect() == [(2,)]
    two = Cross(Scan("t"), Project(Scan("t"), (("t.a", "u.a"),)))
    with pytest.raises(ResolutionError, match="ambiguous"):
        compile_query(Filter(two, (P("a", "=", 1),)), c)
    with pytest.raises(ResolutionError, match="unknown"):
        compile_query(Filter(Scan("t"), (P("t.zz", "=", 1),)), c)
    with pytest.raises(KeyError):
        compile_query(Scan("none"), c)


def test_types(spark):
    c = tables(spark, t=([(0.1, 2**53 + 1, "010", float("nan"))], "f float, n long, s string, x double"))
    count = lambda *p: compile_query(Filter(Scan("t"), p), c).count()
    assert count(P("f", "=", 0.1)) == 1
    assert count(P("n", "=", 2**53)) == 0 and count(P("n", ">", 0.5)) == 1
    assert count(P("s", "=", "10")) == 0
    assert count(P("x", ">", 1e300)) == 1  # NaN is the largest
    for bad in (P("n", "=", "x"), P("s", "<", 3), P("s", "=", Ref("n"))):
        with pytest.raises(TypeError):
            count(bad)
    with pytest.raises(ValueError):
        P("s", "like", "x")


def test_loose_comparison(spark):
    c = tables(spark, t=([("10", 9, 1.5), ("x", 10, 10.0), ("1e1", 11, None)], "s string, n int, d double"))
    got = lambda *p: sorted(r.n for r in compile_query(Filter(Scan("t"), p), c, loose=True).collect())
    assert got(P("s", "=", 10)) == [9, 11] and got(P("s", ">", Ref("n"))) == [9, 10]  # "x" > "10" as texts
    assert got(P("n", ">=", "10")) == [10, 11] and got(P("d", "=", "10.0")) == [10] and got(P("n", "<", "a")) == [9, 10, 11]


def test_long_strings_and_nulls(spark):
    c = tables(spark, t=([("x" * 200_000, None), (None, 1)], "s string, n int"))
    assert compile_query(Filter(Scan("t"), (P("s", "=", "x" * 200_000),)), c).count() == 1
    assert compile_query(Filter(Scan("t"), (P("n", "<>", 5),)), c).count() == 1


def test_json_round_trip():
    for query, _ in LIBRARY.values():
        assert from_json(to_json(query)) == query


def test_text_sink(spark):
    values = [900.0, 1e7, 1.5e-7, 1234567.125, 1e15, 1.25e20, -2.5, -0.0, 0.1, float("inf")]
    df = spark.createDataFrame([(v,) for v in values], "v double").select(render_double(F.col("v")).alias("s"))
    assert [r.s for r in df.collect()] == ["900.0", "10000000.0", "0.00000015", "1234567.125", "1000000000000000", "125000000000000000000", "-2.5", "-0.0", "0.1", "inf"]
    df = spark.createDataFrame([(1, "a", 2.0, None)], "a int, b string, c float, d string")
    assert render_rows(df).collect() == [("1|a|2.0||",)]


def test_plans(spark):
    plan = lambda name: compile_query(LIBRARY[name][0], Catalog(spark, SF))._jdf.queryExecution().toString()
    for name in ("join_three_way", "join_five_way_flagship", "join_cyclic_pred", "join_composite_key"):
        assert "Cartesian" not in (p := plan(name)) and "NestedLoop" not in p
    assert "PushedFilters: [IsNotNull(r_name), EqualTo(r_name,ASIA)" in plan("join_five_way_flagship")
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan("project_subset")


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_ways_to_join(spark):
    query = LIBRARY["join_sort_merge"][0]
    for join, node in (("merge", "SortMergeJoin"), ("shuffle_hash", "ShuffledHashJoin"), ("broadcast", "BroadcastHashJoin")):
        assert node in plan_of(compile_query(query, Catalog(spark, SF), join=join))
    with pytest.raises(ValueError, match="way to join"):
        compile_query(query, Catalog(spark, SF), join="magic")


def test_skewed_join_is_split(spark):
    """A key that half of all rows have: the same rows, and adaptive execution deals its partition over several tasks."""
    rows = spark.range(40_000).selectExpr("if(id % 2 = 0, 7, id) k", "sha2(cast(id as string), 512) v")
    c = Catalog(spark, tables={"a": rows, "b": spark.range(3000).selectExpr("id k", "id w")})
    sets = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in sets}
    try:
        for k, v in sets.items():
            spark.conf.set(k, v)
        df = compile_query(Filter(Cross(Scan("a"), Scan("b")), (P("a.k", "=", Ref("b.k")),)), c, join="merge")
        assert len(df.collect()) == 20_000 + 1500 and "skew=true" in plan_of(df)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_products_are_guarded(spark):
    c = tables(spark, a=([(k,) for k in range(30)], "x int"), b=([(k,) for k in range(40)], "y int"), d=([(k, k) for k in range(5)], "z int, w int"))
    product = Cross(Scan("a"), Scan("b"))
    with pytest.raises(CrossTooLarge, match="30 and 40"):
        compile_query(product, c, most_pairs=1000)
    assert compile_query(product, c, most_pairs=1200).count() == compile_query(product, c, most_pairs=None).count() == 1200
    # literals count, predicates that join lift the guard, also by way of a third table
    assert compile_query(Filter(product, (P("x", "<", 3), P("y", "=", 1))), c, most_pairs=3).count() == 3
    assert compile_query(Filter(product, (P("x", "<", Ref("y")),)), c, most_pairs=1).count() > 1
    linked = Filter(Cross(product, Scan("d")), (P("x", "=", Ref("z")), P("w", "=", Ref("y"))))
    assert compile_query(linked, c, most_pairs=1).count() == 5
    with pytest.raises(CrossTooLarge):
        compile_query(Filter(Cross(product, Scan("d")), (P("x", "=", Ref("z")),)), c, most_pairs=1)


def test_products_are_judged_as_joined(spark):
    """join_double_alias_nation, where two tables meet in a product that others reduce: its sides count as joined and are joined before they are multiplied."""
    n, m = 50, 60
    nation = [(k, f"NATION_{k}") for k in range(25)]
    c = tables(spark, supplier=([(f"s{k}", k % 25) for k in range(n)], "s_name string, s_nationkey int"), customer=([(f"c{k}", k % 25) for k in range(m)], "c_name string, c_nationkey int"), nation=(nation, "n_nationkey int, n_name string"))
    query = LIBRARY["join_double_alias_nation"][0]
    want = bag((f"s{j}", f"c{k}", "NATION_1", "NATION_2") for j in range(n) for k in range(m) if j % 25 == 1 and k % 25 == 2)
    assert len(want) == 6 and bag(compile_query(query, c, most_pairs=6).collect()) == want
    with pytest.raises(CrossTooLarge, match="2 and 3"):
        compile_query(query, c, most_pairs=5)
    # the product stands above the joins, in the plan and where a Project or a Sort lies between Filter and Cross
    last = next(line for line in compile_query(query, c)._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line or "Cartesian" in line)
    assert "NestedLoop" in last or "Cartesian" in last
    inner = query.child
    for between in (Project(inner.child, tuple((x, x) for x in ("s_name", "s_nationkey", "c_name", "c_nationkey", "sn.n_nationkey", "sn.n_name", "cn.n_nationkey", "cn.n_name"))), Sort(inner.child, (SortKey("s_name"),))):
        assert bag(compile_query(Project(Filter(between, inner.predicates), query.columns), c, most_pairs=6).collect()) == want


def test_long_products_are_dealt(spark, monkeypatch):
    """Two sides in one partition each: many tasks make their pairs, all of them, once either side is long."""
    c = Catalog(spark, tables={t: spark.range(n).selectExpr(f"id {t}").coalesce(1) for t, n in (("a", 40), ("b", 30), ("d", 3))})
    tasks = lambda df: df.selectExpr("spark_partition_id() p").distinct().count()
    pair, three = Cross(Scan("a"), Scan("b")), Cross(Cross(Scan("a"), Scan("d")), Scan("b"))
    assert tasks(compile_query(pair, c)) == 1
    monkeypatch.setattr(compiler, "DEALT_ROWS", 30)
    for query, pairs in ((pair, 1200), (three, 3600)):
        df = compile_query(query, c)
        assert tasks(df) > 1 and df.count() == df.distinct().count() == pairs
    assert tasks(compile_query(Cross(Scan("a"), Scan("d")), c)) == 1
    assert plan_of(compile_query(Filter(pair, (P("a", "=", Ref("b")),)), c)).count("REPARTITION_BY_NUM") == 0


def test_every_product_is_counted(spark):
    """Of four tables two are joined: the others make products with them and with each other."""
    c = tables(spark, **{t: ([(k,) for k in range(n)], f"{t} int") for t, n in zip("abcd", (3, 4, 5, 6))})
    query = Filter(Cross(Cross(Scan("a"), Scan("b")), Cross(Scan("c"), Scan("d"))), (P("a", "=", Ref("c")),))
    assert compile_query(query, c, most_pairs=72).count() == 72
    with pytest.raises(CrossTooLarge, match="12 and 6"):
        compile_query(query, c, most_pairs=71)
    # a table of which no column is left still multiplies
    gone = Sort(Project(Cross(Scan("a"), Scan("b")), (("a", "x"),)), (SortKey("x"),))
    assert compile_query(gone, c, most_pairs=12).count() == 12
    with pytest.raises(CrossTooLarge, match="12 and 5"):
        compile_query(Cross(gone, Scan("c")), c, most_pairs=59)


def test_statistics_reach_catalyst_without_a_cache(spark):
    c = Catalog(spark, SF)
    assert compile_query(LIBRARY["join_equi_1key"][0], c).count() == 25
    c.analyze("nation")
    c.declare("region", rows=123_456, columns={"r_regionkey": {"distinct": 5, "min": 0, "max": 4}, "r_name": {"distinct": 5}})
    assert compile_query(LIBRARY["join_equi_1key"][0], c).count() == 25
    spark.conf.set("spark.sql.cbo.enabled", "true")
    try:
        for name, rows in (("nation", 25), ("region", 123_456)):
            stats = c.table(name)._jdf.queryExecution().optimizedPlan().stats()
            assert int(stats.rowCount().get()) == rows and stats.attributeStats().nonEmpty()
            assert "InMemoryRelation" not in plan_of(c.table(name))
        some = compile_query(Filter(Scan("region"), (P("r_regionkey", "=", 2),)), c)
        assert int(some._jdf.queryExecution().optimizedPlan().stats().rowCount().get()) == -(-123_456 // 5)
    finally:
        spark.conf.set("spark.sql.cbo.enabled", "false")
    with pytest.raises(ValueError):
        Catalog(spark, tables={"t": spark.range(3)}).analyze("t")


@pytest.mark.parametrize("seed", range(12))
def test_random_trees_match_sql(spark, seed):
    rnd = random.Random(seed)
    rows = {t: [(rnd.randint(0, 4), rnd.choice([0.5, 1.0, 2.5, None]), rnd.choice("xyz")) for _ in range(rnd.randint(0, 9))] for t in "abc"}
    c = tables(spark, **{t: (v, "i int, d double, s string") for t, v in rows.items()})
    con = duckdb.connect()
    for t, v in rows.items():
        con.execute(f"create table {t} (i int, d double, s varchar)")
        if v:
            con.executemany(f"insert into {t} values (?,?,?)", v)
    used = rnd.sample("abc", rnd.randint(1, 3))
    cols = [(t, k) for t in used for k in "ids"]
    preds, sql = [], []
    for _ in range(rnd.randint(0, 4)):
        t, k = rnd.choice(cols)
        op = rnd.choice(["=", "<>", "<", "<=", ">", ">="])
        peers = [x for x in cols if (x[1] == "s") == (k == "s") and x != (t, k)]
        if rnd.random() < 0.5 and peers:
            u, m = rnd.choice(peers)
            preds.append(P(f"{t}.{k}", op, Ref(f"{u}.{m}")))
            sql.append(f"{t}.{k} {op} {u}.{m}")
        else:
            v = "y" if k == "s" else rnd.choice([1, 2, 0.5])
            preds.append(P(f"{t}.{k}", op, v))
            sql.append(f"{t}.{k} {op} {v!r}")
    out = rnd.sample(cols, rnd.randint(1, len(cols)))
    q = Project(Filter(reduce(Cross, map(Scan, used)), tuple(preds)), tuple((f"{t}.{k}", f"{t}_{k}") for t, k in out))
    want = con.execute(f"select {', '.join(f'{t}.{k} {t}_{k}' for t, k in out)} from {', '.join(used)} where {' and '.join(sql) or 'true'}").fetchall()
    assert bag(compile_query(q, c).collect()) == bag(want)
