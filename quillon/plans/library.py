"""The engine's query set as operator trees, each beside its SQL."""

from __future__ import annotations

from quillon.operators.ir import Cross, Filter, Predicate as P, Project, Query, Ref, Scan, Sort, SortKey


def where(child: Query, *predicates: P) -> Filter:
    return Filter(child, predicates)


def pick(child: Query, *columns: str) -> Project:
    """``a`` keeps its last part as name; ``a:b`` renames."""
    pairs = (c.split(":") for c in columns)
    return Project(child, tuple((p[0], p[-1].rpartition(".")[2]) for p in pairs))


def alias(table: str, name: str, *columns: str) -> Project:
    return Project(Scan(table), tuple((f"{table}.{c}", f"{name}.{c}") for c in columns))


def cross(first: Query, *rest: Query) -> Query:
    for r in rest:
        first = Cross(first, r)
    return first


def eq(a: str, b: str) -> P:
    return P(a, "=", Ref(b))


_1996 = (P("o_orderdate", ">=", "1996-01-01"), P("o_orderdate", "<", "1997-01-01"))
_S = Scan

LIBRARY: dict[str, tuple[Query, str]] = {
    "scan_region": (_S("region"), "select * from region"),
    "scan_lineitem": (_S("lineitem"), "select * from lineitem"),
    "filter_eq_string": (where(_S("customer"), P("c_mktsegment", "=", "BUILDING")), "select * from customer where c_mktsegment='BUILDING'"),
    "filter_ne_string": (where(_S("orders"), P("o_orderstatus", "<>", "F")), "select * from orders where o_orderstatus<>'F'"),
    "filter_lt_int": (where(_S("part"), P("p_size", "<", 10)), "select * from part where p_size<10"),
    "filter_lte_int": (where(_S("part"), P("p_size", "<=", 10)), "select * from part where p_size<=10"),
    "filter_gt_double": (where(_S("lineitem"), P("l_quantity", ">", 45)), "select * from lineitem where l_quantity>45"),
    "filter_gte_double": (where(_S("lineitem"), P("l_discount", ">=", 0.07)), "select * from lineitem where l_discount>=0.07"),
    "filter_range_date": (where(_S("orders"), *_1996), "select * from orders where o_orderdate>=timestamp '1996-01-01' and o_orderdate<timestamp '1997-01-01'"),
    "filter_col_col": (where(_S("lineitem"), P("l_partkey", "<", Ref("l_orderkey"))), "select * from lineitem where l_partkey<l_orderkey"),
    "filter_conjunction": (
        where(_S("lineitem"), P("l_quantity", ">=", 10), P("l_quantity", "<=", 20), P("l_returnflag", "=", "R"), P("l_discount", ">", 0.05)),
        "select * from lineitem where l_quantity>=10 and l_quantity<=20 and l_returnflag='R' and l_discount>0.05",
    ),
    "filter_empty": (where(_S("nation"), P("n_name", "=", "NOWHERE")), "select * from nation where n_name='NOWHERE'"),
    "project_subset": (pick(_S("orders"), "o_orderkey", "o_totalprice"), "select o_orderkey,o_totalprice from orders"),
    "project_rename_dup": (pick(_S("nation"), "n_name:nation", "n_name:nation_again", "n_regionkey:r"), "select n_name as nation, n_name as nation_again, n_regionkey as r from nation"),
    "cross_region_nation": (cross(_S("region"), _S("nation")), "select * from region cross join nation"),
    "cross_three": (pick(cross(_S("region"), _S("nation"), _S("supplier")), "r_name", "n_name", "s_suppkey"), "select r_name, n_name, s_suppkey from region,nation,supplier"),
    "join_equi_1key": (pick(where(cross(_S("nation"), _S("region")), eq("n_regionkey", "r_regionkey")), "n_name", "r_name"), "select n_name, r_name from nation, region where n_regionkey=r_regionkey"),
    "join_composite_key": (
        pick(
            where(
                cross(alias("lineitem", "a", "l_orderkey", "l_linenumber", "l_quantity"), alias("lineitem", "b", "l_orderkey", "l_linenumber", "l_quantity")),
                eq("a.l_orderkey", "b.l_orderkey"), eq("a.l_linenumber", "b.l_linenumber"),
            ),
            "a.l_orderkey:k", "a.l_linenumber:ln", "a.l_quantity:q1", "b.l_quantity:q2",
        ),
        "select a.l_orderkey k, a.l_linenumber ln, a.l_quantity q1, b.l_quantity q2 from lineitem a, lineitem b where a.l_orderkey=b.l_orderkey and a.l_linenumber=b.l_linenumber",
    ),
    "join_equi_plus_ne": (
        pick(
            where(
                cross(alias("lineitem", "a", "l_orderkey", "l_suppkey", "l_quantity"), alias("lineitem", "b", "l_orderkey", "l_suppkey")),
                eq("a.l_orderkey", "b.l_orderkey"), P("a.l_suppkey", "<>", Ref("b.l_suppkey")), P("a.l_quantity", ">", 45),
            ),
            "a.l_orderkey:k", "a.l_suppkey:s1", "b.l_suppkey:s2",
        ),
        "select a.l_orderkey k, a.l_suppkey s1, b.l_suppkey s2 from lineitem a, lineitem b where a.l_orderkey=b.l_orderkey and a.l_suppkey<>b.l_suppkey and a.l_quantity>45",
    ),
    "join_nonequi_nlj": (
        pick(where(cross(_S("supplier"), _S("customer")), P("s_acctbal", ">", Ref("c_acctbal")), P("c_acctbal", "<", -500)), "s_suppkey", "c_custkey"),
        "select s_suppkey, c_custkey from supplier, customer where s_acctbal>c_acctbal and c_acctbal<-500",
    ),
    "join_int32_int32": (pick(where(cross(_S("supplier"), _S("nation")), eq("s_nationkey", "n_nationkey")), "s_name", "n_name"), "select s_name, n_name from supplier, nation where s_nationkey=n_nationkey"),
    "join_int32_int64": (pick(where(cross(_S("supplier"), _S("nation")), eq("s_suppkey", "n_nationkey")), "s_name", "n_name"), "select s_name, n_name from supplier, nation where s_suppkey=n_nationkey"),
    "filter_int32_double": (where(_S("lineitem"), P("l_linenumber", ">=", Ref("l_quantity"))), "select * from lineitem where l_linenumber>=l_quantity"),
    "filter_int64_double": (where(_S("orders"), P("o_custkey", ">", Ref("o_totalprice"))), "select * from orders where o_custkey>o_totalprice"),
    "filter_text_number_loose": (
        where(_S("orders"), P("o_orderpriority", ">=", 3), P("o_orderkey", "<", "1000")),
        "select * from orders where coalesce(try_cast(o_orderpriority as double) >= 3, o_orderpriority >= '3') and o_orderkey < 1000",
    ),
    "join_sort_merge": (
        pick(where(cross(_S("customer"), _S("orders")), eq("c_custkey", "o_custkey"), P("o_orderpriority", "=", "1-URGENT")), "c_name", "o_orderkey", "o_totalprice"),
        "select c_name, o_orderkey, o_totalprice from customer, orders where c_custkey=o_custkey and o_orderpriority='1-URGENT'",
    ),
    "join_shuffle_hash": (
        pick(where(cross(_S("orders"), _S("lineitem")), eq("o_orderkey", "l_orderkey"), P("l_quantity", ">", 30)), "o_orderkey", "o_custkey", "l_quantity"),
        "select o_orderkey, o_custkey, l_quantity from orders, lineitem where o_orderkey=l_orderkey and l_quantity>30",
    ),
    "join_skewed_keys": (  # seven keys on the one side, each a seventh of it
        pick(where(cross(_S("lineitem"), _S("supplier")), eq("l_linenumber", "s_nationkey"), P("l_quantity", ">", 45), P("s_acctbal", ">", 9000)), "l_orderkey", "l_linenumber", "s_suppkey"),
        "select l_orderkey, l_linenumber, s_suppkey from lineitem, supplier where l_linenumber=s_nationkey and l_quantity>45 and s_acctbal>9000",
    ),
    "sort_after_join": (
        Sort(pick(where(cross(_S("nation"), _S("supplier")), eq("n_nationkey", "s_nationkey")), "n_name", "s_name", "s_acctbal"), (SortKey("n_name", False), SortKey("s_acctbal"))),
        "select n_name, s_name, s_acctbal from nation, supplier where n_nationkey=s_nationkey order by n_name desc, s_acctbal",
    ),
    "join_three_way": (
        pick(where(cross(_S("customer"), _S("orders"), _S("lineitem")), eq("c_custkey", "o_custkey"), eq("o_orderkey", "l_orderkey"), P("l_quantity", ">", 45)), "c_name", "o_orderkey", "l_quantity"),
        "select c_name,o_orderkey,l_quantity from customer,orders,lineitem where c_custkey=o_custkey and o_orderkey=l_orderkey and l_quantity>45",
    ),
    "join_five_way_flagship": (
        pick(
            where(
                cross(_S("region"), _S("nation"), _S("customer"), _S("orders"), _S("lineitem")),
                eq("r_regionkey", "n_regionkey"), eq("n_nationkey", "c_nationkey"), eq("c_custkey", "o_custkey"), eq("o_orderkey", "l_orderkey"),
                P("r_name", "=", "ASIA"), *_1996,
            ),
            "n_name", "c_name", "o_orderkey", "o_orderdate", "l_extendedprice",
        ),
        "select n_name,c_name,o_orderkey,o_orderdate,l_extendedprice from region,nation,customer,orders,lineitem where r_regionkey=n_regionkey and n_nationkey=c_nationkey and c_custkey=o_custkey and o_orderkey=l_orderkey and r_name='ASIA' and o_orderdate>=timestamp '1996-01-01' and o_orderdate<timestamp '1997-01-01'",
    ),
    "join_cyclic_pred": (
        pick(where(cross(_S("customer"), _S("supplier"), _S("nation")), eq("c_nationkey", "n_nationkey"), eq("s_nationkey", "n_nationkey"), eq("c_nationkey", "s_nationkey")), "c_custkey", "s_suppkey", "n_name"),
        "select c_custkey, s_suppkey, n_name from customer,supplier,nation where c_nationkey=n_nationkey and s_nationkey=n_nationkey and c_nationkey=s_nationkey",
    ),
    "join_double_alias_nation": (
        pick(
            where(
                cross(_S("supplier"), _S("customer"), alias("nation", "sn", "n_nationkey", "n_name"), alias("nation", "cn", "n_nationkey", "n_name")),
                eq("s_nationkey", "sn.n_nationkey"), eq("c_nationkey", "cn.n_nationkey"), P("sn.n_name", "=", "NATION_1"), P("cn.n_name", "=", "NATION_2"),
            ),
            "s_name", "c_name", "sn.n_name:supp_nation", "cn.n_name:cust_nation",
        ),
        "select s_name, c_name, sn.n_name supp_nation, cn.n_name cust_nation from supplier, customer, nation sn, nation cn where s_nationkey=sn.n_nationkey and c_nationkey=cn.n_nationkey and sn.n_name='NATION_1' and cn.n_name='NATION_2'",
    ),
    "join_empty_build": (
        pick(where(cross(_S("nation"), _S("region")), eq("n_regionkey", "r_regionkey"), P("r_name", "=", "NOWHERE")), "n_name", "r_name"),
        "select n_name,r_name from nation,region where n_regionkey=r_regionkey and r_name='NOWHERE'",
    ),
    "sort_single_asc": (Sort(pick(_S("orders"), "o_orderkey", "o_totalprice"), (SortKey("o_totalprice"),)), "select o_orderkey,o_totalprice from orders order by o_totalprice"),
    "sort_multi_mixed": (
        Sort(pick(_S("customer"), "c_custkey", "c_mktsegment", "c_acctbal"), (SortKey("c_mktsegment"), SortKey("c_acctbal", False))),
        "select c_custkey,c_mktsegment,c_acctbal from customer order by c_mktsegment, c_acctbal desc",
    ),
    "sort_then_project": (pick(Sort(_S("supplier"), (SortKey("s_acctbal", False),)), "s_name"), "select s_name from supplier order by s_acctbal desc"),
}

#: What :func:`quillon.plans.compile.compile_query` is told for some of them: how to join, so that each strategy is run on tables of any size, and how to compare.
OPTIONS: dict[str, dict] = {"join_sort_merge": {"join": "merge"}, "join_shuffle_hash": {"join": "shuffle_hash"}, "join_skewed_keys": {"join": "merge"}, "filter_text_number_loose": {"loose": True}}
