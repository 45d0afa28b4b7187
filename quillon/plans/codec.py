"""JSON form of a query tree. The spelling is this engine's own.

    {"op": "filter", "input": ..., "predicates": [{"column", "cmp", "value" | "ref"}]}
"""

from __future__ import annotations

import json

from quillon.operators.ir import Cross, Filter, Predicate, Project, Query, Ref, Scan, Sort, SortKey


def _out(q: Query) -> dict:
    if isinstance(q, Scan):
        return {"op": "scan", "table": q.table}
    if isinstance(q, Cross):
        return {"op": "cross", "left": _out(q.left), "right": _out(q.right)}
    if isinstance(q, Project):
        return {"op": "project", "input": _out(q.child), "columns": [{"from": a, "to": b} for a, b in q.columns]}
    if isinstance(q, Sort):
        return {"op": "sort", "input": _out(q.child), "keys": [{"column": k.column, "ascending": k.ascending} for k in q.keys]}
    right = lambda v: {"ref": v.name} if isinstance(v, Ref) else {"value": v}
    return {"op": "filter", "input": _out(q.child), "predicates": [{"column": p.column, "cmp": p.op} | right(p.value) for p in q.predicates]}


def _in(x: dict) -> Query:
    op = x["op"]
    if op == "scan":
        return Scan(x["table"])
    if op == "cross":
        return Cross(_in(x["left"]), _in(x["right"]))
    if op == "project":
        return Project(_in(x["input"]), tuple((c["from"], c["to"]) for c in x["columns"]))
    if op == "sort":
        return Sort(_in(x["input"]), tuple(SortKey(k["column"], k.get("ascending", True)) for k in x["keys"]))
    if op == "filter":
        return Filter(_in(x["input"]), tuple(Predicate(p["column"], p["cmp"], Ref(p["ref"]) if "ref" in p else p["value"]) for p in x["predicates"]))
    raise ValueError(f"unknown operator {op!r}")


def to_json(query: Query) -> str:
    return json.dumps(_out(query))


def from_json(text: str) -> Query:
    return _in(json.loads(text))
