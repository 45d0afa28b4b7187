"""A PySpark-native engine for select-project-cross-sort query trees.

Queries are built from five logical operators, resolved and type-checked when
the plan is built, and compiled to one lazy DataFrame that Catalyst optimises.
"""

from quillon.operators.ir import Cross, Filter, Predicate, Project, Ref, Scan, Sort, SortKey
from quillon.plans.compile import compile_query
from quillon.sources.catalog import Catalog

__all__ = [
    "Catalog", "Cross", "Filter", "Predicate", "Project", "Ref", "Scan", "Sort", "SortKey", "compile_query",
]
