from quillon.operators.ir import Cross, Filter, Predicate, Project, Ref, Scan, Sort, SortKey

__all__ = ["Cross", "Filter", "Predicate", "Project", "Ref", "Scan", "Sort", "SortKey"]
