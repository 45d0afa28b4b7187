from quillon.plans.codec import from_json, to_json
from quillon.plans.compile import compile_query

__all__ = ["compile_query", "from_json", "to_json"]
