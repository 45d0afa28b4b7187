from quillon.functions.compare import comparison
from quillon.functions.render import render_double, render_rows

__all__ = ["comparison", "render_double", "render_rows"]
