from quillon.sources.catalog import Catalog
from quillon.sources.row_blocks import read_row_blocks
from quillon.sources.sink import write_rows

__all__ = ["Catalog", "read_row_blocks", "write_rows"]
