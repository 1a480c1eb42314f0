from catalog import columns_rows, custom_streams, explore, joins, sources_text, sql_surface  # noqa: F401
from catalog.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
