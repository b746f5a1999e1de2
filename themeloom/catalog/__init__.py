"""All registered queries and their SQL."""

from themeloom.catalog import inference_queries, invariant_queries, report_queries, table_queries, text_queries, vector_queries  # noqa: F401
from themeloom.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
