"""All queries of the engine and their SQL; importing the modules registers them."""

from . import index_queries, model_queries, queries, region_queries, store_queries, stream_queries
from .queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "index_queries", "model_queries", "queries", "region_queries", "store_queries", "stream_queries"]
