"""Every registered query and its checking SQL."""

from jobweave.catalog import (  # noqa: F401
    cleaning_queries, ingest_queries, market_queries, normalize_queries, series_queries, streaming_queries,
    text_queries,
)
from jobweave.catalog.registry import ORACLE, QUERIES  # noqa: F401
