"""Registry that binds operators to the input views and to their SQL checks."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_MODULES = [
    "url_queries", "text_queries", "page_queries", "asset_queries", "explore_queries", "crawl_queries",
    "geo_queries", "place_queries", "export_queries", "stream_queries",
]


def query(name: str, check: str | None = None):
    """Register a query under ``name`` with the SQL that DuckDB can check it by."""

    def register(fn):
        QUERIES[name] = fn
        if check is not None:
            ORACLES[name] = check
        return fn

    return register


def load_all() -> None:
    for module in _MODULES:
        importlib.import_module(f"atlasweave.plans.{module}")
