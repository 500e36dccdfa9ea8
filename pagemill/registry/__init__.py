"""All registered queries, by area."""

import importlib

from pagemill.registry.base import QUERIES, Query

_AREAS = ("url_queries", "page_queries", "dedup_queries", "crawl_queries", "store_queries", "metric_queries")


def all_queries() -> dict[str, Query]:
    for area in _AREAS:
        importlib.import_module(f"pagemill.registry.{area}")
    return dict(QUERIES)
