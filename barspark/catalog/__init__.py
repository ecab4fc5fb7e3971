"""All named queries."""

from importlib import import_module

from barspark.catalog.base import CATALOG, Query

for _part in ("bars", "indicators", "labels", "decisions", "results", "files", "runs"):
    import_module(f"barspark.catalog.{_part}")

__all__ = ["CATALOG", "Query"]
