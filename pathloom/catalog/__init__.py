"""All registered queries."""

import importlib

from pathloom.catalog.base import ORACLES, QUERIES

for _part in ("sources", "columns", "filters", "text", "dedup", "frames", "joins", "aggregates", "trees", "jobs", "streams", "transfers"):
    importlib.import_module(f"pathloom.catalog.{_part}")

__all__ = ["ORACLES", "QUERIES"]
