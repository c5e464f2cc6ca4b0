"""All queries of the map-tile operators, by name, with their DuckDB SQL."""

from __future__ import annotations

import importlib

MODULES = ("addressing", "requests", "bundles", "rasters", "streams", "archives")


def _all(kind: str) -> dict:
    found: dict = {}
    for name in MODULES:
        found |= getattr(importlib.import_module(f"tilewright.plans.{name}"), kind)
    return found


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("SQL")


def flagship(spark, sf_dir):
    """Bundles of every anchor: sizes and digests."""
    return queries()["bundle_assemble"](spark, sf_dir)
