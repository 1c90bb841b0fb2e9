"""Registered queries of the flood-risk operators and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("formulas", "spatial", "routes", "network", "weather", "training", "raster", "layers", "drawings", "places", "features", "jobs", "validation")


def _load() -> None:
    for name in MODULES:
        import_module(f"rillwise.plans.{name}")


def queries() -> dict:
    from rillwise.plans.registry import QUERIES

    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from rillwise.plans.registry import ORACLE

    _load()
    return dict(ORACLE)
