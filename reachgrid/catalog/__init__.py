"""Named queries over the driver tables, each with the SQL it must agree with."""

from __future__ import annotations

import importlib

MODULES = ("access", "cells", "region", "areas", "social", "geo", "transit", "tables", "files", "runs")


def load() -> tuple[dict, dict]:
    """(queries, oracle SQL), both by name."""
    from reachgrid.catalog import registry

    for name in MODULES:
        importlib.import_module(f"reachgrid.catalog.{name}")
    return dict(registry.QUERIES), dict(registry.ORACLE)
