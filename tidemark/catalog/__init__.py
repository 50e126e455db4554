"""Registered queries with their SQL oracles."""

from __future__ import annotations

import importlib
from typing import TYPE_CHECKING

if TYPE_CHECKING:
    from tidemark.catalog.registry import Query

GROUPS = ("core", "watch", "rules", "validate", "profile", "state", "alerts", "streams", "declared")


def load() -> dict[str, Query]:
    """Import every query group and return the catalog."""
    for group in GROUPS:
        importlib.import_module(f"tidemark.catalog.{group}")
    from tidemark.catalog.registry import CATALOG

    return CATALOG
