"""Queries over the given test tables and the SQL that checks them."""

from __future__ import annotations

import importlib

QUERY_MODULES = ["scores", "intake", "operations", "records", "courses"]


def load_queries() -> None:
    for module in QUERY_MODULES:
        importlib.import_module(f"gradeloom.checks.{module}")
