"""Checking SQL for the registered queries."""

import importlib

MODULES = ["catalog", "evidence", "signals", "actions", "personal", "audit", "findings", "documents", "streams"]


def all_sql() -> dict[str, str]:
    found = {}
    for module in MODULES:
        found.update(importlib.import_module(f"oracle.{module}").SQL)
    return found
