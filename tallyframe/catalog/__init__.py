"""All registered queries, by inventory ID."""

from __future__ import annotations

import importlib

MODULES = ("sources", "typing", "quality", "cleaning", "combine", "query", "kpi", "business", "temporal", "explore", "events",
           "questions")


def _loaded():
    return [importlib.import_module(f"tallyframe.catalog.{name}").R for name in MODULES]


def queries():
    return {k: v for r in _loaded() for k, v in r.queries.items()}


def oracle_sql():
    return {k: v for r in _loaded() for k, v in r.oracle.items()}
