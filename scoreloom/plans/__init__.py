"""The registered queries. Importing a plan module registers its queries."""

from __future__ import annotations

import importlib

_MODULES = [
    "text_queries", "extract_queries", "score_queries", "report_queries", "join_queries", "consistency_queries",
    "crossmodel_queries", "corpus_queries", "source_queries",
]


def _load():
    for name in _MODULES:
        importlib.import_module(f"scoreloom.plans.{name}")
    from scoreloom.plans import catalog

    return catalog


def queries():
    return _load().callables()


def oracle_sql():
    return _load().oracles()
