"""The registered queries; importing `all_queries` loads every module of them."""

from __future__ import annotations

import importlib

MODULES = ("pricing_queries", "market_queries", "text_queries", "cell_queries", "vector_queries", "taxonomy_queries", "ingest_queries")


def all_queries():
    from .. import registry

    for m in MODULES:
        importlib.import_module(f"{__name__}.{m}")
    return registry.QUERIES, registry.ORACLE_SQL
