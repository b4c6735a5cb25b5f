"""Plans: ingestion, star schema, segmentation, metadata, and the registered queries."""

from __future__ import annotations

import importlib

QUERY_MODULES = ("queries_text", "queries_clean", "queries_star", "queries_grid", "queries_load", "queries_segments")


def load_queries() -> None:
    for name in QUERY_MODULES:
        importlib.import_module(f"{__name__}.{name}")
