"""Multi-operator plans: per-trace summaries, anchor explanation, driver queries."""

import importlib

_MODULES = ("profile_queries", "text_queries", "nested_queries", "request_queries", "graph_queries", "evidence_queries", "quality_queries", "report_queries", "live_queries")


def load_queries():
    """Import every query module; returns (queries, SQL equivalents)."""
    for name in _MODULES:
        importlib.import_module(f"traceframe.plans.{name}")
    from traceframe.plans.catalogue import ORACLES, QUERIES

    return QUERIES, ORACLES
