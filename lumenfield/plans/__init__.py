"""Registered queries: importing ``load`` brings all modules in."""

from __future__ import annotations


def load() -> tuple[dict, dict]:
    """(queries, DuckDB SQL) of the core."""
    from . import field_queries, geometry_queries, log_queries, retrieval_queries, stats_queries, text_queries  # noqa: F401
    from .registry import ORACLES, QUERIES

    return dict(QUERIES), dict(ORACLES)
