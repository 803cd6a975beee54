"""Registered queries and the SQL that checks them."""

from __future__ import annotations

from .core import ORACLES, QUERIES

_loaded = False


def load() -> tuple[dict, dict]:
    """Import every query module once and return (queries, oracles)."""
    global _loaded
    if not _loaded:
        from . import (  # noqa: F401
            bootstraps, construction, estimation, overlays, panels, relational, reports, risks, searches, windows_q,
        )
        _loaded = True
    return QUERIES, ORACLES
