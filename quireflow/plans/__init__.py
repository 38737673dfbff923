"""Registered queries: inputs derived from the given tables, plans, and oracle SQL."""

from __future__ import annotations

import importlib

MODULES = ("call_plans", "page_plans", "stream_plans", "evaluation_plans", "report_plans", "live_plans")


def load() -> None:
    """Import every plan module, which registers its queries."""
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
