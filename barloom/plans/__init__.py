"""Registered queries: each pairs a DataFrame plan with the SQL it must agree with."""

from __future__ import annotations

import importlib

from barloom.plans.registry import REGISTRY

MODULES = (
    "indicators",
    "signals",
    "patterns",
    "cross_section",
    "research",
    "joins",
    "aggregates",
    "trades",
    "risk",
    "limits",
    "quality",
    "integrity",
    "learning",
    "portfolio",
    "rules",
    "reports",
    "ingestion",
)


def load() -> dict:
    for m in MODULES:
        try:
            importlib.import_module(f"barloom.plans.{m}")
        except ModuleNotFoundError as e:
            if e.name != f"barloom.plans.{m}":
                raise
    return REGISTRY
