"""The queries of the tracking operators, gathered from the modules that define them."""

from __future__ import annotations

import importlib

FLAGSHIP = "ag1_tracklet_summary"
MODULES = ["frames", "handoffs", "resolutions", "evaluation", "sessions", "datasets", "builder", "annotations", "labels", "calibration", "stateful", "checks"]


def _gather(name: str) -> dict:
    found: dict = {}
    for module in MODULES:
        found |= getattr(importlib.import_module(f"loomtrack.plans.{module}"), name)
    return found


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("ORACLES")
