"""All registered queries of the engine."""

from __future__ import annotations

import importlib

from .registry import ORACLES, QUERIES

#: Modules whose import registers their queries.
FAMILIES = ("shapes", "graphs", "scores", "rasters", "images", "files", "models", "streams")

for _name in FAMILIES:
    importlib.import_module(f"{__package__}.{_name}")

__all__ = ["ORACLES", "QUERIES"]
