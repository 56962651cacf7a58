"""Registered queries over the given tables."""

from __future__ import annotations

import importlib

AREAS = ("usage", "events", "stats", "evidence", "text", "graphs", "sources", "streams", "whole", "reports")


def load():
    """Import every area once and return (queries, statements)."""
    for area in AREAS:
        importlib.import_module(f"tallyline.catalog.{area}")
    from tallyline.catalog.registry import ORACLES, QUERIES

    return dict(QUERIES), dict(ORACLES)
