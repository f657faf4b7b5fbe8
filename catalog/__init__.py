"""Named queries over the driver's tables, each beside its oracle SQL."""

from __future__ import annotations

from importlib import import_module

_GROUPS = (
    "sources", "colour", "headings", "text", "forms", "document", "tables", "layout", "repair",
    "rollup", "streams",
)


def _merged(attribute: str) -> dict:
    out: dict = {}
    for group in _GROUPS:
        out.update(getattr(import_module(f"catalog.{group}_queries"), attribute))
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracles() -> dict:
    return _merged("ORACLES")
