"""Extension points: parsers, scanners and queries registered by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .sources.code import register_parser

Scanner = Callable[[DataFrame], DataFrame]
_SCANNERS: dict[str, tuple[Scanner, bool]] = {}
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_EXTENSIONS: dict[str, list] = {}


def register_scanner(name: str, deferred: bool = False) -> Callable[[Scanner], Scanner]:
    """Registers a scanner: files (path, body) to findings; a deferred one runs from the scan queue."""

    def keep(f: Scanner) -> Scanner:
        _SCANNERS[name] = (f, deferred)
        return f

    return keep


def register_query(name: str):
    """Registers a named query."""

    def keep(f):
        _QUERIES[name] = f
        return f

    return keep


def register_extension(point: str, thing: object) -> None:
    _EXTENSIONS.setdefault(point, []).append(thing)


def extensions(point: str) -> list:
    return list(_EXTENSIONS.get(point, ()))


def scanners(deferred: bool | None = None) -> dict[str, Scanner]:
    return {k: f for k, (f, d) in _SCANNERS.items() if deferred is None or d == deferred}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


__all__ = ["extensions", "queries", "register_extension", "register_parser", "register_query", "register_scanner", "scanners"]
