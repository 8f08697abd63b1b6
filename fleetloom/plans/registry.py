"""Registered queries and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fleetloom.plans.bindings import Fleet
from fleetloom.plans.oracle import check_sql
from fleetloom.session import prepare_session

_BUILDERS: dict[str, Callable[[Fleet], DataFrame]] = {}
_CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a builder under ``name``, with the equivalent SQL over the same views."""

    def register(build: Callable[[Fleet], DataFrame]):
        if name in _BUILDERS:
            raise ValueError(f"duplicate query {name}")
        _BUILDERS[name] = build
        if sql is not None:
            _CHECKS[name] = sql
        return build

    return register


def _load() -> None:
    from fleetloom.plans import queries  # noqa: F401


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()

    def bind(build):
        return lambda spark, folder: build(Fleet(prepare_session(spark), folder))

    return {name: bind(build) for name, build in _BUILDERS.items()}


def checks() -> dict[str, str]:
    _load()
    return {name: check_sql(sql) for name, sql in _CHECKS.items()}
