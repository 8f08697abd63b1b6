"""Registered queries; importing the package registers them all."""

from fleetloom.plans.queries import (  # noqa: F401
    aggregates,
    audits,
    diffs,
    filters,
    graphs,
    joins,
    ordering,
    quantities,
    rules,
    scans,
    states,
    streams,
    views,
)
