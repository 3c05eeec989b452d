"""Registered queries; importing this package fills the registry."""

from . import (  # noqa: F401
    consistency,
    exports,
    files,
    filters,
    jobs,
    lifecycle,
    logs,
    mining,
    names,
    ordered,
    reconcile,
    rollups,
    streams,
    topology,
)
