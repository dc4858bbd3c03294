"""All runnable queries; importing a module registers its queries."""

from runloom.catalog import (  # noqa: F401
    intake,
    manifests,
    monitoring,
    networks,
    stored,
    streams,
)
from runloom.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
