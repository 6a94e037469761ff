"""All bindings; importing a module registers its queries."""

from registry import absorption, domain, fits, images, ingest, relational, spatial  # noqa: F401
from registry.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
