"""Imports every module that registers queries."""

from metrum.queries import frames, library, scalars, sources, streaming, sync, tempo  # noqa: F401
from metrum.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
