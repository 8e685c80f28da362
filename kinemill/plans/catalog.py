"""Every query of the library with its SQL, by name."""

from __future__ import annotations

from . import datasets, formats, geometry, linkage, poses, recordings, rows, tables  # noqa: F401  they register their queries
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
