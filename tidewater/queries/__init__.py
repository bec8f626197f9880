"""Registered queries over the driver's tables, each with the SQL that it is compared with."""

from . import dedup, extras, pipeline, relational, scores, shapes  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
