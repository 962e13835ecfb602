"""Queries over the benchmark tables, one or more per operator, with their SQL twins."""

from . import base, encodings, exploring, joining, lagging, planning, ranking, scanning  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
