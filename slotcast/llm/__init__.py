"""Operators on text corpora for training-data pipelines, with their queries.

Nothing else in the library imports this folder.
"""

from . import queries  # noqa: F401
from .common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
