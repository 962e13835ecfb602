"""Joins of the fact table with smaller tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import settle

MAX_BROADCAST_ROWS = 200_000


def sized(
    table: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, stored: bool = False, rows: int | None = None
) -> DataFrame:
    """Mark ``table`` for broadcast only if its counted size allows that.

    It is computed once and kept, unless it is a ``stored`` table already or its ``rows`` are known.
    """
    if rows is not None:
        return F.broadcast(table) if rows <= max_rows else table
    kept = table if stored else settle(table)
    return F.broadcast(kept) if kept.count() <= max_rows else kept


def lookup_join(
    facts: DataFrame,
    table: DataFrame,
    on: str | list[str],
    how: str = "left",
    max_rows: int = MAX_BROADCAST_ROWS,
    stored: bool = False,
    rows: int | None = None,
) -> DataFrame:
    """Join a table of narrow rows, unique on ``on``, to the facts.

    Small tables are broadcast after a count, so the facts keep their partitioning.  Larger ones
    take Spark's shuffled join, where adaptive execution splits hot keys.
    """
    return facts.join(sized(table, max_rows, stored, rows), on, how)


def member_flag(
    facts: DataFrame, members: DataFrame, keys: list[str], name: str, stored: bool = False
) -> DataFrame:
    """1 if the row's key is in the fitted list ``members``, else 0."""
    marked = members.select(*keys).dropna().distinct().withColumn(name, F.lit(1))
    joined = lookup_join(facts, marked, keys, stored=stored)
    return joined.withColumn(name, F.coalesce(name, F.lit(0)))
