"""Candidate grids to schedules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from .. import constants as K
from ..functions.scalar import broadcast_day, week_start
from ..operators import schedule
from ..operators.reports import slot_category_profit
from ..session import settle


def flat_edges(grid: DataFrame, pred: str = "pred") -> DataFrame:
    return grid.select(
        week_start(F.to_date("ts")).alias("week"), "ts", "product_code", F.col(pred).alias("profit")
    )


def flat(grid: DataFrame, pred: str = "pred") -> DataFrame:
    """One product per slot within each planning week, each product once a week."""
    return schedule.assign_flat(flat_edges(grid, pred))


def two_level(
    grid: DataFrame, offers: DataFrame, mix: Sequence[tuple[str, float]], late_from: str,
    draws: int = K.DRAWS_PER_DAY, seed: int = K.SEED, pred: str = "pred",
) -> Mapping[str, DataFrame]:
    """Categories per slot first, then products within each day and category.

    ``grid``: ts, product_code, category and a prediction; ``offers``: ymd, product_code.
    """
    grid = grid.withColumn("broadcast_day", broadcast_day("ts"))
    profits = settle(slot_category_profit(grid, ("broadcast_day", "ts", "category"), pred))
    drawn = settle(schedule.draw_category_mix(profits, mix, draws, seed))
    categories = settle(schedule.assign_categories(profits, drawn))
    candidates = schedule.week_candidates(offers, profits, late_from)
    edges = settle(schedule.product_edges(grid, categories, candidates, pred=pred))
    return {
        "profits": profits, "draws": drawn, "categories": categories,
        "products": schedule.assign_products(edges, categories=categories), "edges": edges,
    }
