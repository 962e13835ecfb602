"""Candidate grids and maximum-profit schedules."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .. import constants as K
from ..functions.scalar import scaled_profit, uniform, week_start
from ..session import ship
from .encode import stack
from .lookup import lookup_join


def hourly_slots(start: Column | str, end: Column | str) -> Column:
    """Array of hourly slot times from the first hour of day ``start`` to the last of ``end``."""
    day = lambda d: (F.lit(d) if isinstance(d, str) else d).cast("date").cast("timestamp_ntz")
    return F.sequence(day(start), day(end) + F.expr("interval 23 hours"), F.expr("interval 1 hour"))


def cross_schedule(products: DataFrame, start: Column | str, end: Column | str) -> DataFrame:
    """Every product on every hourly slot of the planned days.

    Each product row unfolds into the calendar's slots in place: no join and no shuffle.
    """
    return products.withColumn("ts", F.explode(hourly_slots(start, end)))


def draw_category_mix(
    days: DataFrame, mix: Sequence[tuple[str, float]], draws: int = K.DRAWS_PER_DAY,
    seed: int = K.SEED, day: str = "broadcast_day",
) -> DataFrame:
    """Repeatable multinomial draws: (day, category, draws), categories never drawn are absent.

    ``mix`` lists categories with their probabilities (a parameter of a dozen entries); the last
    one takes what rounding leaves over.
    """
    each = days.select(day).distinct().withColumn(
        "_draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))
    )
    u = uniform(seed, day, "_draw")
    pick, upto = F, 0.0
    for category, p in mix[:-1]:
        upto += p
        pick = pick.when(F.col("_u") < upto, category)
    pick = pick.otherwise(mix[-1][0]) if len(mix) > 1 else F.lit(mix[0][0])
    return (
        each.withColumn("_u", u)
        .withColumn("category", pick)
        .groupBy(day, "category")
        .agg(F.count(F.lit(1)).alias("draws"))
    )


def week_candidates(
    offers: DataFrame, days: DataFrame, late_from: str, day: str = "broadcast_day"
) -> DataFrame:
    """Products that may run on a TV day: those offered in the week in which the day ends.

    Days that end on or after ``late_from`` also take the week before.  ``offers``: ymd,
    product_code.
    """
    ends = F.date_add(day, 1)
    week = week_start(ends)
    weeks = F.when(ends < F.lit(late_from).cast("date"), F.array(week)).otherwise(
        F.array(F.date_sub(week, 7), week)
    )
    wanted = days.select(day).distinct().withColumn("_week", F.explode(weeks))
    offered = offers.select(week_start("ymd").alias("_week"), "product_code").distinct()
    # at most two rows per calendar day on the small side
    return offered.join(F.broadcast(wanted), "_week").select(day, "product_code").distinct()


def priced_assignment(
    profit: np.ndarray,
) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray, float]:
    """Row and column pairs of highest total profit, and the prices that prove it.

    nan marks pairs that are not allowed; as many rows as possible are filled, which a low value for
    an empty row brings about.  Shortest augmenting paths give row prices r and column prices c >= 0
    with profit <= r + c for every allowed pair, equality for chosen ones, c = 0 for unused columns
    and r >= that low value, which is returned last.  So no choice can be worth more than all prices.
    """
    n, m = profit.shape
    allowed = ~np.isnan(profit)
    if not allowed.any():
        return [], np.zeros(n), np.zeros(m), 0.0
    top, low = float(np.nanmax(profit)), float(np.nanmin(profit))
    empty = low - n * (top - low + 1.0)
    cost = np.full((n, m + n), top - empty)
    cost[:, :m] = np.where(allowed, top - profit, np.inf)
    row_price, col_price = np.zeros(n), np.zeros(m + n)
    owner = np.full(m + n, -1)
    for row in range(n):
        dist, via = np.full(m + n, np.inf), np.full(m + n, -1)
        open_ = np.ones(m + n, dtype=bool)
        at, last, reached, scanned = row, -1, 0.0, []
        while True:
            through = reached + cost[at] - row_price[at] - col_price
            better = open_ & (through < dist)
            dist[better], via[better] = through[better], last
            last = int(np.where(open_, dist, np.inf).argmin())
            reached = dist[last]
            open_[last] = False
            if owner[last] < 0:
                break
            scanned.append(last)
            at = owner[last]
        row_price[row] += reached
        for col in scanned:
            slack = reached - dist[col]
            row_price[owner[col]] += slack
            col_price[col] -= slack
        while last >= 0:
            before = via[last]
            owner[last] = row if before < 0 else owner[before]
            last = before
    pairs = sorted((int(r), c) for c, r in enumerate(owner[:m]) if r >= 0)
    return pairs, top - row_price, -col_price[:m], empty


def best_assignment(profit: np.ndarray) -> list[tuple[int, int]]:
    """Row and column pairs of highest total profit; nan marks pairs that are not allowed."""
    return priced_assignment(profit)[0]


def _solver(keys: list[str], slot: str, item: str):
    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        edges = rows[rows[item].notna()]
        table = edges.pivot(index=slot, columns=item, values="profit")  # refuses an edge given twice
        table = table.reindex(sorted(rows[slot].unique()))
        times = edges.groupby(item)["copies"].first().reindex(table.columns).to_numpy(int)
        matrix, names = np.repeat(table.to_numpy(float), times, axis=1), np.repeat(table.columns.to_numpy(), times)
        pairs, slot_prices, item_prices, empty = priced_assignment(matrix)
        chosen = dict(pairs)
        at = [chosen.get(r) for r in range(len(table))]
        slots = pd.DataFrame({"kind": "slot", slot: table.index})
        slots[item] = pd.Series([None if c is None else names[c] for c in at], dtype=object)
        slots["profit"] = [empty if c is None else matrix[r, c] for r, c in enumerate(at)]
        slots["price"], slots["copies"] = slot_prices, 1
        # copies of an item have one price
        priced = pd.DataFrame({"kind": "item", item: names, "price": item_prices, "copies": 1})
        items = priced.groupby(item, as_index=False).agg(price=("price", "min"), copies=("copies", "sum"))
        items["kind"], items[slot], items["profit"] = "item", None, None
        out = pd.concat([f.astype(object) for f in (slots, items)], ignore_index=True)
        for k in keys:
            out[k] = rows[k].iloc[0]
        return out[[*keys, "kind", slot, item, "profit", "price", "copies"]]

    return solve


def largest_group(edges: DataFrame, keys: list[str], slot: str) -> int:
    """Slots of the group with most slots (one number)."""
    sizes = edges.groupBy(*keys).agg(F.count_distinct(slot).alias("s"))
    return sizes.agg(F.max("s")).first()[0] or 0


def keep_contenders(
    edges: DataFrame, keys: list[str], slot: str, item: str, most: int | None = None
) -> DataFrame:
    """Drop edges that no best schedule needs.

    With s slots in a group, a slot's s best items suffice: the other slots can take at most s - 1
    of them.  ``most`` is the largest s over all groups.
    """
    most = largest_group(edges, keys, slot) if most is None else most
    best = Window.partitionBy(*keys, slot).orderBy(F.desc("profit"), F.col(item))
    return edges.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= most).drop("_n")


def known_edges(edges: DataFrame) -> DataFrame:
    """Edges with a profit; null and NaN are none."""
    return edges.where(F.col("profit").isNotNull() & ~F.isnan(F.col("profit").cast("double")))


def solve_groups(
    edges: DataFrame, keys: list[str], slot: str, item: str, copies: str | None = None,
    slots: DataFrame | None = None,
) -> DataFrame:
    """Best schedule of each group with its prices: one row per slot and one per item in question.

    ``kind`` is slot or item.  A slot's row has its item, profit and price; an empty one has no item
    and the value that the proof gives it as profit.  An item's row has its price and how often it
    may run.  Items without a row have price 0.  ``slots`` (keys and slot) lists slots that may have no
    edge at all.

    Groups are solved independently.  After ``keep_contenders`` a group has at most s² edges for
    its s calendar slots, whatever the number of items, and is solved exactly in one task.  An edge
    given twice is refused.
    """
    ship(edges.sparkSession)
    number = F.col(copies).cast("int") if copies else F.lit(1)
    known = known_edges(edges)
    rows = known if copies else keep_contenders(known, keys, slot, item)
    rows = rows.select(*keys, slot, item, F.col("profit").cast("double"), number.alias("copies"))
    places = edges.select(*keys, slot)
    places = (places if slots is None else places.unionByName(slots.select(*keys, slot))).distinct()
    nothing = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in (item, "profit", "copies")]
    types = {f.name: f.dataType for f in rows.schema} | {"kind": T.StringType(), "price": T.DoubleType()}
    columns = [*keys, "kind", slot, item, "profit", "price", "copies"]
    schema = T.StructType([T.StructField(c, types[c]) for c in columns])
    return (
        rows.unionByName(places.select(*keys, slot, *nothing)).groupBy(*keys)
        .applyInPandas(_solver(keys, slot, item), schema)
    )


def assign(
    edges: DataFrame, keys: list[str], slot: str, item: str, copies: str | None = None,
    slots: DataFrame | None = None,
) -> DataFrame:
    """Best schedule per group: each slot gets one item, each item (copy) one slot.

    A slot left empty has a null item and a null profit; see ``solve_groups``.
    """
    solved = solve_groups(edges, keys, slot, item, copies, slots).where("kind = 'slot'")
    profit = F.when(F.col(item).isNotNull(), F.col("profit"))
    return solved.select(*keys, slot, item, profit.alias("profit"))


def proof(edges: DataFrame, solved: DataFrame, keys: list[str], slot: str, item: str) -> DataFrame:
    """Per group whether a stored result of ``solve_groups`` is a best schedule, from its prices.

    Counts slots, filled slots and items that run too often; ``gap`` is profit less prices, relative, and
    ``above`` the most by which an edge, also one left out before solving, exceeds the prices of
    its slot and item.  Both are zero up to rounding if and only if the prices prove the schedule.
    """
    of_slot, of_item = (
        solved.where(F.col("kind") == k).select(*keys, c, F.col("price").alias(f"_{k}"))
        for k, c in (("slot", slot), ("item", item))
    )
    over = F.col("profit") - F.col("_slot") - F.coalesce("_item", F.lit(0.0))
    worst = (
        known_edges(edges).join(of_slot, [*keys, slot], "left").join(of_item, [*keys, item], "left")
        .groupBy(*keys).agg(F.max(F.coalesce(over, F.lit(float("inf")))).alias("_worst"))
    )
    is_slot = F.col("kind") == "slot"
    uses = (
        solved.where(F.col(item).isNotNull()).groupBy(*keys, item)
        .agg(F.count_if(is_slot).alias("_uses"), F.max(F.when(~is_slot, F.col("copies"))).alias("_may"))
        .groupBy(*keys).agg(F.count_if(F.col("_uses") > F.coalesce("_may", F.lit(0))).alias("n_repeated"))
    )
    sums = solved.groupBy(*keys).agg(
        F.count_if(is_slot).alias("n_slots"),
        F.count_if(is_slot & F.col(item).isNotNull()).alias("n_filled"),
        F.sum(F.when(is_slot, F.col("profit")).otherwise(0.0)).alias("_profit"),
        F.sum(F.col("price") * F.col("copies")).alias("_prices"),
    )
    gap = F.abs(F.col("_profit") - F.col("_prices")) / F.greatest(F.abs("_profit"), F.lit(1.0))
    return sums.join(uses, keys, "left").join(worst, keys, "left").select(
        *keys, "n_slots", "n_filled", F.coalesce("n_repeated", F.lit(0)).alias("n_repeated"),
        gap.alias("gap"), F.greatest(F.coalesce("_worst", F.lit(0.0)), F.lit(0.0)).alias("above"),
    )


def calendar_slots(days: DataFrame, day: str = "broadcast_day", slot: str = "ts") -> DataFrame:
    """Distinct slots of a table with their day: the list that schedules must fill."""
    return days.select(day, slot).distinct()


def assign_flat(
    edges: DataFrame, group: str = "week", slot: str = "ts", item: str = "product_code",
    slots: DataFrame | None = None,
) -> DataFrame:
    """One level: each product at most once per group (planning week)."""
    return assign(edges, [group], slot, item, slots=slots)


def assign_categories(
    profits: DataFrame, draws: DataFrame, day: str = "broadcast_day", slot: str = "ts"
) -> DataFrame:
    """Level one: the best category per slot, each category used at most as often as drawn.

    ``profits`` has one row per slot and category (calendar times categories).  Slots of days without
    a drawn category come back empty.
    """
    edges = profits.join(draws, [day, "category"])
    return assign(edges, [day], slot, "category", copies="draws", slots=calendar_slots(profits, day, slot))


def product_edges(
    grid: DataFrame, categories: DataFrame, candidates: DataFrame, day: str = "broadcast_day",
    slot: str = "ts", pred: str = "pred",
) -> DataFrame:
    """Profit of each candidate product on the slots of its category."""
    chosen = categories.select(day, slot, "category")  # one row per calendar slot
    offered = lookup_join(grid, chosen, [day, slot, "category"], "inner")
    allowed = offered.join(candidates, [day, "product_code"], "left_semi")
    return allowed.groupBy(day, "category", slot, "product_code").agg(F.avg(pred).alias("profit"))


def assign_products(
    edges: DataFrame, day: str = "broadcast_day", slot: str = "ts", categories: DataFrame | None = None
) -> DataFrame:
    """Level two: the best product per slot within each day and category.

    ``categories`` (level one) lists the slots to fill; those without any candidate come back empty.
    """
    slots = None if categories is None else categories.where("category IS NOT NULL").select(day, "category", slot)
    return assign(edges, [day, "category"], slot, "product_code", slots=slots)


def total_profit(schedule: DataFrame, scale: float = K.PROFIT_SCALE) -> DataFrame:
    return schedule.agg(F.sum(scaled_profit("profit", scale)).alias("total_profit"))


def schedule_lookup(schedule: DataFrame, items: DataFrame, catalogue: DataFrame, key: str) -> DataFrame:
    """Schedule with item names and catalogue columns."""
    return schedule.join(items, key, "left").join(catalogue, key, "left")


def schedule_pivot(schedule: DataFrame, categories: Sequence[str], slot: str = "ts") -> DataFrame:
    """Slots by categories with 1 where the category is scheduled."""
    return schedule.groupBy(slot).pivot("category", list(categories)).count().fillna(0)


def submission(
    raw: DataFrame, parts: Sequence[DataFrame], columns: Sequence[str] = K.BASE_COLUMNS
) -> DataFrame:
    """Predicted rows plus the unpriced rows with zero sales, by time."""
    unpriced = raw.where(F.col("unit_price") == 0).withColumn("sales", F.lit(0.0))
    return stack([unpriced.select(*columns), *[p.select(*columns) for p in parts]]).orderBy(
        "ts", "product_code"
    )
