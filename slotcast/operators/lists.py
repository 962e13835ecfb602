"""Popularity measures and fitted lists.

``fit_*`` returns a small DataFrame; ``lookup.member_flag`` applies it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import constants as K
from ..functions.scalar import safe_divide
from ..session import scratch, settle, stored
from ..sources.tables import read_table, write_table
from . import ordered as O
from .lookup import lookup_join


def sales_power_table(df: DataFrame, key: str = "product_code") -> DataFrame:
    """Exposed minutes per sold unit and key."""
    sums = df.groupBy(key).agg(F.sum("exposed").alias("_minutes"), F.sum("volume").alias("_units"))
    return sums.select(key, safe_divide("_minutes", "_units").alias("sales_power"))


def sales_power(df: DataFrame, key: str = "product_code", source=None) -> DataFrame:
    return lookup_join(df, sales_power_table(df if source is None else source, key), key)


def sales_power_by_show(df: DataFrame, key: str = "product_code") -> DataFrame:
    """Minutes of the key's distinct shows per sold unit."""
    shows = df.groupBy(key, "show_id").agg(
        F.min_by("min_range", "ts").alias("_minutes"), F.sum("volume").alias("_units")
    )
    sums = shows.groupBy(key).agg(F.sum("_minutes").alias("_minutes"), F.sum("_units").alias("_units"))
    return sums.select(key, safe_divide("_minutes", "_units").alias("sales_power"))


def dup_times(df: DataFrame, key: str, name: str = "dup_times", source=None) -> DataFrame:
    """Distinct shows of the key on the row's day; 0 where the key is null."""
    counts = (
        (df if source is None else source)
        .where(F.col(key).isNotNull())
        .groupBy("ymd", key)
        .agg(F.count_distinct("show_id").alias(name))
    )
    return lookup_join(df, counts, ["ymd", key]).withColumn(name, F.coalesce(name, F.lit(0)))


def top_per_group(
    df: DataFrame, group: str, item: str, value: str, n: int, how=F.sum, name: str = "total"
) -> DataFrame:
    """The ``n`` items with the highest aggregate of ``value`` in each group."""
    totals = df.where(F.col(item).isNotNull()).groupBy(group, item).agg(how(value).alias(name))
    best = Window.partitionBy(group).orderBy(F.desc(name), F.col(item))
    return totals.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)


def fit_prime_items(df: DataFrame, n: int = 2) -> DataFrame:
    """Pairs (hours, small_c) of the best-selling small categories per hour."""
    return top_per_group(df, "hours", "small_c", "sales", n).select("hours", "small_c")


def _ranked(df: DataFrame, key: str, measure: Column, ranks: tuple[int, int]) -> DataFrame:
    scores = df.where(F.col(key).isNotNull()).groupBy(key).agg(measure.alias("score"))
    return O.top_rows(scores, [F.desc_nulls_last("score"), F.col(key)], *ranks)


def fit_frequent(
    df: DataFrame, key: str = "mother_code", ranks: tuple[int, int] = K.TOP_LIST_RANKS
) -> DataFrame:
    """Keys ranked by distinct shows; by default ranks 2 to 100."""
    return _ranked(df, key, F.count_distinct("show_id"), ranks)


def fit_steady(
    df: DataFrame, key: str = "mother_code", ranks: tuple[int, int] = K.TOP_LIST_RANKS
) -> DataFrame:
    """Keys ranked by sales per show; by default ranks 2 to 100."""
    return _ranked(df, key, per_show("sales"), ranks)


def fit_brand_power(df: DataFrame, key: str = "mother_code", q: float = K.BRAND_QUANTILE):
    """Keys with a row above the quantile of both sales power and unit price."""
    with scratch(df.sparkSession) as made:
        rows = stored(df.select(key, "sales_power", "unit_price"), "powered")
        cuts = O.quantiles_of(rows, {"sales_power": [q], "unit_price": [q]}, stored=True)
        above = [F.col(c) > F.lit(cut).cast("double") for c, (cut,) in cuts.items()]
        found = settle(rows.where(above[0] & above[1]).select(key).distinct())
        made.free()
    return found


def per_show(value: str) -> Column:
    """Sum of ``value`` per distinct show."""
    return F.try_divide(
        F.coalesce(F.sum(value), F.lit(0.0)).cast("double"),
        F.count_distinct("show_id").cast("double"),
    )


def top_items(df: DataFrame, value: str = "sales", n: int = 40, key: str = "product_code"):
    """Top ``n`` keys by ``value`` per show."""
    scores = df.groupBy(key).agg(per_show(value).alias("score"))
    return O.top_rows(scores, [F.desc_nulls_last("score"), F.col(key)], 1, n)


def share_of_top(df: DataFrame, top: DataFrame, value: str = "sales", key: str = "product_code"):
    """Share of the top keys in the total of ``value``, in percent."""
    marked = df.groupBy(key).agg(F.sum(value).alias("_v")).join(
        top.select(key).withColumn("_top", F.lit(1)), key, "left"
    )
    top_sum = F.sum(F.when(F.col("_top") == 1, F.col("_v")))
    return marked.agg((F.try_divide(top_sum, F.sum("_v")) * 100).alias("top_share"))


def top_mother_codes(df: DataFrame, n: int = 10, key: str = "mother_code") -> DataFrame:
    """Most-aired keys with their first name, total and mean sales."""
    scores = df.groupBy(key).agg(
        F.count("ts").alias("slots"),
        F.min_by("product_name", F.struct("ts", "product_code")).alias("name"),
        F.sum("sales").alias("cum_sales"),
        F.avg("sales").alias("mean_sales"),
    )
    return O.top_rows(scores, [F.desc("slots"), F.col(key)], 1, n)


def top_mother_shares(df: DataFrame, n: int = 10, key: str = "mother_code") -> DataFrame:
    """Share of the most-aired keys in slots, sales and number of keys."""
    scores = df.groupBy(key).agg(F.count("ts").alias("_slots"), F.sum("sales").alias("_sales"))
    top = O.top_rows(scores, [F.desc("_slots"), F.col(key)], 1, n)
    marked = scores.join(top.select(key, F.lit(1).alias("_top")), key, "left")

    def share(value: Column) -> Column:
        of_top = F.sum(F.when(F.col("_top") == 1, value.cast("double")))
        return F.try_divide(of_top, F.sum(value.cast("double")))

    return marked.agg(
        share(F.col("_slots")).alias("slot_share"),
        share(F.col("_sales")).alias("sales_share"),
        share(F.lit(1)).alias("key_share"),
    )


def seasonal_table(df: DataFrame) -> DataFrame:
    """Mean sales and volume per month, day, show and original item."""
    return df.groupBy("months", "days", "show_id", "original_c").agg(
        F.avg("sales").alias("mean_sales"), F.avg("volume").alias("mean_volume")
    )


def seasonal_top(df: DataFrame, n: int = 30) -> DataFrame:
    """The ``n`` best shows of every original item."""
    best = Window.partitionBy("original_c").orderBy(
        F.desc("mean_sales"), "months", "days", "show_id"
    )
    return seasonal_table(df).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)


def seasonal_months(df: DataFrame) -> DataFrame:
    """Shows per original item and month."""
    return seasonal_table(df).groupBy("original_c", "months").agg(F.count(F.lit(1)).alias("shows"))


def extremes(df: DataFrame, value: str, key: str, n: int = 10) -> DataFrame:
    """The ``n`` highest and ``n`` lowest finite values."""
    finite = df.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")))
    high = O.top_rows(finite, [F.desc(value), F.col(key)], 1, n).withColumn("side", F.lit("high"))
    low = O.top_rows(finite, [F.asc(value), F.col(key)], 1, n).withColumn("side", F.lit("low"))
    return high.unionByName(low)


def save_lists(lists: dict[str, DataFrame], folder: str) -> dict[str, str]:
    """Write fitted lists at training time."""
    return {name: write_table(df, f"{folder}/{name}") for name, df in lists.items()}


def load_lists(spark, folder: str, names: list[str]) -> dict[str, DataFrame]:
    """Read fitted lists back at scoring time."""
    return {name: read_table(spark, f"{folder}/{name}") for name in names}
