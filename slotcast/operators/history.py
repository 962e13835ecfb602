"""Last year's values as features of this year's rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalar import day_hour, growth_adjusted, shifted_day
from .. import constants as K
from .lookup import lookup_join


def history_window(train: DataFrame, counterfactual: bool = False) -> DataFrame:
    """Last year's December and June plus 1 and 2 July; without December if counterfactual."""
    june = (F.col("months") == 6) | ((F.col("months") == 7) & F.col("days").isin(1, 2))
    december = F.col("months") == 12
    return train.where(june if counterfactual else (june | december)).withColumn(
        "part", F.when(december, F.lit("dec")).otherwise(F.lit("jun"))
    )


def grown(history: DataFrame, factors: dict[int, dict[str, float]] = K.GROWTH_FACTORS) -> DataFrame:
    """History with sales multiplied by the category's growth factor (an optional step)."""
    december = growth_adjusted("sales", "category", factors[12])
    june = growth_adjusted("sales", "category", factors[6])
    return history.withColumn("sales", F.when(F.col("part") == "dec", december).otherwise(june))


def mean_of_means(
    df: DataFrame, keys: list[str], part: str | Column, values: list[str]
) -> DataFrame:
    """Mean per part first, then the mean of those means."""
    part = F.col(part) if isinstance(part, str) else part
    inner = df.groupBy(*keys, part.alias("_part")).agg(*[F.avg(v).alias(v) for v in values])
    return inner.groupBy(*keys).agg(*[F.avg(v).alias(v) for v in values])


def history_join(df: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Left join of pre-aggregated history."""
    return lookup_join(df, table, keys)


def lag_sales_from_history(
    df: DataFrame, history: DataFrame, columns: list[str], carry_july: bool = True
) -> DataFrame:
    """Lag columns by shifted day and hour, averaged over last year's parts."""
    key = day_hour(shifted_day("months", "days", carry_july), "hours")
    table = mean_of_means(history.withColumn("day_hour", key), ["day_hour"], "part", columns)
    dated = df.withColumn("day_hour", day_hour("days", "hours"))
    return history_join(dated, table, ["day_hour"]).drop("day_hour")


def rolling_from_history(
    df: DataFrame, history: DataFrame, columns: list[str], carry_july: bool = True
) -> DataFrame:
    """Rolling means by shifted day and category, averaged over last year's parts."""
    shifted = history.withColumn("days", shifted_day("months", "days", carry_july))
    table = mean_of_means(shifted, ["days", "category"], "part", columns)
    return history_join(df, table, ["days", "category"])


def mean_sales_origin(
    df: DataFrame, exclude_self: bool = False, source: DataFrame | None = None
) -> DataFrame:
    """Mean sales per month and original item, by default with the row itself."""
    keys = ["months", "original_c"]
    sums = (df if source is None else source).where(F.col("original_c").isNotNull()).groupBy(*keys).agg(
        F.sum("sales").alias("_sum"), F.count("sales").alias("_n")
    )
    joined = lookup_join(df, sums, keys)
    if exclude_self:
        own = F.coalesce(F.col("sales"), F.lit(0.0))
        seen = F.col("sales").isNotNull().cast("int")
        mean = F.try_divide(F.col("_sum") - own, F.col("_n") - seen)
    else:
        mean = F.try_divide(F.col("_sum"), F.col("_n"))
    return joined.withColumn("mean_sales_origin", mean).drop("_sum", "_n")


def mean_sales_origin_from_history(df: DataFrame, history: DataFrame) -> DataFrame:
    """Mean historical sales per original item."""
    table = history.where(F.col("original_c").isNotNull()).groupBy("original_c").agg(
        F.avg("sales").alias("mean_sales_origin")
    )
    return history_join(df, table, ["original_c"])
