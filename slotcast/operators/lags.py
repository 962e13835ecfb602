"""Features from earlier weeks, days, hours and shows.

All of them aggregate to one row per key and period first and look the shifted period up, so no
window ever holds the raw rows of one key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import constants as K
from ..functions.scalar import week_start
from . import ordered as O
from .lookup import lookup_join


def mean_of(column: str) -> Column:
    return F.avg(column)


def distinct_shows(column: str = "show_id") -> Column:
    return F.count_distinct(column)


def prev_week(
    df: DataFrame, key: str, measures: Mapping[str, Column], day: str = "ymd",
    source: DataFrame | None = None,
) -> DataFrame:
    """Measures of the key in the calendar week before; 0 in the first week of the data.

    Null where the key has no row in the week before.  All measures of a key come from one
    aggregate and one join.  Here and below ``source`` is the table to aggregate; it defaults to
    ``df`` and should be a stored stage when ``df`` is a long plan.
    """
    source = df if source is None else source
    weekly = (
        source.where(F.col(key).isNotNull())
        .groupBy(key, F.date_add(week_start(day), 7).alias("_week"))
        .agg(*[m.alias(n) for n, m in measures.items()])
    )
    first = source.select(F.min(week_start(day))).scalar()
    joined = lookup_join(df.withColumn("_week", week_start(day)), weekly, [key, "_week"])
    starts = F.col("_week") == first
    return joined.withColumns(
        {n: F.when(starts, F.lit(0)).otherwise(F.col(n)) for n in measures}
    ).drop("_week")


def prev_day(
    df: DataFrame, key: str | None, measures: Mapping[str, Column], day: str = "ymd",
    source: DataFrame | None = None,
) -> DataFrame:
    """Measures on the previous day present in the data; 0 on the first day.

    With ``key`` they are taken per key, else over the whole day.
    """
    source = df if source is None else source
    by_day = Window.orderBy(day)  # one row per calendar day
    chain = source.select(day).distinct().withColumn("_prev_day", F.lag(day).over(by_day))
    keys = [key] if key else []
    known = source.where(F.col(key).isNotNull()) if key else source
    daily = known.groupBy(*keys, F.col(day).alias("_prev_day")).agg(
        *[m.alias(n) for n, m in measures.items()]
    )
    dated = df.join(F.broadcast(chain), day)  # one row per calendar day
    joined = lookup_join(dated, daily, [*keys, "_prev_day"])
    starts = F.col("_prev_day").isNull()
    return joined.withColumns(
        {n: F.when(starts, F.lit(0)).otherwise(F.col(n)) for n in measures}
    ).drop("_prev_day")


def prev_week_mean_price(df: DataFrame, key: str, name: str) -> DataFrame:
    return prev_week(df, key, {name: mean_of("unit_price")})


def prev_week_show_count(df: DataFrame, key: str, name: str) -> DataFrame:
    return prev_week(df, key, {name: distinct_shows()})


def prev_day_mean_price(df: DataFrame, name: str, key: str = "category") -> DataFrame:
    return prev_day(df, key, {name: mean_of("unit_price")})


def prev_day_show_count(df: DataFrame, name: str, key: str = "category") -> DataFrame:
    return prev_day(df, key, {name: distinct_shows()})


def prev_day_mean_price_all(df: DataFrame, name: str = "lag_all_price_day") -> DataFrame:
    return prev_day(df, None, {name: mean_of("unit_price")})


def prev_show_mean_price(
    df: DataFrame, name: str = "lag_all_price_show", show: str = "show_id",
    chunks: int | None = None, source: DataFrame | None = None,
) -> DataFrame:
    """Mean unit price of the show before, in order of first appearance; 0 for the first show.

    Shows may be almost as many as rows, so they are stored once, in order, and not as a lookup again.
    """
    shows = (df if source is None else source).where(F.col(show).isNotNull()).groupBy(show).agg(
        F.min("ts").alias("_first"), F.avg("unit_price").alias("_price")
    )
    ordered = O.in_buckets(shows, "_first", show, chunks=chunks)
    seq = O.with_previous(ordered, ["_price"], "_prev")
    before = O.without_order(seq).select(
        show, F.when(F.col("_prev").isNull(), F.lit(0.0)).otherwise(F.col("_prev._price")).alias(name)
    )
    return lookup_join(df, before, show, rows=ordered.count())


def lag_sales(
    df: DataFrame, lags: Sequence[int], prefix: str, within: str | None = None,
    partition: int | None = None, source: DataFrame | None = None,
) -> DataFrame:
    """Sales of the same hour on the n-th previous observed day, for each n in ``lags``.

    With ``within``/``partition`` only rows of that partition are used and get values.
    """
    source = df if source is None else source
    part = source if within is None else source.where(F.col(within) == partition)
    hourly = part.groupBy("ymd", "hours").agg(F.coalesce(F.sum("sales"), F.lit(0.0)).alias("_sum"))
    same_hour = Window.partitionBy("hours").orderBy("ymd")  # hours of the calendar
    names = [f"{prefix}{n}" for n in lags]
    lagged = hourly.select(
        "ymd", "hours", *[F.lag("_sum", n).over(same_hour).alias(c) for n, c in zip(lags, names)]
    )
    joined = df.join(F.broadcast(lagged), ["ymd", "hours"], "left")  # one row per calendar hour
    if within is None:
        return joined
    keep = F.col(within) == partition
    return joined.withColumns({c: F.when(keep, F.col(c)) for c in names})


def lag_sales_divided(df: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """Weekday rows get lags 1..5 among weekdays, weekend rows lags 1, 2 among weekends."""
    df = lag_sales(df, K.WEEKDAY_LAGS, "lag_sales_wd_", "weekends", 0, source)
    return lag_sales(df, K.WEEKEND_LAGS, "lag_sales_wk_", "weekends", 1, source)


def rolling_means(
    df: DataFrame, days: Sequence[int] = K.ROLLING_DAYS, key: str = "category",
    value: str = "sales", prefix: str = "rolling_mean_", source: DataFrame | None = None,
) -> DataFrame:
    """Mean of the key's rows in the n days before the row's day, for each n in ``days``."""
    daily = (
        (df if source is None else source)
        .where(F.col(key).isNotNull())
        .groupBy(key, "ymd")
        .agg(F.sum(value).alias("_sum"), F.count(value).alias("_n"))
        .withColumn("_day", F.unix_date("ymd"))
    )
    by_day = Window.partitionBy(key).orderBy("_day")  # one row per key and calendar day
    means = {}
    for n in days:
        before = by_day.rangeBetween(-n, -1)
        means[f"{prefix}{n}"] = F.try_divide(F.sum("_sum").over(before), F.sum("_n").over(before))
    table = daily.withColumns(means).select(key, "ymd", *means)
    return lookup_join(df, table, [key, "ymd"])


def price_to_rate(
    df: DataFrame, columns: Sequence[str] = K.PRICE_RATE_COLUMNS, price: str = "unit_price"
) -> DataFrame:
    """Lag prices as a ratio to the current price."""
    present = [c for c in columns if c in df.columns]
    return df.withColumns({c: F.try_divide(F.col(c).cast("double"), F.col(price)) for c in present})
