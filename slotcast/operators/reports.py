"""Exploratory tables."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import ship
from . import ordered as O
from .lists import dup_times, per_show


def group_table(df: DataFrame, keys: Sequence[str], **measures: Column) -> DataFrame:
    return df.groupBy(*keys).agg(*[m.alias(n) for n, m in measures.items()])


def unstack(
    df: DataFrame, index: str, column: str, values: Sequence, measure: Column, fill: float | None = None
) -> DataFrame:
    """Long to wide: one column per listed value."""
    wide = df.groupBy(index).pivot(column, list(values)).agg(measure)
    return wide if fill is None else wide.fillna(fill)


def row_share(df: DataFrame, index: str, column: str, measure: Column, name: str = "share"):
    """Each group's part of its index total, on the long form."""
    cells = df.groupBy(index, column).agg(measure.cast("double").alias("_v"))
    total = F.sum("_v").over(Window.partitionBy(index))
    return cells.withColumn(name, F.try_divide(F.col("_v"), total)).drop("_v")


def sales_per_show(df: DataFrame, keys: Sequence[str], value: str = "sales") -> DataFrame:
    return df.groupBy(*keys).agg(per_show(value).alias("per_show"))


def show_total(df: DataFrame, show: str = "show_id") -> DataFrame:
    """Sales of the row's show."""
    totals = df.groupBy(show).agg(F.sum("sales").alias("show_sales"))
    return df.join(totals, show, "left")


def first_row_per_key(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The first row of each key."""
    rest = [c for c in df.columns if c != key]
    row = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(key).agg(row.alias("_r")).select(key, "_r.*").select(*df.columns)


def bucket_by_dup(
    df: DataFrame, key: str = "category", low: int | None = None, high: int | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Sales per show at each level of same-day shows of the key, within [low, high]."""
    counted = dup_times(df, key, "day_shows")
    if low is not None:
        counted = counted.where(F.col("day_shows") >= low)
    if high is not None:
        counted = counted.where(F.col("day_shows") <= high)
    return sales_per_show(counted, ["day_shows", *by])


def dup_levels(df: DataFrame, key: str) -> DataFrame:
    return dup_times(df, key, "day_shows").groupBy("day_shows").agg(F.count(F.lit(1)).alias("n"))


def item_catalog(df: DataFrame, code: str = "product_code", name: str = "product_name") -> DataFrame:
    """Distinct (code, name) pairs with a running row number."""
    pairs = df.select(code, name).distinct()
    placed = O.with_position(O.in_order(pairs, code, name))
    return placed.select(code, name, F.col(O.POSITION).alias("row_num"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def category_mix(df: DataFrame, include_margin: bool = True) -> DataFrame:
    """Average over days of each category's share of the day's shows.

    With ``include_margin`` the row of column totals takes part in the average and the total
    column (``category`` = 'All') is kept, as in a table with margins.
    """
    shows = df.groupBy("ymd", "category").agg(F.count_distinct("show_id").cast("double").alias("_n"))
    cells = shows.cube("ymd", "category").agg(
        F.sum("_n").alias("_n"),
        F.grouping("ymd").alias("_all_days"),
        F.grouping("category").alias("_all_cats"),
    )
    if not include_margin:
        cells = cells.where(F.col("_all_days") == 0)
    total = F.sum(F.when(F.col("_all_cats") == 1, F.col("_n"))).over(
        Window.partitionBy("_all_days", "ymd")  # one row per category
    )
    shared = cells.withColumn("_share", F.try_divide("_n", total))
    rows = F.count_distinct("_all_days", F.coalesce("ymd", F.lit("1900-01-01").cast("date")))
    n_rows = cells.select(rows).scalar()
    if not include_margin:
        shared = shared.where(F.col("_all_cats") == 0)
    name = F.when(F.col("_all_cats") == 1, F.lit("All")).otherwise(F.col("category"))
    return (
        shared.groupBy(name.alias("category"))
        .agg(F.sum("_share").alias("_sum"))
        .select("category", (F.col("_sum") / n_rows).alias("mix"))
    )


def slot_category_profit(
    df: DataFrame, keys: Sequence[str] = ("slot", "category"), pred: str = "pred"
) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(pred).alias("profit"))


def show_week_mean_total(df: DataFrame) -> DataFrame:
    """Per week: sum of the shows' mean sales, and the raw sum."""
    per = df.groupBy("week_num", "show_id").agg(
        F.avg("sales").alias("_mean"), F.sum("sales").alias("_sum")
    )
    return per.groupBy("week_num").agg(
        F.sum("_mean").alias("sum_of_show_means"), F.sum("_sum").alias("raw_sum")
    )


def overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """How many distinct keys of ``left`` also occur in ``right``, and their share."""
    keys = left.select(key).distinct()
    other = right.select(key).distinct().withColumn("_hit", F.lit(1))
    joined = keys.join(other, key, "left")
    hits = F.count("_hit")
    return joined.agg(
        hits.alias("shared"),
        F.try_divide(hits.cast("double"), F.count(F.lit(1)).cast("double")).alias("share"),
    )


def triplet_wins(df: DataFrame, key: str, strength: str) -> DataFrame:
    """Wins of each key over all 3-combinations, won by the strongest of the three.

    Equal strength goes to the smaller key.  A key beats every pair drawn from the keys ranked
    behind it, so the count follows from its rank: with m keys behind it there are m(m-1)/2 pairs.
    No triplet is ever built.
    """
    placed = O.with_position(O.in_order(df.select(key, strength), F.desc(strength), F.col(key)))
    placed = placed.withColumn("_total", placed.select(F.count(F.lit(1))).scalar())
    behind = F.col("_total") - 1 - F.col(O.POSITION)
    wins = (behind * (behind - 1) / 2).cast("long")
    return placed.select(key, wins.alias("wins")).where(F.col("wins") > 0)


MOMENTS = "col_a string, col_b string, n double, odd double, mx double, my double, cxx double, cyy double, cxy double"


def pair_moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, means and centred products of each pair of columns, one row per pair and partition.

    A pair counts the rows where both are known; ``odd`` are those with a NaN or infinite value, which
    the sums leave out.  A batch of rows is a matrix with zeros for nulls, and the sums of all pairs are
    four products of such matrices, so no row is unfolded.
    """
    columns, pairs = list(columns), list(combinations(range(len(columns)), 2))

    def moments(batches):
        start, sums = np.full(len(columns), np.nan), None
        for batch in batches:
            raw = [c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]
            known = np.array([c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns], dtype=float)
            fine = np.isfinite(raw) & (known > 0)
            for i in np.flatnonzero(np.isnan(start) & fine.any(axis=1)):
                start[i] = raw[i][fine[i].argmax()]  # values are taken from the first one, against cancellation
            x = np.where(fine, np.array(raw) - start[:, None], 0.0)
            good, odd = fine.astype(float), known * ~fine
            part = np.array([good @ good.T, x @ good.T, (x * x) @ good.T, x @ x.T, odd @ known.T])
            sums = part if sums is None else sums + part
        if sums is None:
            return
        n, s, q, p, odd = sums
        rows = []
        for a, b in pairs:
            m = max(n[a, b], 1.0)
            x, y = s[a, b] / m, s[b, a] / m
            rows.append(
                (columns[a], columns[b], n[a, b], odd[a, b] + odd[b, a], start[a] + x if n[a, b] else 0.0,
                 start[b] + y if n[a, b] else 0.0, q[a, b] - m * x * x, q[b, a] - m * y * y, p[a, b] - m * x * y)
            )
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in zip(*rows)], names=[f.split()[0] for f in MOMENTS.split(", ")])

    if not pairs:
        return df.sparkSession.createDataFrame([], MOMENTS)
    ship(df.sparkSession)
    return df.select([F.col(c).cast("double").alias(c) for c in columns]).mapInArrow(moments, MOMENTS)


def corr_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of each pair of columns over the rows where both are known.

    Null for fewer than two rows or a column that does not vary (a spread below 1e-14 of its mean),
    NaN if a row holds NaN or infinity.  Only one row per pair and partition is shuffled.
    """
    parts = pair_moments(df, columns)
    pair = Window.partitionBy("col_a", "col_b")  # one row per partition of the data
    n = F.sum("n").over(pair)
    means = {f"_{m}": F.try_divide(F.sum(F.col("n") * F.col(m)).over(pair), n) for m in ("mx", "my")}

    def merged(product, left, right):
        return F.sum(F.col(product) + F.col("n") * (F.col(left) - F.col(f"_{left}")) * (F.col(right) - F.col(f"_{right}")))

    sums = parts.withColumns(means).groupBy("col_a", "col_b").agg(
        F.sum("n").alias("n"), F.sum("odd").alias("odd"), F.first("_mx").alias("mx"), F.first("_my").alias("my"),
        merged("cxx", "mx", "mx").alias("cxx"), merged("cyy", "my", "my").alias("cyy"),
        merged("cxy", "mx", "my").alias("cxy"),
    )
    varies = F.lit(True)
    for c, m in (("cxx", "mx"), ("cyy", "my")):
        varies &= (F.col(c) > 0) & (F.col(c) > F.lit(1e-28) * F.col("n") * F.col(m) * F.col(m))
    corr = F.when(F.col("odd") > 0, F.lit(float("nan"))).when(
        (F.col("n") > 1) & varies, F.col("cxy") / F.sqrt("cxx") / F.sqrt("cyy")
    )
    return sums.select("col_a", "col_b", corr.alias("corr"))


def daily_means(df: DataFrame, value: str = "sales") -> DataFrame:
    return df.groupBy("ymd").agg(F.avg(value).alias("mean_sales"))


def linear_trend(daily: DataFrame, value: str = "mean_sales") -> DataFrame:
    """Least-squares line over the days in order; (ymd, x, value, fitted, resid)."""
    # one row per calendar day
    days = daily.withColumn("x", (F.row_number().over(Window.orderBy("ymd")) - 1).cast("double"))
    line = days.agg(
        F.regr_slope(F.col(value), F.col("x")).alias("slope"),
        F.regr_intercept(F.col(value), F.col("x")).alias("intercept"),
    )
    days = days.withColumns(
        {"slope": line.select("slope").scalar(), "intercept": line.select("intercept").scalar()}
    )
    fitted = F.col("slope") * F.col("x") + F.col("intercept")
    return days.withColumn("fitted", fitted).withColumn("resid", F.col(value) - F.col("fitted"))


def autocorrelation(trend: DataFrame, lags: Sequence[int], value: str = "resid") -> DataFrame:
    """Σ r_t r_{t-k} / Σ r_t², with r centred, for each lag k."""
    centre = F.avg(value).over(Window.partitionBy())  # one row per calendar day
    days = trend.select("x", (F.col(value) - centre).alias("r"))
    in_time = Window.orderBy("x")
    sums = days.select(
        "r", *[(F.col("r") * F.lag("r", k).over(in_time)).alias(f"p{k}") for k in lags]
    ).agg(F.sum(F.col("r") * F.col("r")).alias("s"), *[F.sum(f"p{k}").alias(f"p{k}") for k in lags])
    cells = [
        F.struct(F.lit(k).alias("lag"), F.try_divide(F.col(f"p{k}"), F.col("s")).alias("acf"))
        for k in lags
    ]
    return sums.select(F.inline(F.array(*cells)))


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Counts in ``bins`` equal bins between minimum and maximum; the last bin is closed."""
    bounds = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    lo, hi = bounds.select("lo").scalar(), bounds.select("hi").scalar()
    with_bounds = df.where(F.col(column).isNotNull()).select(column, lo.alias("lo"), hi.alias("hi"))
    place = F.floor((F.col(column) - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins))
    bin_no = F.coalesce(F.least(place.cast("int"), F.lit(bins - 1)), F.lit(0))
    return with_bounds.groupBy(bin_no.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def box_stats(df: DataFrame, column: str) -> DataFrame:
    """Minimum, quartiles and maximum, exact."""
    return O.quantiles(df, column, [0.0, 0.25, 0.5, 0.75, 1.0]).toDF("min", "q1", "median", "q3", "max")
