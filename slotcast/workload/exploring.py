"""Exploratory report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lists, reports
from ..sources import bindings as B
from .base import feat, query, r, rs, sql


def _mean_query(name, keys, value="sales", where=None, table="feat"):
    by = ", ".join(keys)

    @query(name, sql(f"SELECT {by}, {rs(f'avg({value})', 'mean')} FROM {table} WHERE {where or 'TRUE'} GROUP BY {by}"))
    def means(spark, sf):
        rows = feat(spark, sf)
        rows = rows if where is None else rows.where(where)
        return reports.group_table(rows, keys, mean=F.avg(value)).select(*keys, r("mean", "mean"))


def _per_show_query(name, keys, value="sales", where=None):
    by = ", ".join(keys)

    @query(
        name,
        sql(f"SELECT {by}, {rs(f'sum({value}) / count(DISTINCT show_id)', 'per_show')} FROM feat"
            f" WHERE {where or 'TRUE'} GROUP BY {by}"),
    )
    def per_show(spark, sf):
        rows = feat(spark, sf)
        rows = rows if where is None else rows.where(where)
        return reports.sales_per_show(rows, keys, value).select(*keys, r("per_show", "per_show"))


_mean_query("mean_by_rounded_hour_weekday", ["japp", "weekdays"])
_mean_query("mean_by_hour_of_week_category", ["hours_inweek", "category"])
_mean_query("mean_by_hour_of_week", ["hours_inweek"])
_mean_query("mean_price_by_hour_weekday", ["japp", "weekdays"], "unit_price")
_mean_query("mean_by_week", ["week_num"])
_mean_query("daily_mean_sales", ["ymd"])
_per_show_query("per_show_by_hour_weekday", ["japp", "weekdays"])
_per_show_query("calls_per_show_by_hour_weekday", ["japp", "weekdays"], "volume")
_per_show_query("per_show_by_day", ["months", "days"])
_per_show_query("per_show_by_month_weekday", ["months", "weekdays"])
_per_show_query("volume_per_show_by_month_weekday", ["months", "weekdays"], "volume")
_per_show_query("volume_per_show_by_category_month", ["category", "months"], "volume")
_per_show_query("volume_per_show_weekdays", ["category", "hours"], "volume", "weekends <> 1")
_per_show_query("volume_per_show_weekends", ["category", "hours"], "volume", "weekends = 1")
_per_show_query("per_show_one_category_by_month", ["months"], "sales", "category = 'purchase'")


@query(
    "total_by_hour_of_week",
    sql(f"SELECT hours_inweek, {rs('sum(sales)', 'total', 7)}, count(*) AS n, {rs('sum(volume)', 'volume')} FROM feat GROUP BY 1"),
)
def total_by_hour_of_week(spark, sf):
    table = reports.group_table(
        feat(spark, sf), ["hours_inweek"], total=F.sum("sales"), n=F.count(F.lit(1)), volume=F.sum("volume")
    )
    return table.select("hours_inweek", r("total", "total", 7), "n", r("volume", "volume"))


@query(
    "hourly_by_category",
    sql(
        f"""SELECT japp, category, {rs('sum(sales)', 'sales', 7)}, count(sales) AS n, {rs('sum(volume)', 'volume')}
            FROM feat GROUP BY 1, 2"""
    ),
)
def hourly_by_category(spark, sf):
    table = reports.group_table(
        feat(spark, sf), ["japp", "category"], sales=F.sum("sales"), n=F.count("sales"), volume=F.sum("volume")
    )
    return table.select("japp", "category", r("sales", "sales", 7), "n", r("volume", "volume"))


@query(
    "mean_by_keyword_flag",
    sql(
        f"""SELECT men, {rs('avg(sales)', 'mean')} FROM (
              SELECT sales, CASE WHEN category IN ('view', 'click', 'purchase')
                                 THEN CASE WHEN contains(product_name, 'red') THEN 1 ELSE 0 END END AS men FROM feat)
            GROUP BY men"""
    ),
)
def mean_by_keyword_flag(spark, sf):
    from ..functions.scalar import keyword_flag_or_null

    flag = keyword_flag_or_null("category", "product_name", ("view", "click", "purchase"), "red")
    rows = feat(spark, sf).withColumn("men", flag)
    return reports.group_table(rows, ["men"], mean=F.avg("sales")).select("men", r("mean", "mean"))


@query(
    "hot_item_shows",
    sql(
        "SELECT original_c, count(DISTINCT show_id) AS shows FROM feat WHERE product_code IN (FROM t) GROUP BY 1",
        """t AS (SELECT product_code FROM (SELECT product_code, sum(sales) / count(DISTINCT show_id) AS s
                 FROM feat GROUP BY 1) ORDER BY s DESC, product_code LIMIT 40)""",
    ),
)
def hot_item_shows(spark, sf):
    rows = feat(spark, sf)
    hot = lists.top_items(rows).select("product_code")
    return rows.join(hot, "product_code", "left_semi").groupBy("original_c").agg(
        F.count_distinct("show_id").alias("shows")
    )


def _dup_sql(key, by="", where="TRUE"):
    cols = f"day_shows{by}"
    return sql(
        f"""SELECT {cols}, {rs('sum(sales) / count(DISTINCT show_id)', 'per_show')} FROM (
              SELECT f.*, d.day_shows FROM feat f LEFT JOIN (
                SELECT ymd, {key}, count(DISTINCT show_id) AS day_shows FROM feat GROUP BY ALL) d
              ON d.ymd = f.ymd AND d.{key} = f.{key}) WHERE {where} GROUP BY {cols}"""
    )


@query("bucket_by_dup", _dup_sql("category"))
def bucket_by_dup(spark, sf):
    return reports.bucket_by_dup(feat(spark, sf)).select("day_shows", r("per_show", "per_show"))


@query("bucket_by_dup_low", _dup_sql("category", where="day_shows <= 21"))
def bucket_by_dup_low(spark, sf):
    return reports.bucket_by_dup(feat(spark, sf), high=21).select("day_shows", r("per_show", "per_show"))


@query("bucket_by_dup_high", _dup_sql("category", where="day_shows > 21"))
def bucket_by_dup_high(spark, sf):
    return reports.bucket_by_dup(feat(spark, sf), low=22).select("day_shows", r("per_show", "per_show"))


@query("bucket_by_dup_category", _dup_sql("category", ", category"))
def bucket_by_dup_category(spark, sf):
    table = reports.bucket_by_dup(feat(spark, sf), by=["category"])
    return table.select("day_shows", "category", r("per_show", "per_show"))


@query("bucket_by_dup_smallc", _dup_sql("small_c"))
def bucket_by_dup_smallc(spark, sf):
    return reports.bucket_by_dup(feat(spark, sf), "small_c").select("day_shows", r("per_show", "per_show"))


@query(
    "dup_levels",
    sql(
        """SELECT day_shows, count(*) AS n FROM (
             SELECT d.day_shows FROM feat f JOIN (
               SELECT ymd, small_c, count(DISTINCT show_id) AS day_shows FROM feat GROUP BY ALL) d
             ON d.ymd = f.ymd AND d.small_c = f.small_c) GROUP BY 1"""
    ),
)
def dup_levels(spark, sf):
    return reports.dup_levels(feat(spark, sf), "small_c")


CORR = ("unit_price", "sales", "exposed", "volume", "hours", "days", "japp", "hours_inweek", "weekends", "k", "week_num")


@query(
    "corr_matrix",
    sql(
        " UNION ALL ".join(
            f"SELECT '{a}' AS col_a, '{b}' AS col_b, {rs(f'corr({a}, {b})', 'corr')} FROM feat"
            for i, a in enumerate(CORR) for b in CORR[i + 1:]
        )
    ),
)
def corr_matrix(spark, sf):
    return reports.corr_matrix(feat(spark, sf), CORR).select("col_a", "col_b", r("corr", "corr"))


TREND = """
daily AS (SELECT ymd, avg(sales) AS v, CAST(row_number() OVER (ORDER BY ymd) - 1 AS DOUBLE) AS x FROM items GROUP BY ymd),
line AS (SELECT regr_slope(v, x) AS a, regr_intercept(v, x) AS b FROM daily),
trend AS (SELECT ymd, x, v, a * x + b AS fitted, v - (a * x + b) AS resid FROM daily, line)
"""


@query(
    "linear_trend",
    sql(f"SELECT ymd, x, {rs('v', 'mean_sales', 7)}, {rs('fitted', 'fitted', 5)}, {rs('resid', 'resid', 5)} FROM trend", TREND),
)
def linear_trend(spark, sf):
    trend = reports.linear_trend(reports.daily_means(B.sales(spark, sf)))
    return trend.select("ymd", "x", r("mean_sales", "mean_sales", 7), r("fitted", "fitted", 5), r("resid", "resid", 5))


LAGS = tuple(range(1, 31))


@query(
    "autocorrelation",
    sql(
        " UNION ALL ".join(
            f"SELECT {k} AS lag, {rs('sum(r * p) / (SELECT sum(r * r) FROM c)', 'acf')} FROM "
            f"(SELECT r, lag(r, {k}) OVER (ORDER BY x) AS p FROM c)"
            for k in LAGS
        ),
        TREND + ", c AS (SELECT x, resid - avg(resid) OVER () AS r FROM trend)",
    ),
)
def autocorrelation(spark, sf):
    trend = reports.linear_trend(reports.daily_means(B.sales(spark, sf)))
    return reports.autocorrelation(trend, LAGS).select("lag", r("acf", "acf"))


def _histogram_query(name, where):
    @query(
        name,
        sql(
            f"""SELECT CAST(greatest(least(floor((sales - lo) / ((hi - lo) / 50)), 49), 0) AS INTEGER) AS bin, count(*) AS n
                FROM items, (SELECT min(sales) AS lo, max(sales) AS hi FROM items WHERE {where}) WHERE {where} GROUP BY 1"""
        ),
    )
    def histogram(spark, sf):
        return reports.histogram(B.sales(spark, sf).where(where), "sales", 50)


_histogram_query("histogram", "TRUE")
_histogram_query("histogram_one_category", "category = 'PROMO'")


@query(
    "box_stats",
    sql(
        f"""SELECT min(sales) + 0.0 AS min, {rs('quantile_cont(sales, 0.25)', 'q1', 7)}, {rs('quantile_cont(sales, 0.5)', 'median', 7)},
                   {rs('quantile_cont(sales, 0.75)', 'q3', 7)}, max(sales) + 0.0 AS max FROM airings"""
    ),
)
def box_stats(spark, sf):
    box = reports.box_stats(B.airings(spark, sf), "sales")
    return box.select("min", r("q1", "q1", 7), r("median", "median", 7), r("q3", "q3", 7), "max")
