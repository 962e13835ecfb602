"""Joins, unions and aggregations."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import scalar as S
from ..operators import encode, external, lists, reports, shows
from ..operators.lookup import member_flag
from ..session import new_path
from ..sources import bindings as B, tables as T
from .base import feat, query, r, rs, slots, sql
from .lagging import HISTORY, split_history
from .scanning import WEATHER, weather

TREE = ["small_c", "middle_c", "big_c", "original_c"]


@query("add_categories", sql("SELECT ts, product_code, category, small_c, middle_c, big_c, original_c FROM airings"))
def add_categories(spark, sf):
    rows = B.airings(spark, sf)
    return external.add_categories(rows.select("ts", "product_code", "category"), rows, TREE)


def _rates_sql(key):
    return (
        f"(SELECT {key} AS code, ymd, n * 100.0 / max(n) OVER (PARTITION BY {key}) AS rate FROM "
        f"(SELECT {key}, ymd, count(*) AS n FROM airings GROUP BY ALL))"
    )


def _rates(rows, key):
    return B.click_rates(rows, key).withColumnRenamed(key, "code")


@query(
    "add_click_rates",
    sql(
        f"""SELECT a.ts, {rs('s.rate', 'small_click_r')}, {rs('m.rate', 'mid_click_r')}, {rs('b.rate', 'big_click_r')}
            FROM airings a
            LEFT JOIN {_rates_sql('small_c')} s ON s.code = a.small_c AND s.ymd = a.ymd
            LEFT JOIN {_rates_sql('middle_c')} m ON m.code = a.middle_c AND m.ymd = a.ymd
            LEFT JOIN {_rates_sql('big_c')} b ON b.code = a.big_c AND b.ymd = a.ymd"""
    ),
)
def add_click_rates(spark, sf):
    rows = out = B.airings(spark, sf)
    names = {"small_c": "small_click_r", "middle_c": "mid_click_r", "big_c": "big_click_r"}
    for key, name in names.items():
        out = external.add_click_rate(out, _rates(rows, key), key, name)
    return out.select("ts", *[r(n, n) for n in names.values()])


LEVELS = {"small": "small_c", "middle": "middle_c", "big": "big_c"}


def _level_share_query(name, measures, modulo):
    cols = ", ".join(rs(f"{lv}.{m}", f"{m}_{lv}") for lv in LEVELS for m in measures)
    joins = " ".join(
        f"LEFT JOIN (SELECT {key} AS code, ymd, "
        + ", ".join(
            f"avg(CASE WHEN CAST(product_code AS BIGINT) % {modulo} = {i} THEN 1.0 ELSE 0.0 END) AS {m}"
            for i, m in enumerate(measures)
        )
        + f" FROM airings GROUP BY ALL) {lv} ON {lv}.code = a.{key} AND {lv}.ymd = a.ymd"
        for lv, key in LEVELS.items()
    )

    @query(name, sql(f"SELECT a.ts, {cols} FROM airings a {joins}"))
    def level_shares(spark, sf):
        rows = B.airings(spark, sf)
        by = F.col("product_code").cast("long") % modulo
        # one table of codes of all three levels, joined once per level
        table = encode.stack(
            [
                B.shares(rows, key, by, measures).withColumnRenamed(key, "code").withColumn(
                    "code", F.concat(F.lit(f"{lv}:"), "code")
                )
                for lv, key in LEVELS.items()
            ]
        )
        coded = rows.withColumns(
            {f"{lv}_code": F.concat(F.lit(f"{lv}:"), key) for lv, key in LEVELS.items()}
        )
        keys = {lv: f"{lv}_code" for lv in LEVELS}
        out = external.add_level_shares(coded, table, measures, keys)
        return out.select("ts", *[r(f"{m}_{lv}", f"{m}_{lv}") for lv in LEVELS for m in measures])


_level_share_query("add_age_shares", ["age30", "age40", "age50", "age60above"], 4)
_level_share_query("add_device_shares", ["pc", "mobile"], 2)


@query("add_weather", sql("SELECT a.ts, w.rain, w.temp_diff_s FROM airings a LEFT JOIN weather w USING (ymd)", WEATHER))
def add_weather(spark, sf):
    return external.add_weather(B.airings(spark, sf), weather(spark, sf)).select("ts", "rain", "temp_diff_s")


def forecast_table(rows):
    """Mean sales of the same hour on earlier days, per calendar hour."""
    hourly = rows.groupBy("ymd", "hours").agg(F.sum("sales").alias("_s"), F.count("sales").alias("_n"))
    before = Window.partitionBy("hours").orderBy("ymd").rowsBetween(Window.unboundedPreceding, -1)
    pred = F.try_divide(F.sum("_s").over(before), F.sum("_n").over(before))
    return hourly.select("ymd", "hours", pred.alias("ts_pred"))


FORECAST = """
forecast AS (
  SELECT ymd, hours, sum(s) OVER w / nullif(sum(n) OVER w, 0) AS ts_pred
  FROM (SELECT ymd, hours, sum(sales) AS s, count(sales) AS n FROM feat GROUP BY ALL)
  WINDOW w AS (PARTITION BY hours ORDER BY ymd ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
"""


@query("add_forecast", sql(f"SELECT ts, {rs('ts_pred', 'ts_pred')} FROM feat LEFT JOIN forecast USING (ymd, hours)", FORECAST))
def add_forecast(spark, sf):
    rows = feat(spark, sf)
    return external.add_forecast(rows, forecast_table(rows)).select("ts", r("ts_pred", "ts_pred"))


@query("parttime_to_rows", sql("SELECT a.ts, a.product_code, q.parttime FROM airings a JOIN slot_seq q USING (ts)"))
def parttime_to_rows(spark, sf):
    seq = shows.runs(slots(spark, sf), "category").select("ts", "parttime")
    return B.airings(spark, sf).select("ts", "product_code").join(seq, "ts", "left")


FITTED = """
freq_list AS (SELECT mother_code FROM (SELECT mother_code, count(DISTINCT show_id) AS s FROM feat GROUP BY 1)
              ORDER BY s DESC, mother_code LIMIT 9 OFFSET 1),
steady_list AS (SELECT mother_code FROM (SELECT mother_code, sum(sales) / count(DISTINCT show_id) AS s FROM feat GROUP BY 1)
                ORDER BY s DESC, mother_code LIMIT 9 OFFSET 1),
prime_list AS (SELECT hours, small_c FROM (
    SELECT hours, small_c, row_number() OVER (PARTITION BY hours ORDER BY sum(sales) DESC, small_c) AS n
    FROM feat GROUP BY hours, small_c) WHERE n <= 2)
"""


@query(
    "member_flag",
    sql(
        """SELECT ts, CASE WHEN mother_code IN (FROM freq_list) THEN 1 ELSE 0 END AS freq,
                  CASE WHEN mother_code IN (FROM steady_list) THEN 1 ELSE 0 END AS steady FROM feat""",
        FITTED,
    ),
)
def member_flags(spark, sf):
    """Lists fitted, written, read back and applied."""
    rows = feat(spark, sf)
    fitted = {"freq": lists.fit_frequent(rows, ranks=(2, 10)), "steady": lists.fit_steady(rows, ranks=(2, 10))}
    folder = new_path(spark, "lists")
    lists.save_lists(fitted, folder)
    for name, table in lists.load_lists(spark, folder, list(fitted)).items():
        rows = member_flag(rows, table, ["mother_code"], name)
    return rows.select("ts", "freq", "steady")


@query(
    "pair_flag",
    sql(
        """SELECT ts, CASE WHEN p.hours IS NOT NULL THEN 1 ELSE 0 END AS prime_smallc
           FROM feat f LEFT JOIN prime_list p ON p.hours = f.hours AND p.small_c = f.small_c""",
        FITTED,
    ),
)
def pair_flag(spark, sf):
    rows = feat(spark, sf)
    return member_flag(rows, lists.fit_prime_items(rows), ["hours", "small_c"], "prime_smallc").select("ts", "prime_smallc")


@query(
    "brand_flag",
    sql(
        """SELECT ts, CASE WHEN mother_code IN (
                    SELECT mother_code FROM power
                    WHERE sales_power > (SELECT quantile_cont(sales_power, 0.7) FROM power)
                      AND unit_price > (SELECT quantile_cont(unit_price, 0.7) FROM power)) THEN 1 ELSE 0 END AS bpower
           FROM power""",
        f"""power AS (SELECT *, {rs("sum(exposed) OVER p / nullif(sum(volume) OVER p, 0)", "sales_power")}
                      FROM feat WINDOW p AS (PARTITION BY product_code))""",
    ),
)
def brand_flag(spark, sf):
    rows = lists.sales_power(feat(spark, sf)).withColumn("sales_power", r("sales_power", "sales_power"))
    return member_flag(rows, lists.fit_brand_power(rows), ["mother_code"], "bpower").select("ts", "bpower")


@query(
    "overlap",
    sql(
        f"""SELECT count(h.original_c) AS shared, {rs('count(h.original_c) * 1.0 / count(*)', 'share')}
            FROM (SELECT DISTINCT original_c FROM test) t
            LEFT JOIN (SELECT DISTINCT original_c FROM hist) h USING (original_c)""",
        HISTORY,
    ),
)
def overlap(spark, sf):
    past, test = split_history(spark, sf)
    return reports.overlap(test, past, "original_c").select("shared", r("share", "share"))


@query(
    "triplet_tournament",
    sql(
        """SELECT winner AS small_c, count(*) AS wins FROM (
             SELECT CASE WHEN a.s >= b.s AND a.s >= c.s THEN a.small_c
                         WHEN b.s >= c.s THEN b.small_c ELSE c.small_c END AS winner
             FROM best a JOIN best b ON a.small_c < b.small_c JOIN best c ON b.small_c < c.small_c)
           GROUP BY winner""",
        "best AS (SELECT small_c, max(n) AS s FROM (SELECT small_c, ymd, count(*) AS n FROM airings GROUP BY ALL) GROUP BY 1)",
    ),
)
def triplet_tournament(spark, sf):
    daily = B.airings(spark, sf).groupBy("small_c", "ymd").agg(F.count(F.lit(1)).alias("n"))
    best = daily.groupBy("small_c").agg(F.max("n").alias("s"))
    return reports.triplet_wins(best, "small_c", "s")


@query(
    "semi_filter",
    sql("SELECT ts, sales FROM feat WHERE (hours, small_c) IN (SELECT (hours, small_c) FROM prime_list)", FITTED),
)
def semi_filter(spark, sf):
    rows = feat(spark, sf)
    return rows.join(lists.fit_prime_items(rows), ["hours", "small_c"], "left_semi").select("ts", "sales")


@query(
    "anti_filter",
    sql("SELECT ts, sales FROM feat WHERE mother_code NOT IN (FROM freq_list)", FITTED),
)
def anti_filter(spark, sf):
    rows = feat(spark, sf)
    return rows.join(lists.fit_frequent(rows, ranks=(2, 10)), "mother_code", "left_anti").select("ts", "sales")


@query(
    "sales_power",
    sql("SELECT ts, " + rs("sum(exposed) OVER p / nullif(sum(volume) OVER p, 0)", "sales_power")
        + " FROM feat WINDOW p AS (PARTITION BY product_code)"),
)
def sales_power(spark, sf):
    return lists.sales_power(feat(spark, sf)).select("ts", r("sales_power", "sales_power"))


@query(
    "sales_power_by_show",
    sql(
        f"""SELECT product_code, {rs('sum(m) / nullif(sum(v), 0)', 'sales_power')} FROM (
              SELECT product_code, show_id, arg_min(min_range, ts) AS m, sum(volume) AS v FROM feat GROUP BY 1, 2)
            GROUP BY 1"""
    ),
)
def sales_power_by_show(spark, sf):
    return lists.sales_power_by_show(feat(spark, sf)).select("product_code", r("sales_power", "sales_power"))


def _dup_query(name, key):
    @query(
        name,
        sql(
            f"""SELECT f.ts, coalesce(d.n, 0) AS {name} FROM feat f LEFT JOIN (
                  SELECT ymd, {key}, count(DISTINCT show_id) AS n FROM feat WHERE {key} IS NOT NULL GROUP BY ALL) d
                ON d.ymd = f.ymd AND d.{key} = f.{key}"""
        ),
    )
    def dup(spark, sf):
        return lists.dup_times(feat(spark, sf), key, name).select("ts", name)


_dup_query("dup_times", "category")
_dup_query("dup_times_smallc", "small_c")


@query(
    "category_mix",
    sql(
        f"""SELECT category, {rs('sum(s) / (SELECT count(DISTINCT ymd) + 1 FROM airings)', 'mix')} FROM (
              SELECT coalesce(category, 'All') AS category,
                     n / sum(CASE WHEN category IS NULL THEN n END) OVER (PARTITION BY ymd) AS s
              FROM (SELECT ymd, category, CAST(sum(n) AS DOUBLE) AS n FROM (
                      SELECT ymd, category, count(DISTINCT show_id) AS n FROM feat GROUP BY ALL)
                    GROUP BY CUBE (ymd, category))) GROUP BY category"""
    ),
)
def category_mix(spark, sf):
    return reports.category_mix(feat(spark, sf)).select("category", r("mix", "mix"))


@query(
    "category_mix_plain",
    sql(
        f"""SELECT category, {rs('sum(s) / (SELECT count(DISTINCT ymd) FROM airings)', 'mix')} FROM (
              SELECT category, n * 1.0 / sum(n) OVER (PARTITION BY ymd) AS s FROM (
                SELECT ymd, category, count(DISTINCT show_id) AS n FROM feat GROUP BY ALL)) GROUP BY category"""
    ),
)
def category_mix_plain(spark, sf):
    return reports.category_mix(feat(spark, sf), include_margin=False).select("category", r("mix", "mix"))


@query(
    "slot_category_profit",
    sql("SELECT show_id AS slot, category, " + rs("avg(sales)", "profit") + " FROM feat GROUP BY 1, 2"),
)
def slot_category_profit(spark, sf):
    rows = feat(spark, sf).select(F.col("show_id").alias("slot"), "category", F.col("sales").alias("pred"))
    return reports.slot_category_profit(rows).select("slot", "category", r("profit", "profit"))


@query(
    "slot_product_profit",
    sql("SELECT show_id AS slot, product_code, " + rs("avg(sales)", "profit") + " FROM feat GROUP BY 1, 2"),
)
def slot_product_profit(spark, sf):
    rows = feat(spark, sf).select(F.col("show_id").alias("slot"), "product_code", F.col("sales").alias("pred"))
    table = reports.slot_category_profit(rows, ("slot", "product_code"))
    return table.select("slot", "product_code", r("profit", "profit"))


CATEGORIES = ("click", "error", "purchase", "signup", "view")


def _unstack_query(name, agg, measure, fill):
    cols = ", ".join(
        rs(("coalesce({}, 0)" if fill is not None else "{}").format(f"{agg.format(c=c)}"), c, 7) for c in CATEGORIES
    )

    @query(name, sql(f"SELECT japp, {cols} FROM feat GROUP BY japp"))
    def wide(spark, sf):
        table = reports.unstack(feat(spark, sf), "japp", "category", CATEGORIES, measure(), fill)
        return table.select("japp", *[r(c, c, 7) for c in CATEGORIES])


_unstack_query("unstack_sum", "sum(sales) FILTER (category = '{c}')", lambda: F.sum("sales"), 0.0)
_unstack_query("unstack_mean", "avg(sales) FILTER (category = '{c}')", lambda: F.avg("sales"), None)
_unstack_query("unstack_count", "count(sales) FILTER (category = '{c}')", lambda: F.count("sales"), 0)


@query(
    "item_catalog",
    sql("SELECT product_code, product_name, row_number() OVER (ORDER BY product_code, product_name) - 1 AS row_num"
        " FROM (SELECT DISTINCT product_code, product_name FROM airings)"),
)
def item_catalog(spark, sf):
    return reports.item_catalog(B.airings(spark, sf))


@query("value_counts", sql("SELECT small_c, count(*) AS n FROM items GROUP BY 1"))
def value_counts(spark, sf):
    return reports.value_counts(B.sales(spark, sf), "small_c")


@query(
    "show_week_mean_total",
    sql(
        f"""SELECT week_num, {rs('sum(m)', 'sum_of_show_means', 5)}, {rs('sum(s)', 'raw_sum', 5)} FROM (
              SELECT week_num, show_id, avg(sales) AS m, sum(sales) AS s FROM feat GROUP BY 1, 2) GROUP BY 1"""
    ),
)
def show_week_mean_total(spark, sf):
    return reports.show_week_mean_total(feat(spark, sf)).select(
        "week_num", r("sum_of_show_means", "sum_of_show_means", 5), r("raw_sum", "raw_sum", 5)
    )


@query(
    "union_outer",
    sql(
        """SELECT ts, sales, days AS weekday_only, NULL::INTEGER AS weekend_only FROM feat WHERE weekends = 0
           UNION ALL SELECT ts, sales, NULL::BIGINT, hours FROM feat WHERE weekends = 1"""
    ),
)
def union_outer(spark, sf):
    rows = feat(spark, sf)
    weekday = rows.where("weekends = 0").select("ts", "sales", F.col("days").alias("weekday_only"))
    weekend = rows.where("weekends = 1").select("ts", "sales", F.col("hours").alias("weekend_only"))
    return encode.stack([weekday, weekend], outer=True)


@query("union_all", sql("SELECT ymd, category, product_code FROM airings UNION ALL SELECT ymd, category, product_code FROM items"))
def union_all(spark, sf):
    cols = ["ymd", "category", "product_code"]
    return encode.stack([B.airings(spark, sf).select(cols), B.sales(spark, sf).select(cols)])


@query("distinct_items", sql("SELECT DISTINCT product_code, small_c FROM items"))
def distinct_items(spark, sf):
    return B.sales(spark, sf).select("product_code", "small_c").distinct()


@query("intersect_items", sql("SELECT product_code FROM airings INTERSECT SELECT product_code FROM items"))
def intersect_items(spark, sf):
    return B.airings(spark, sf).select("product_code").intersect(B.sales(spark, sf).select("product_code"))


@query(
    "first_row_per_key",
    sql("SELECT product_code, ts, category, sales FROM airings QUALIFY row_number() OVER (PARTITION BY product_code ORDER BY ts) = 1"),
)
def first_row_per_key(spark, sf):
    rows = B.airings(spark, sf).select("product_code", "ts", "category", "sales")
    return reports.first_row_per_key(rows, "product_code", ["ts"])


@query("show_total", sql("SELECT ts, " + rs("sum(sales) OVER (PARTITION BY show_id)", "show_sales", 7) + " FROM feat"))
def show_total(spark, sf):
    return reports.show_total(feat(spark, sf)).select("ts", r("show_sales", "show_sales", 7))


def _share_query(name, agg, measure):
    @query(
        name,
        sql(f"SELECT japp, category, {rs('v / sum(v) OVER (PARTITION BY japp)', 'share')} FROM "
            f"(SELECT japp, category, CAST({agg} AS DOUBLE) AS v FROM feat GROUP BY 1, 2)"),
    )
    def share(spark, sf):
        return reports.row_share(feat(spark, sf), "japp", "category", measure()).select("japp", "category", r("share", "share"))


_share_query("row_share_sales", "sum(sales)", lambda: F.sum("sales"))
_share_query("row_share_count", "count(sales)", lambda: F.count("sales"))
_share_query("row_share_volume", "sum(volume)", lambda: F.sum("volume"))
