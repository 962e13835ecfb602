"""Sorts, top-k lists and fitted rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate, lists, ordered as O
from ..sources import bindings as B
from .base import feat, query, r, rs, sql


@query(
    "sort_rows",
    sql("SELECT ts, product_code, category, sales, row_number() OVER (ORDER BY ts, product_code) - 1 AS place FROM airings"),
)
def sort_rows(spark, sf):
    rows = B.slots(spark, sf).select("ts", "product_code", "category", "sales")
    placed = O.with_position(O.in_order(rows, "ts", "product_code"), "place")
    return O.without_order(placed)


@query(
    "sort_rows_by_product",
    sql("SELECT ts, product_code, row_number() OVER (ORDER BY product_code, ts) - 1 AS place FROM airings"),
)
def sort_rows_by_product(spark, sf):
    rows = B.slots(spark, sf).select("ts", "product_code")
    return O.without_order(O.with_position(O.in_order(rows, "product_code", "ts"), "place"))


@query(
    "top_per_hour",
    sql(
        f"""SELECT hours, small_c, {rs('s', 'total', 7)}, rank FROM (
              SELECT hours, small_c, sum(sales) AS s,
                     row_number() OVER (PARTITION BY hours ORDER BY sum(sales) DESC, small_c) AS rank
              FROM feat GROUP BY 1, 2) WHERE rank <= 2"""
    ),
)
def top_per_hour(spark, sf):
    best = lists.top_per_group(feat(spark, sf), "hours", "small_c", "sales", 2)
    return best.select("hours", "small_c", r("total", "total", 7), "rank")


@query(
    "freq_items",
    sql(
        """SELECT mother_code, count(DISTINCT show_id) AS score FROM feat GROUP BY 1
           ORDER BY score DESC, mother_code LIMIT 99 OFFSET 1"""
    ),
)
def freq_items(spark, sf):
    return lists.fit_frequent(feat(spark, sf))


@query(
    "freq_products",
    sql(
        """SELECT product_code, count(DISTINCT show_id) AS score FROM feat GROUP BY 1
           ORDER BY score DESC, product_code LIMIT 40"""
    ),
)
def freq_products(spark, sf):
    return lists.fit_frequent(feat(spark, sf), "product_code", (1, 40))


@query(
    "steady_sellers",
    sql(
        f"""SELECT mother_code, {rs('s', 'score')} FROM (
              SELECT mother_code, sum(sales) / count(DISTINCT show_id) AS s FROM feat GROUP BY 1
              ORDER BY s DESC, mother_code LIMIT 99 OFFSET 1)"""
    ),
)
def steady_sellers(spark, sf):
    return lists.fit_steady(feat(spark, sf)).select("mother_code", r("score", "score"))


POWER = f"""
power AS (SELECT *, {rs("sum(exposed) OVER p / nullif(sum(volume) OVER p, 0)", "sales_power")}
          FROM feat WINDOW p AS (PARTITION BY product_code))
"""


@query(
    "brand_power",
    sql(
        """SELECT DISTINCT mother_code FROM power
           WHERE sales_power > (SELECT quantile_cont(sales_power, 0.7) FROM power)
             AND unit_price > (SELECT quantile_cont(unit_price, 0.7) FROM power)""",
        POWER,
    ),
)
def brand_power(spark, sf):
    rows = lists.sales_power(feat(spark, sf))
    return lists.fit_brand_power(rows.withColumn("sales_power", r("sales_power", "sales_power")))


@query(
    "quantiles",
    sql(
        ", ".join(
            f"(SELECT {rs(f'quantile_cont(sales, {q})', 'q')} FROM items) AS q{i}" for i, q in enumerate((0.05, 0.5, 0.7, 0.95))
        ).join(("SELECT ", ""))
    ),
)
def quantiles(spark, sf):
    found = O.quantiles(B.sales(spark, sf), "sales", [0.05, 0.5, 0.7, 0.95])
    return found.select(*[r(c, c) for c in found.columns])


@query(
    "top_items_by_sales",
    sql(
        f"""SELECT product_code, {rs('s', 'score')} FROM (
              SELECT product_code, sum(sales) / count(DISTINCT show_id) AS s FROM feat GROUP BY 1
              ORDER BY s DESC, product_code LIMIT 40)"""
    ),
)
def top_items_by_sales(spark, sf):
    return lists.top_items(feat(spark, sf)).select("product_code", r("score", "score"))


def _share_sql(value):
    return f"""
      SELECT {rs(f'sum({value}) FILTER (product_code IN (FROM t)) / sum({value}) * 100', 'top_share')}
      FROM feat"""


@query(
    "top_items_share",
    sql(
        _share_sql("volume"),
        """t AS (SELECT product_code FROM (SELECT product_code, sum(volume) / count(DISTINCT show_id) AS s
                 FROM feat GROUP BY 1) ORDER BY s DESC, product_code LIMIT 40)""",
    ),
)
def top_items_share(spark, sf):
    rows = feat(spark, sf)
    share = lists.share_of_top(rows, lists.top_items(rows, "volume"), "volume")
    return share.select(r("top_share", "top_share"))


def _top_mothers_sql(table):
    return f"""SELECT mother_code, slots, name, {rs('c', 'cum_sales', 7)}, {rs('m', 'mean_sales')} FROM (
        SELECT mother_code, count(*) AS slots, arg_min(product_name, ts) AS name, sum(sales) AS c, avg(sales) AS m
        FROM {table} GROUP BY 1 ORDER BY slots DESC, mother_code LIMIT 10)"""


@query("top_mother_codes", sql(_top_mothers_sql("feat")))
def top_mother_codes(spark, sf):
    top = lists.top_mother_codes(feat(spark, sf))
    return top.select("mother_code", "slots", "name", r("cum_sales", "cum_sales", 7), r("mean_sales", "mean_sales"))


@query("top_mother_codes_late", sql(_top_mothers_sql("(SELECT * FROM feat WHERE days > 15)")))
def top_mother_codes_late(spark, sf):
    top = lists.top_mother_codes(feat(spark, sf).where("days > 15"))
    return top.select("mother_code", "slots", "name", r("cum_sales", "cum_sales", 7), r("mean_sales", "mean_sales"))


@query(
    "top_mother_shares",
    sql(
        f"""SELECT {rs('sum(n) FILTER (p <= 10) * 1.0 / sum(n)', 'slot_share')},
                   {rs('sum(s) FILTER (p <= 10) / sum(s)', 'sales_share')},
                   {rs('count(*) FILTER (p <= 10) * 1.0 / count(*)', 'key_share')} FROM (
              SELECT n, s, row_number() OVER (ORDER BY n DESC, mother_code) AS p FROM (
                SELECT mother_code, count(*) AS n, sum(sales) AS s FROM feat GROUP BY 1))"""
    ),
)
def top_mother_shares(spark, sf):
    shares = lists.top_mother_shares(feat(spark, sf))
    return shares.select(*[r(c, c) for c in shares.columns])


SEASONAL = """
seasonal AS (SELECT months, days, show_id, original_c, avg(sales) AS mean_sales, avg(volume) AS mean_volume
             FROM feat GROUP BY ALL)
"""


@query(
    "seasonal_top",
    sql(
        f"""SELECT months, days, show_id, original_c, {rs('mean_sales', 'mean_sales')}, {rs('mean_volume', 'mean_volume')}, rank
            FROM (SELECT *, row_number() OVER (PARTITION BY original_c
                    ORDER BY mean_sales DESC, months, days, show_id) AS rank FROM seasonal) WHERE rank <= 30""",
        SEASONAL,
    ),
)
def seasonal_top(spark, sf):
    top = lists.seasonal_top(feat(spark, sf), 30)
    return top.withColumns({c: r(c, c) for c in ("mean_sales", "mean_volume")})


@query("seasonal_months", sql("SELECT original_c, months, count(*) AS shows FROM seasonal GROUP BY 1, 2", SEASONAL))
def seasonal_months(spark, sf):
    return lists.seasonal_months(feat(spark, sf))


@query(
    "sales_power_extremes",
    sql(
        f"""SELECT product_code, {rs('sales_power', 'sales_power')}, side FROM (
              (SELECT *, 'high' AS side FROM p ORDER BY sales_power DESC, product_code LIMIT 10) UNION ALL
              (SELECT *, 'low' AS side FROM p ORDER BY sales_power, product_code LIMIT 10))""",
        "p AS (SELECT product_code, sum(exposed) / nullif(sum(volume), 0) AS sales_power FROM feat GROUP BY 1)",
    ),
)
def sales_power_extremes(spark, sf):
    table = lists.sales_power_table(feat(spark, sf))
    return lists.extremes(table, "sales_power", "product_code").select(
        "product_code", r("sales_power", "sales_power"), "side"
    )


MEAN = rs("avg(sales) OVER (PARTITION BY months, original_c)", "mean_sales_origin")
SCORED = f"""
scored AS (SELECT *, {MEAN} FROM feat),
placed AS (SELECT *, row_number() OVER (ORDER BY mean_sales_origin DESC, ts, product_code) AS p FROM scored)
"""


def scored(spark, sf):
    from ..operators.history import mean_sales_origin

    rows = mean_sales_origin(feat(spark, sf))
    return rows.withColumn("mean_sales_origin", r("mean_sales_origin", "mean_sales_origin"))


@query(
    "top_slice",
    sql("SELECT ts, product_code, CASE WHEN p <= 4004 THEN 'train' ELSE 'val' END AS part FROM placed WHERE p <= 6017", SCORED),
)
def top_slice(spark, sf):
    train, val = evaluate.top_slice(scored(spark, sf), 4004, 2013)
    cols = ["ts", "product_code"]
    return train.select(*cols, F.lit("train").alias("part")).unionByName(
        val.select(*cols, F.lit("val").alias("part"))
    )


@query(
    "mix_predictions",
    sql(f"SELECT ts, product_code, {rs('CASE WHEN p <= 727 THEN mean_sales_origin ELSE sales * 0.9 END', 'prediction')} FROM placed", SCORED),
)
def mix_predictions(spark, sf):
    rows = scored(spark, sf).withColumns(
        {"pred_base": F.col("sales") * 0.9, "pred_top": F.col("mean_sales_origin")}
    )
    mixed = evaluate.mix_predictions(rows, 727)
    return mixed.select("ts", "product_code", r("prediction", "prediction"))
