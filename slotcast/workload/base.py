"""Registry and shared views of the workload."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import scalar as S
from ..operators import shows
from ..sources import bindings as B

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
NUDGE = 0.037


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, if SQL can express it, its DuckDB twin."""

    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def r(column: Column | str, name: str, digits: int = 9) -> Column:
    value = F.col(column) if isinstance(column, str) else column
    # the nudge makes exact ties round alike in both engines; + 0.0 turns -0.0 into 0.0
    nudge = NUDGE * 10.0**-digits
    return (F.round(value.cast("double") + F.lit(nudge), digits) + F.lit(0.0)).alias(name)


def rs(expression: str, name: str, digits: int = 9) -> str:
    return f"round(CAST({expression} AS DOUBLE) + {NUDGE * 10.0**-digits!r}, {digits}) + 0.0 AS {name}"


def zf(expression: str) -> str:
    return (
        f"CASE WHEN length(CAST({expression} AS VARCHAR)) >= 6 THEN CAST({expression} AS VARCHAR) "
        f"ELSE lpad(CAST({expression} AS VARCHAR), 6, '0') END"
    )


def u_sql(seed: str, key: str) -> str:
    return f"(CAST(('0x' || substr(md5('{seed}' || '|' || {key}), 1, 8)) AS BIGINT) / 4294967296.0)"


AIRINGS = f"""
airings AS (
  SELECT e.ts, CAST(e.ts AS DATE) AS ymd, {zf('e.user_id')} AS product_code,
         {zf('e.user_id // 5')} AS mother_code, p.p_name AS product_name, e.event_type AS category,
         p.p_name AS small_c, p.p_brand AS middle_c, p.p_type AS big_c,
         p.p_name || '/' || CAST(p.p_size AS VARCHAR) AS original_c,
         p.p_retailprice AS unit_price, e.value AS sales,
         CAST(10 + (CAST(json_extract(e.props, '$.k') AS INTEGER) % 3) * 10 AS DOUBLE) AS exposed_min,
         CAST(json_extract(e.props, '$.k') AS INTEGER) AS k
  FROM events e LEFT JOIN part p ON e.user_id = p.p_partkey
),
gaps AS (
  SELECT * REPLACE (CASE WHEN k = 99 THEN 50000.0 WHEN k % 50 <> 7 THEN sales END AS sales),
         CASE WHEN k % 10 <> 0 THEN exposed_min END AS exposed
  FROM airings
),
feat AS (
  SELECT *, year(ts) AS years, month(ts) AS months, day(ts) AS days, hour(ts) AS hours,
         week(ts) AS week_num, dayname(ts) AS weekdays,
         hour(ts) + 24 * (isodow(ts) - 1) AS hours_inweek,
         CASE WHEN ymd = DATE '2024-01-01' THEN 1 ELSE 0 END AS red,
         CASE WHEN ymd = DATE '2024-01-01' OR isodow(ts) >= 6 THEN 1 ELSE 0 END AS holidays,
         CASE WHEN ymd <> DATE '2024-01-01' AND isodow(ts) >= 6 THEN 1 ELSE 0 END AS weekends,
         (hour(ts) + CASE WHEN minute(ts) >= 30 THEN 1 ELSE 0 END) % 24 AS japp,
         strftime(ts, '%Y-%m-%d %H') AS show_id, exposed_min AS exposed, 60.0 AS min_range,
         sales / nullif(unit_price, 0) AS volume
  FROM airings
),
items AS (
  SELECT l.l_shipdate AS ts, CAST(l.l_shipdate AS DATE) AS ymd, {zf('l.l_partkey')} AS product_code,
         {zf('l.l_partkey // 5')} AS mother_code, p.p_type AS category, p.p_brand AS middle_c,
         p.p_name AS small_c, l.l_extendedprice / nullif(l.l_quantity, 0) AS unit_price,
         l.l_quantity AS volume, l.l_extendedprice * (1 - l.l_discount) AS sales
  FROM lineitem l LEFT JOIN part p ON l.l_partkey = p.p_partkey
),
slot_prev AS (
  SELECT *, lag(category) OVER (ORDER BY ts) AS p_cat, lag(ts) OVER (ORDER BY ts) AS p_ts,
         lag(exposed_min) OVER (ORDER BY ts) AS p_exp,
         row_number() OVER (PARTITION BY ymd ORDER BY ts) AS n
  FROM airings
),
slot_on AS (
  SELECT *, min(CASE WHEN category = p_cat
                      AND ts <= p_ts + to_microseconds(CAST(p_exp * 60000000 AS BIGINT))
                     THEN 1 ELSE 0 END) OVER (PARTITION BY ymd ORDER BY ts) AS all_on
  FROM slot_prev
),
day_chain AS (SELECT ymd, lag(ymd) OVER (ORDER BY ymd) AS prev_ymd FROM (SELECT DISTINCT ymd FROM airings)),
slot_day AS (
  SELECT s.*, CASE WHEN all_on = 1 AND n <= 8 AND prev_ymd IS NOT NULL THEN prev_ymd ELSE ymd END AS show_day,
         CASE WHEN p_cat IS NULL OR category <> p_cat THEN 1 ELSE 0 END AS starts
  FROM slot_on s JOIN day_chain USING (ymd)
),
slot_run AS (
  SELECT *, sum(starts) OVER (ORDER BY ts) AS run_no,
         sum(starts) OVER (PARTITION BY show_day ORDER BY ts) AS show_no
  FROM slot_day
),
slot_seq AS (
  SELECT ts, ymd, category, show_day, starts, CAST(run_no AS BIGINT) AS run_no,
         CAST(row_number() OVER (PARTITION BY run_no ORDER BY ts) AS INTEGER) AS parttime,
         sum(exposed_min) OVER (PARTITION BY run_no) AS min_range,
         CAST(show_day AS VARCHAR) || ' ' || CAST(show_no AS BIGINT) AS show_id
  FROM slot_run
)
"""


def sql(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([AIRINGS.strip(), *[c.strip() for c in ctes]]) + "\n" + body


def feat(spark: SparkSession, sf_dir: str, aired: DataFrame | None = None) -> DataFrame:
    """Airings with calendar features, an hourly show id and volume; ``aired`` are stored airings."""
    return (B.airings(spark, sf_dir) if aired is None else aired).withColumns(
        {
            **S.time_parts("ts"),
            "weekdays": S.weekday_name("ts"),
            "hours_inweek": S.hours_in_week("ts"),
            "red": S.red_day("ymd", B.HOLIDAYS),
            "holidays": S.holiday("ymd", B.HOLIDAYS),
            "weekends": S.weekend("ymd", B.HOLIDAYS),
            "japp": S.rounded_hour("ts"),
            "show_id": shows.hourly_show_id("ts"),
            "exposed": F.col("exposed_min"),
            "min_range": F.lit(60.0),
            "volume": S.safe_divide("sales", "unit_price"),
        }
    )


def slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slot sequence of the airings."""
    return B.slots(spark, sf_dir).select(
        "ts", "ymd", "product_code", "mother_code", "category", F.col("exposed_min").alias("exposed")
    )
