"""Scans, sinks and row-wise features."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import scalar as S
from ..operators import encode, external, lags
from ..session import new_path
from ..sources import bindings as B, tables as T
from .base import feat, query, r, rs, sql, u_sql

EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
EVENTS = "SELECT event_id, ts, user_id, event_type, value, props FROM events"


@query("read_parquet", EVENTS)
def read_parquet(spark, sf):
    return T.read_table(spark, f"{sf}/events.parquet", EVENT_SCHEMA)


def _round_trip(spark, sf, fmt):
    events = T.read_table(spark, f"{sf}/events.parquet", EVENT_SCHEMA)
    path = T.write_table(events, new_path(spark, fmt), fmt)
    return T.read_table(spark, path, EVENT_SCHEMA, fmt)


@query("read_csv", EVENTS)
def read_csv(spark, sf):
    return _round_trip(spark, sf, "csv")


@query("read_json", EVENTS)
def read_json(spark, sf):
    return _round_trip(spark, sf, "json")


@query(
    "normalise_sales",
    sql(
        "SELECT date_trunc('minute', ts) AS ts, product_code, mother_code, product_name, category,"
        " ymd, exposed_min AS exposed, unit_price, sales, "
        + rs("sales / nullif(unit_price, 0)", "volume")
        + " FROM airings"
    ),
)
def normalise_sales(spark, sf):
    raw = B.airings(spark, sf).select(
        F.date_format("ts", T.TS_FORMAT).alias("ts"),
        "exposed_min",
        F.col("mother_code").cast("long").alias("mother_code"),
        F.col("product_code").cast("long").alias("product_code"),
        "product_name",
        "category",
        "unit_price",
        F.col("sales").alias(" sales "),
    )
    return T.normalise_sales(raw).select(
        "ts", "product_code", "mother_code", "product_name", "category", "ymd", "exposed",
        "unit_price", "sales", r("volume", "volume"),
    )


TRENDS = """
daily AS (SELECT category, ymd, count(*) AS n FROM airings GROUP BY ALL),
rates AS (SELECT category, ymd, n * 100.0 / max(n) OVER (PARTITION BY category) AS rate FROM daily)
"""


@query("flatten_click_trends", sql("SELECT category, ymd AS date, " + rs("rate", "click_rate") + " FROM rates", TRENDS))
def flatten_click_trends(spark, sf):
    rates = B.click_rates(B.airings(spark, sf), "category")
    point = F.struct(F.date_format("ymd", "yyyy-MM-dd").alias("period"), F.col("click_rate").alias("ratio"))
    one = rates.groupBy("category").agg(F.sort_array(F.collect_list(point)).alias("data"))  # calendar days
    body = F.to_json(F.struct(F.array(F.struct(F.col("category").alias("title"), "data")).alias("results")))
    flat = external.flatten_click_trends(one.select(body.alias("body")))
    return flat.select("category", "date", r("click_rate", "click_rate"))


@query(
    "extract_links",
    """
    WITH found AS (
      SELECT page_id, unnest(regexp_extract_all(html, '<a( [^>]*>[^<]*)</a>', 1)) AS a,
             generate_subscripts(regexp_extract_all(html, '<a( [^>]*>[^<]*)</a>', 1), 1) - 1 AS place
      FROM pages),
    parts AS (
      SELECT page_id, place, a, regexp_extract(a, 'href="([^"]*)"', 1) AS href,
             regexp_extract(a, '>([^<]*)$', 1) AS name
      FROM found)
    SELECT page_id, CAST(place AS INTEGER) AS place,
           CASE WHEN regexp_matches(href, '[.,;]$') THEN 'end' ELSE 'inner' END AS level,
           substr(href, 2, 8) AS code,
           CASE WHEN regexp_matches(href, '[.,;]$')
                THEN substr(name, 1, greatest(length(name) - 1, 0)) ELSE name END AS name
    FROM parts WHERE regexp_matches(a, ' href="/')
    """,
)
def extract_links(spark, sf):
    markers = {"end": r'href="/[^"]*[.,;]"', "inner": r'href="/'}
    return external.extract_links(
        B.table(spark, sf, "pages"), markers, (2, 8), trim_text={"end": 1}
    )


WEATHER = f"""
spine AS (SELECT CAST(unnest(generate_series((SELECT min(ymd) FROM airings)::TIMESTAMP,
          (SELECT max(ymd) FROM airings)::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS ymd),
raw_weather AS (
  SELECT ymd, round(15 + 15 * {u_sql('high', 'CAST(ymd AS VARCHAR)')}, 1) AS high,
         round(-5 + 15 * {u_sql('low', 'CAST(ymd AS VARCHAR)')}, 1) AS low,
         round(0 + 10 * {u_sql('rain', 'CAST(ymd AS VARCHAR)')}, 1) AS rain FROM spine),
weather AS (SELECT ymd, round(high - low, 7) AS temp_diff_s, CASE WHEN rain >= 5 THEN 1 ELSE 0 END AS rain
            FROM raw_weather)
"""


def weather(spark, sf):
    raw = B.weather_raw(T.calendar_of(B.table(spark, sf, "events").select(F.to_date("ts").alias("ymd")), "ymd"))
    return external.derive_weather(raw).withColumn("temp_diff_s", r("temp_diff_s", "t", 4))


@query("derive_weather", sql("SELECT ymd, temp_diff_s, rain FROM weather", WEATHER))
def derive_weather(spark, sf):
    return weather(spark, sf)


@query(
    "calendar",
    "SELECT CAST(unnest(generate_series((SELECT min(l_shipdate) FROM lineitem),"
    " (SELECT max(l_shipdate) FROM lineitem), INTERVAL 1 DAY)) AS DATE) AS ymd",
)
def calendar(spark, sf):
    return T.calendar_of(B.sales(spark, sf), "ymd")


@query("time_parts", sql("SELECT ts, years, months, days, hours, week_num FROM feat"))
def time_parts(spark, sf):
    return B.slots(spark, sf).select("ts", *[c.alias(n) for n, c in S.time_parts("ts").items()])


@query("weekday_name", sql("SELECT ts, dayname(ts) AS weekdays FROM items"))
def weekday_name(spark, sf):
    return B.sales(spark, sf).select("ts", S.weekday_name("ts").alias("weekdays"))


@query("hours_inweek", sql("SELECT ts, hours_inweek FROM feat"))
def hours_inweek(spark, sf):
    return B.slots(spark, sf).select("ts", S.hours_in_week("ts").alias("hours_inweek"))


@query("holidays", sql("SELECT ts, holidays FROM feat"))
def holidays(spark, sf):
    return B.slots(spark, sf).select("ts", S.holiday("ymd", B.HOLIDAYS).alias("holidays"))


@query("red_days", sql("SELECT ts, red FROM feat"))
def red_days(spark, sf):
    return B.slots(spark, sf).select("ts", S.red_day("ymd", B.HOLIDAYS).alias("red"))


@query("weekends", sql("SELECT ts, weekends FROM feat"))
def weekends(spark, sf):
    return B.slots(spark, sf).select("ts", S.weekend("ymd", B.HOLIDAYS).alias("weekends"))


@query("min_start", sql("SELECT ts, CAST((minute(ts) // 20) * 20 AS INTEGER) AS min_start FROM feat"))
def min_start(spark, sf):
    return B.slots(spark, sf).select("ts", S.minute_start("ts").alias("min_start"))


@query("rounded_hour", sql("SELECT ts, japp FROM feat"))
def rounded_hour(spark, sf):
    return B.slots(spark, sf).select("ts", S.rounded_hour("ts").alias("japp"))


@query(
    "rounded_hour_coarse",
    sql("SELECT ts, (hour(ts) + CASE WHEN (minute(ts) // 20) * 20 >= 30 THEN 1 ELSE 0 END) % 24 AS japp FROM feat"),
)
def rounded_hour_coarse(spark, sf):
    """Rounded from the 20-minute start instead of the minute."""
    coarse = S.rounded_hour("ts", S.minute_start("ts"))
    return B.slots(spark, sf).select("ts", coarse.alias("japp"))


@query(
    "round_exposed",
    sql("SELECT ts, CASE WHEN exposed < 25 THEN 20 WHEN exposed >= 25 THEN 30 END AS exposed_t FROM gaps"),
)
def round_exposed(spark, sf):
    return B.airings_with_gaps(spark, sf, B.slots).select("ts", S.rounded_exposure("exposed").alias("exposed_t"))


@query(
    "primetime",
    sql(
        """SELECT ts, CASE
             WHEN weekends = 1 AND hours IN (7, 8, 9) THEN 1
             WHEN weekends = 1 AND hours IN (13, 15, 16, 17) THEN 2
             WHEN holidays = 0 AND hours IN (9, 10, 11) THEN 1
             WHEN holidays = 0 AND hours IN (16, 17, 18) THEN 2 ELSE 0 END AS primetime FROM feat"""
    ),
)
def primetime(spark, sf):
    return feat(spark, sf).select("ts", S.prime_time("hours", "red", "holidays").alias("primetime"))


FLAG_CATEGORIES = ("view", "click", "purchase")


@query(
    "keyword_flag",
    sql(
        """SELECT ts, CASE WHEN category IN ('view', 'click', 'purchase') AND contains(product_name, 'red')
                      THEN 1 ELSE 0 END AS men,
                  CASE WHEN category IN ('view', 'click', 'purchase')
                       THEN CASE WHEN contains(product_name, 'red') THEN 1 ELSE 0 END END AS men_or_null
           FROM airings"""
    ),
)
def keyword_flag(spark, sf):
    return B.airings(spark, sf).select(
        "ts",
        S.keyword_flag("category", "product_name", FLAG_CATEGORIES, "red").alias("men"),
        S.keyword_flag_or_null("category", "product_name", FLAG_CATEGORIES, "red").alias("men_or_null"),
    )


@query("luxury", sql("SELECT ts, CASE WHEN unit_price >= 905 THEN 1 ELSE 0 END AS luxury FROM airings"))
def luxury(spark, sf):
    return B.airings(spark, sf).select("ts", S.luxury("unit_price", 905).alias("luxury"))


@query(
    "pay_class",
    sql(
        """SELECT ts, CASE WHEN contains(product_name, 'red') OR contains(product_name, 'small') THEN 'ilsibul'
                           WHEN contains(product_name, 'ring') OR contains(product_name, 'hot') THEN 'muiza'
                           ELSE 'none' END AS pay FROM airings"""
    ),
)
def pay_class(spark, sf):
    rules = (("ilsibul", ("red", "small")), ("muiza", ("ring", "hot")))
    return B.airings(spark, sf).select("ts", S.keyword_class("product_name", rules).alias("pay"))


_SEASONS_SQL = ", ".join(
    f"CASE WHEN small_c IN ({', '.join(repr(i) for i in items)}) THEN 1 ELSE 0 END AS {s}"
    for s, items in B.SEASONS.items()
)


@query("season_flags", sql(f"SELECT ts, {_SEASONS_SQL} FROM airings"))
def season_flags(spark, sf):
    flags = S.season_flags("small_c", B.SEASONS)
    return B.airings(spark, sf).select("ts", *[c.alias(n) for n, c in flags.items()])


PRICED = "SELECT ts, sales, CASE WHEN k % 10 = 0 THEN 0.0 ELSE unit_price END AS unit_price FROM gaps"


def _priced(spark, sf):
    price = F.when(F.col("k") % 10 == 0, 0.0).otherwise(F.col("unit_price"))
    return B.airings_with_gaps(spark, sf).select("ts", "sales", price.alias("unit_price"))


@query("drop_rows_train", sql(f"SELECT * FROM ({PRICED}) WHERE sales IS NOT NULL AND sales <> 50000"))
def drop_rows_train(spark, sf):
    return encode.drop_rows(_priced(spark, sf), "train")


@query("drop_rows_test", sql(f"SELECT * FROM ({PRICED}) WHERE unit_price IS NULL OR unit_price <> 0"))
def drop_rows_test(spark, sf):
    return encode.drop_rows(_priced(spark, sf), "test")


@query(
    "price_to_rate",
    sql(
        "SELECT ts, " + rs("lag_bigcat_price_day / nullif(unit_price, 0)", "lag_bigcat_price_day")
        + """ FROM (SELECT f.ts, f.unit_price, CASE WHEN c.prev_ymd IS NULL THEN 0 ELSE d.p END AS lag_bigcat_price_day
                 FROM airings f JOIN day_chain c USING (ymd)
                 LEFT JOIN (SELECT ymd, category, avg(unit_price) AS p FROM airings GROUP BY ALL) d
                   ON d.ymd = c.prev_ymd AND d.category = f.category)"""
    ),
)
def price_to_rate(spark, sf):
    lagged = lags.prev_day_mean_price(B.airings(spark, sf), "lag_bigcat_price_day")
    return lags.price_to_rate(lagged).select("ts", r("lag_bigcat_price_day", "lag_bigcat_price_day"))


@query(
    "drop_useless",
    sql(
        "SELECT product_code, category, small_c, middle_c, big_c, original_c, unit_price, sales, k,"
        " months, weekdays, hours_inweek, weekends, japp, show_id FROM feat"
    ),
)
def drop_useless(spark, sf):
    return encode.drop_useless(feat(spark, sf))


@query(
    "na_to_zeroes",
    sql(
        """SELECT ts, coalesce(rm, 0) AS rolling_mean_7, coalesce(mc, 0) AS mid_click_r, sales
           FROM (SELECT ts, CASE WHEN k % 10 <> 0 THEN sales END AS rm,
                        CASE WHEN k % 7 <> 0 THEN unit_price END AS mc,
                        CASE WHEN k % 50 <> 7 THEN sales END AS sales FROM airings)"""
    ),
)
def na_to_zeroes(spark, sf):
    rows = B.airings(spark, sf).select(
        "ts",
        F.when(F.col("k") % 10 != 0, F.col("sales")).alias("rolling_mean_7"),
        F.when(F.col("k") % 7 != 0, F.col("unit_price")).alias("mid_click_r"),
        F.when(F.col("k") % 50 != 7, F.col("sales")).alias("sales"),
    )
    return encode.na_to_zeroes(rows)


@query("select_common", sql("SELECT ts, ymd, product_code, mother_code, category, middle_c, small_c, unit_price, sales FROM airings"))
def select_common(spark, sf):
    return encode.select_common(B.airings(spark, sf), B.sales(spark, sf))


@query(
    "broadcast_day",
    sql("SELECT ts, CAST(ts - INTERVAL 1 HOUR - INTERVAL 1 MICROSECOND AS DATE) AS broadcast_day FROM airings"),
)
def broadcast_day(spark, sf):
    return B.slots(spark, sf).select("ts", S.broadcast_day("ts").alias("broadcast_day"))


@query("day_hour", sql("SELECT ts, CAST(days AS VARCHAR) || '/' || CAST(hours AS VARCHAR) AS day_hour FROM feat"))
def day_hour(spark, sf):
    return feat(spark, sf).select("ts", S.day_hour("days", "hours").alias("day_hour"))


@query(
    "shifted_day",
    sql(
        """SELECT months, days, CAST(CASE WHEN months = 12 THEN days - 1 WHEN months = 7 THEN days + 28
                  ELSE days - 2 END AS INTEGER) AS shifted,
                  CAST(CASE WHEN months = 12 THEN days - 1 ELSE days - 2 END AS INTEGER) AS shifted_plain,
                  count(*) AS n
           FROM (SELECT month(ymd) AS months, day(ymd) AS days FROM items)
           WHERE months IN (6, 12) OR (months = 7 AND days IN (1, 2)) GROUP BY ALL"""
    ),
)
def shifted_day(spark, sf):
    from ..operators.history import history_window

    rows = B.sales(spark, sf).select(F.month("ymd").alias("months"), F.dayofmonth("ymd").alias("days"))
    return history_window(rows).groupBy(
        "months", "days", S.shifted_day("months", "days").alias("shifted"),
        S.shifted_day("months", "days", carry_july=False).alias("shifted_plain"),
    ).agg(F.count(F.lit(1)).alias("n"))


TEST_FACTORS = {
    12: {"STANDARD": 1.112, "PROMO": 1.141, "LARGE": 0.994, "MEDIUM": 0.792, "ECONOMY": 1.357},
    6: {"STANDARD": 1.12, "PROMO": 1.307, "LARGE": 0.897, "MEDIUM": 0.752, "ECONOMY": 1.351},
}


def _factor_sql(month):
    arms = " ".join(f"WHEN '{c}' THEN {f}" for c, f in TEST_FACTORS[month].items())
    return f"CASE category {arms} ELSE 1.0 END"


@query(
    "growth_adjust",
    sql(
        f"""SELECT category, part, {rs('sum(sales * f)', 'grown', 2)} FROM (
              SELECT category, sales, CASE WHEN month(ymd) = 12 THEN 'dec' ELSE 'jun' END AS part,
                     CASE WHEN month(ymd) = 12 THEN {_factor_sql(12)} ELSE {_factor_sql(6)} END AS f
              FROM items WHERE month(ymd) IN (6, 12) OR (month(ymd) = 7 AND day(ymd) IN (1, 2)))
            GROUP BY category, part"""
    ),
)
def growth_adjust(spark, sf):
    from ..operators.history import grown, history_window

    rows = B.sales(spark, sf).withColumns({"months": F.month("ymd"), "days": F.dayofmonth("ymd")})
    return grown(history_window(rows), TEST_FACTORS).groupBy("category", "part").agg(
        r(F.sum("sales"), "grown", 2)
    )


@query("clamp_negative", sql("SELECT ts, " + rs("greatest(sales - 50, 0)", "prediction") + " FROM airings"))
def clamp_negative(spark, sf):
    return B.slots(spark, sf).select("ts", r(S.clamp_negative(F.col("sales") - 50), "prediction"))


@query("scale_profit", sql("SELECT ts, " + rs("sales * 3", "profit") + " FROM airings"))
def scale_profit(spark, sf):
    return B.slots(spark, sf).select("ts", r(S.scaled_profit("sales"), "profit"))


@query(
    "null_counts",
    sql(
        """SELECT 'exposed' AS column_name, count(*) FILTER (exposed IS NULL) AS nulls FROM gaps UNION ALL
           SELECT 'sales', count(*) FILTER (sales IS NULL) FROM gaps UNION ALL
           SELECT 'ts', count(*) FILTER (ts IS NULL) FROM gaps"""
    ),
)
def null_counts(spark, sf):
    return T.null_counts(B.airings_with_gaps(spark, sf, B.slots).select("exposed", "sales", "ts"))


@query("write_report", sql("SELECT CAST(ts AS DATE) AS ymd, category, " + rs("sum(sales)", "sales", 7) + ", count(*) AS n FROM airings GROUP BY 1, 2"))
def write_report(spark, sf):
    report = B.airings(spark, sf).groupBy("ymd", "category").agg(
        r(F.sum("sales"), "sales", 7), F.count(F.lit(1)).alias("n")
    )
    path = T.write_report(report, new_path(spark, "report"), ["ymd", "category"])
    return T.read_table(spark, path, report.schema, "csv")
