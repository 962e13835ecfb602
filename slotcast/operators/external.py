"""External signals: category tree, click rates, weather, forecasts, web pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as K
from ..sources.tables import RESPONSE_SCHEMA
from .lookup import lookup_join

LEVELS = ("small", "middle", "big")


def add_categories(df: DataFrame, tree: DataFrame, columns: list[str]) -> DataFrame:
    """Left join the category tree on (ts, product_code)."""
    keys = ["ts", "product_code"]
    return df.join(tree.select(*keys, *columns), keys, "left")


def add_click_rate(df: DataFrame, rates: DataFrame, key: str, name: str) -> DataFrame:
    """Click rate of one category level; ``rates``: code, ymd, click_rate."""
    side = rates.select(F.col("code").alias(key), "ymd", F.col("click_rate").alias(name))
    return lookup_join(df, side, [key, "ymd"])


def add_level_shares(
    df: DataFrame, rates: DataFrame, measures: list[str], keys: dict[str, str]
) -> DataFrame:
    """Join one share table once per category level; measures get the level as suffix.

    ``keys`` maps level to the row's code column, ``rates`` has code, ymd and the measures.
    """
    for level, key in keys.items():
        named = [F.col(m).alias(f"{m}_{level}") for m in measures]
        df = lookup_join(df, rates.select(F.col("code").alias(key), "ymd", *named), [key, "ymd"])
    return df


def add_weather(df: DataFrame, weather: DataFrame) -> DataFrame:
    """Rain flag and temperature range of the day (one row per calendar day)."""
    return lookup_join(df, weather.select("ymd", "rain", "temp_diff_s"), "ymd")


def add_forecast(df: DataFrame, forecast: DataFrame) -> DataFrame:
    """Forecast of the day and hour (one row per calendar hour)."""
    return lookup_join(df, forecast.select("ymd", "hours", "ts_pred"), ["ymd", "hours"])


def derive_weather(raw: DataFrame, rain_mm: float = K.RAIN_MM) -> DataFrame:
    """Cast the measures, temperature range, rain flag from ``rain_mm`` upwards."""
    cast = raw.withColumns({c: F.col(c).cast("double") for c in ("aver", "high", "low", "rain")})
    return cast.select(
        "ymd",
        (F.col("high") - F.col("low")).alias("temp_diff_s"),
        F.when(F.col("rain") >= rain_mm, 1).when(F.col("rain") < rain_mm, 0).alias("rain"),
    )


def flatten_click_trends(responses: DataFrame, column: str = "body") -> DataFrame:
    """JSON trend responses to rows (category, date, click_rate)."""
    parsed = responses.select(F.explode(F.from_json(column, RESPONSE_SCHEMA)["results"]).alias("r"))
    points = parsed.select(F.col("r.title").alias("category"), F.explode("r.data").alias("p"))
    return points.select(
        "category",
        F.col("p.period").cast("date").alias("date"),
        F.col("p.ratio").cast("double").alias("click_rate"),
    )


def extract_links(
    pages: DataFrame,
    markers: dict[str, str],
    code_slice: tuple[int, int],
    trim_text: dict[str, int] | None = None,
    page_key: str = "page_id",
    html: str = "html",
) -> DataFrame:
    """Anchors of category pages: (page, place, level, code, name).

    ``markers`` maps a level to a regular expression that the attributes of its anchors match.
    ``code`` is the ``code_slice`` (1-based start, length) of the href, ``name`` the anchor text
    without the last ``trim_text[level]`` characters.
    """
    anchors = F.regexp_extract_all(html, F.lit(r"<a( [^>]*>[^<]*)</a>"), F.lit(1))
    rows = pages.select(page_key, F.posexplode(anchors).alias("place", "_anchor"))
    attributes = F.regexp_extract("_anchor", r"^ ([^>]*)>", 1)
    text = F.regexp_extract("_anchor", r">([^<]*)$", 1)
    rows = rows.select(page_key, "place", attributes.alias("_attr"), text.alias("name"))
    level = F
    for name, pattern in markers.items():
        level = level.when(F.col("_attr").rlike(pattern), name)
    name = F.col("name")
    for which, n in (trim_text or {}).items():
        cut = F.substring(name, F.lit(1), F.greatest(F.length(name) - n, F.lit(0)))
        name = F.when(F.col("level") == which, cut).otherwise(name)
    href = F.regexp_extract("_attr", 'href="([^"]*)"', 1)
    return rows.withColumn("level", level).where(F.col("level").isNotNull()).select(
        page_key, "place", "level", F.substring(href, *code_slice).alias("code"), name.alias("name")
    )
