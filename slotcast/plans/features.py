"""From schedule rows to feature tables.

The stage after the show sequence is stored once.  Every later feature aggregates that stored
stage to a small table and joins it, so the final pass over the rows has no shuffle as long as
the small tables fit their size check.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as K
from ..functions import scalar as S
from ..operators import encode, external, history, lags, lists, shows
from ..operators.lookup import lookup_join, member_flag
from ..session import apart, discard, scratch, settle, sliced, stored
from ..sources.tables import read_table, write_table

GRID_MODES = ("hungarian", "hungarian_h1")
LEVEL_KEYS = {"small": "small_c_code", "middle": "middle_c_code", "big": "big_c_code"}
CLICK_NAMES = {"small": "small_click_r", "middle": "mid_click_r", "big": "big_click_r"}
AGES = ("age30", "age40", "age50", "age60above")
DEVICES = ("pc", "mobile")
LAG_KEYS = (
    ("scode", "product_code"), ("mcode", "mother_code"), ("bigcat", "category"),
    ("small_c", "small_c"),
)


@dataclass(frozen=True)
class FeatureConfig:
    """``mode`` is train, test, hungarian (monthly grid) or hungarian_h1 (weekly grid)."""

    mode: str = "train"
    counterfactual: bool = False
    divided: bool = True
    holidays: tuple[str, ...] | None = None
    seasons: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    run_key: str = "product_code"
    carry_key: str = "mother_code"
    men_categories: tuple[str, ...] = K.MEN_CATEGORIES
    men_keyword: str = K.MEN_KEYWORD
    pay_rules: tuple = K.PAY_RULES
    luxury_price: float = K.LUXURY_PRICE
    list_ranks: tuple[int, int] = K.TOP_LIST_RANKS
    carry_july: bool = True
    grow_history: bool = False
    exclude_self: bool = False

    @property
    def holiday_list(self) -> tuple[str, ...]:
        if self.holidays is not None:
            return self.holidays
        return K.TRAIN_HOLIDAYS if self.mode == "train" else K.TEST_HOLIDAYS


@dataclass(frozen=True)
class SideTables:
    """External tables; ``tree`` holds the category columns per (ts, product_code)."""

    tree: DataFrame | None = None
    clicks: Mapping[str, DataFrame] = field(default_factory=dict)
    age: DataFrame | None = None
    device: DataFrame | None = None
    weather: DataFrame | None = None
    forecast: DataFrame | None = None
    lists: Mapping[str, DataFrame] = field(default_factory=dict)
    history: DataFrame | None = None


@dataclass(frozen=True)
class Features:
    frame: DataFrame
    lists: Mapping[str, DataFrame]


def _calendar(config: FeatureConfig) -> dict[str, Column]:
    days = config.holiday_list
    return {
        **S.time_parts("ts"),
        "weekdays": S.weekday_name("ts"),
        "hours_inweek": S.hours_in_week("ts"),
        "holidays": S.holiday("ymd", days),
        "red": S.red_day("ymd", days),
        "weekends": S.weekend("ymd", days),
        "min_start": S.minute_start("ts"),
        "japp": S.rounded_hour("ts"),
    }


def calendar_columns(df: DataFrame, config: FeatureConfig) -> DataFrame:
    return df.withColumns(_calendar(config))


def item_columns(df: DataFrame, config: FeatureConfig) -> DataFrame:
    return df.withColumns(
        {
            "primetime": S.prime_time("hours", "red", "holidays"),
            "men": S.keyword_flag("category", "product_name", config.men_categories, config.men_keyword),
            "luxury": S.luxury("unit_price", config.luxury_price),
            "pay": S.keyword_class("product_name", config.pay_rules),
            **S.season_flags("small_c", config.seasons),
        }
    )


def fit_lists(base: DataFrame, config: FeatureConfig) -> dict[str, DataFrame]:
    """The four lists fitted on training rows with shows and categories."""
    powered = lists.sales_power(base)
    fitted = {
        "prime_smallc": lists.fit_prime_items(base),
        "freq": lists.fit_frequent(base, ranks=config.list_ranks),
        "steady": lists.fit_steady(base, ranks=config.list_ranks),
        "bpower": lists.fit_brand_power(powered),
    }
    return {name: settle(table) for name, table in fitted.items()}


def apply_lists(df: DataFrame, fitted: Mapping[str, DataFrame]) -> DataFrame:
    """Flags of stored lists."""
    for name, table in fitted.items():
        keys = ["hours", "small_c"] if name == "prime_smallc" else ["mother_code"]
        df = member_flag(df, table, keys, name, stored=True)
    return df


def lag_columns(df: DataFrame, base: DataFrame) -> DataFrame:
    """Previous week per key, previous day per category, previous show."""
    return _small_lags(_large_lags(df, base), base, df.columns)


def _large_lags(df: DataFrame, base: DataFrame, last: bool = False) -> DataFrame:
    """Lags per show and per product and week, stored.

    The shows and the products' weeks may be too many for a broadcast, so both lookups may exchange all
    rows.  They come first, while the rows are narrowest, and each is stored in slices, so that only the
    exchange of one slice lies on disk at a time.  With ``last`` the rows have all that is read of
    ``base`` from then on, so it goes when they are stored.
    """
    rows = base.count()
    with scratch(df.sparkSession) as made:
        with sliced("show_id", rows):
            df = stored(lags.prev_show_mean_price(df, "lag_all_price_show", source=base), "shows")
        made.free(df)
        if last:
            discard(base)
            base = df
        with sliced("product_code", rows):
            df = stored(_week_lags(df, base, LAG_KEYS[:1]), "weeks")
        made.free(df)
    return df


def _week_lags(df: DataFrame, base: DataFrame, keys) -> DataFrame:
    for short, key in keys:
        named = {f"lag_{short}_price": lags.mean_of("unit_price"), f"lag_{short}_count": lags.distinct_shows()}
        df = lags.prev_week(df, key, named, source=base)
    return df


def _small_lags(df: DataFrame, base: DataFrame, first: list[str]) -> DataFrame:
    """The other lags, and all of them in their order after the columns ``first``."""
    df = _week_lags(df, base, LAG_KEYS[1:])
    named = {"lag_bigcat_price_day": lags.mean_of("unit_price"), "lag_bigcat_count_day": lags.distinct_shows()}
    df = lags.prev_day(df, "category", named, source=base)
    late = [c for c in df.columns if c not in (*first, "lag_all_price_show")]
    # the studied feature of this name is per show as well
    return df.select(*first, *late, "lag_all_price_show", F.col("lag_all_price_show").alias("lag_all_price_day"))


def external_columns(df: DataFrame, side: SideTables, config: FeatureConfig) -> DataFrame:
    """Click, age and device signals in one lookup per category level, and weather."""
    if not config.counterfactual:
        for level, key in LEVEL_KEYS.items():
            signals = []
            if level in side.clicks:
                rate = F.col("click_rate").alias(CLICK_NAMES[level])
                signals.append(side.clicks[level].select("code", "ymd", rate))
            for table, measures in ((side.age, AGES), (side.device, DEVICES)):
                if table is not None:
                    named = [F.col(m).alias(f"{m}_{level}") for m in measures]
                    signals.append(table.select("code", "ymd", *named))
            if signals:
                both = reduce(lambda a, b: a.join(b, ["code", "ymd"], "full"), signals)
                df = lookup_join(df, both.withColumnRenamed("code", key), [key, "ymd"])
    return df if side.weather is None else external.add_weather(df, side.weather)


def sales_history_columns(
    df: DataFrame, base: DataFrame, side: SideTables, config: FeatureConfig
) -> DataFrame:
    """Rolling means, item means and hourly lags: own past in training, last year's otherwise."""
    if config.mode == "train":
        df = lags.rolling_means(df, source=base)
        df = history.mean_sales_origin(df, config.exclude_self, source=base)
        if config.divided:
            df = lags.lag_sales_divided(df, source=base)
        else:
            df = lags.lag_sales(df, K.UNDIVIDED_LAGS, "lag_sales_", source=base)
    else:
        past = history.history_window(side.history, config.counterfactual)
        if config.grow_history and not config.counterfactual:
            past = history.grown(past)
        if config.divided:
            names = [f"lag_sales_wd_{n}" for n in K.WEEKDAY_LAGS]
            names += [f"lag_sales_wk_{n}" for n in K.WEEKEND_LAGS]
        else:
            names = [f"lag_sales_{n}" for n in K.UNDIVIDED_LAGS]
        names = [n for n in names if n in past.columns]
        if not names:
            raise ValueError("history lacks the sales lags that this mode takes over")
        rolling = [f"rolling_mean_{n}" for n in K.ROLLING_DAYS]
        df = history.rolling_from_history(df, past, rolling, config.carry_july)
        df = history.mean_sales_origin_from_history(df, past)
        df = history.lag_sales_from_history(df, past, names, config.carry_july)
    return df if side.forecast is None else external.add_forecast(df, side.forecast)


def stage(rows: DataFrame, side: SideTables, config: FeatureConfig) -> DataFrame:
    """Schedule rows with calendar, shows and categories, stored.

    The calendar comes from each row alone, so it is added after the joins and is not shuffled.
    Rows with shows are stored before they meet the categories, both in slices, so that only the exchange
    for one slice of the two lies on disk at a time.
    """
    first = calendar_columns(rows, config).columns
    n = rows.count()
    with scratch(rows.sparkSession) as made:
        df = shows.show_sequence(shows.fill_exposed(rows), config.run_key, config.carry_key)
        with sliced("ts", n):
            df = stored(encode.drop_rows(df, config.mode), "shown")
        made.free(df)
        if side.tree is not None:
            columns = [c for c in side.tree.columns if c not in ("ts", "product_code")]
            df = external.add_categories(df, side.tree, columns)
        df = calendar_columns(df, config)
        with sliced("ts", n):
            df = stored(df.select(*first, *[c for c in df.columns if c not in first]), "stage")
        made.free(df)
    return df


def finish(base: DataFrame, side: SideTables, config: FeatureConfig, last: bool = False) -> Features:
    """All other features of staged rows.

    Lags and sales power go by products and shows, whose tables may be too large for a broadcast.  They
    are looked up first, while the rows lack the calendar, so what is shuffled is narrow.  With ``last``
    the staged rows are not read again by anyone else, and go when these lags are stored.
    """
    fitted = fit_lists(base, config) if config.mode == "train" else side.lists
    narrow = base.drop(*_calendar(config))
    df = _large_lags(narrow, base, last)
    base = calendar_columns(df, config).select(*base.columns)  # the same rows, with their lags at hand
    df = _small_lags(df, base, narrow.columns)
    lagged = [c for c in df.columns if c not in base.columns]
    power = ["sales_power"] if config.mode == "train" else []
    if power:
        df = lists.sales_power(df, source=base)
    df = calendar_columns(df, config).select(*base.columns, *power, *lagged)
    df = apply_lists(item_columns(df, config), fitted)
    df = lists.dup_times(df, "category", "dup_times", source=base)
    df = lists.dup_times(df, "small_c", "dup_times_smallc", source=base)
    dups = ["dup_times", "dup_times_smallc"]
    late = [*power, *dups, *lagged]
    df = df.select(*[c for c in df.columns if c not in late], *late)
    df = external_columns(df, side, config)
    df = lags.price_to_rate(df).withColumn("exposed_t", S.rounded_exposure("exposed").cast("string"))
    return Features(sales_history_columns(df, base, side, config), fitted)


def run_all(rows: DataFrame, side: SideTables, config: FeatureConfig = FeatureConfig()) -> Features:
    """Full feature set of normalised schedule rows (train or test)."""
    with scratch(rows.sparkSession):
        return finish(stage(rows, side, config), side, config, last=True)


def run_candidates(grid: DataFrame, side: SideTables, config: FeatureConfig) -> DataFrame:
    """Reduced feature set of a candidate grid that already carries its category columns."""
    if config.mode not in GRID_MODES:
        raise ValueError(f"mode must be one of {GRID_MODES}")
    df = encode.drop_rows(grid, config.mode)
    # the lookups come before the columns that the row itself tells: with too many columns at hand the generated
    # code of a join gets too long for the compiler, and every cell then takes many times as long
    keys = {c: column for c, column in _calendar(config).items() if c in ("months", "days", "hours")}
    first = [c for c in calendar_columns(df, config).columns if c not in ("parttime", "min_range", "show_id")]
    flat = {"parttime": F.lit(1), "min_range": F.lit(60.0)}
    shown = ["show_id"]
    if config.mode == "hungarian":
        flat["show_id"] = shows.hourly_show_id("ts")
    else:
        ids = shows.slot_show_ids(df.select("ts", "ymd").distinct())
        shown = [c for c in ids.columns if c not in df.columns]
        df = lookup_join(df, ids, "ts", "inner")
    df = df.withColumns(keys)
    known = df.columns
    df = apply_lists(df, side.lists)
    df = external_columns(df, side, config)
    df = sales_history_columns(df, df, side, config)
    looked_up = [c for c in df.columns if c not in known]
    df = apart(df).withColumns({**_calendar(config), **flat})
    items = item_columns(df, config)
    item = [c for c in items.columns if c not in df.columns]
    # lookups bring their keys to the front
    moved = {"hours", "small_c", "mother_code", *LEVEL_KEYS.values(), "ymd", "days", "category", "original_c"}
    front = [c for c in df.columns if c in moved or (c == "ts" and config.mode != "hungarian")]
    after = [*first, "parttime", "min_range", *shown, *item, *looked_up]
    return items.select(*front, *[c for c in after if c not in front])


def write_features(features: Features, folder: str) -> str:
    """Full set, partitioned by weekend flag and month, plus the fitted lists.

    Many features go by day and category level, so files are sorted by these and hold their values as runs.
    """
    parts = ["weekends", "months"]
    order = [c for c in (*parts, "ymd", "small_c", "middle_c", "big_c") if c in features.frame.columns]
    write_table(features.frame.sortWithinPartitions(*order), f"{folder}/features", partition_by=parts)
    lists.save_lists(dict(features.lists), f"{folder}/lists")
    return folder


def read_features(
    spark, folder: str, weekends: int | None = None, lags: bool = True, clicks: bool = True
) -> DataFrame:
    """All rows, or one side without the other side's lag columns.

    ``lags=False`` also drops rolling means and sales lags, ``clicks=False`` the click signals.
    """
    df = read_table(spark, f"{folder}/features")
    dropped = []
    if weekends is not None:
        df = df.where(F.col("weekends") == weekends)
        dropped.append("lag_sales_wk_" if weekends == 0 else "lag_sales_wd_")
    if not lags:
        dropped += ["rolling_mean_", "lag_sales_"]
    if not clicks:
        dropped += [*CLICK_NAMES.values(), *AGES, *DEVICES]
    return df.drop(*[c for c in df.columns if c.startswith(tuple(dropped))]) if dropped else df
