"""Row-wise expressions; each takes columns and returns a column."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, functions as F

from .. import constants as K


def _c(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def zero_fill(code: Column | str, width: int = 6) -> Column:
    """Left-pad with zeros; longer codes stay whole (``lpad`` alone would cut them)."""
    text = _c(code).cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def safe_divide(x: Column | str, y: Column | str) -> Column:
    """x / y, null where y is zero."""
    return F.try_divide(_c(x).cast("double"), _c(y).cast("double"))


def minutes(n: Column | str) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), _c(n).cast("double") * 60)


def week_start(day: Column | str) -> Column:
    return F.trunc(_c(day), "week")


def time_parts(ts: Column | str) -> dict[str, Column]:
    ts = _c(ts)
    return {
        "years": F.year(ts),
        "months": F.month(ts),
        "days": F.dayofmonth(ts),
        "hours": F.hour(ts),
        "week_num": F.weekofyear(ts),
    }


def weekday_name(ts: Column | str) -> Column:
    return F.date_format(_c(ts), "EEEE")


def hours_in_week(ts: Column | str) -> Column:
    """0 = Monday 00:xx … 167 = Sunday 23:xx."""
    return F.hour(_c(ts)) + 24 * F.weekday(_c(ts))


def red_day(day: Column | str, holidays: Iterable[str]) -> Column:
    days = [F.lit(d).cast("date") for d in holidays]
    return _c(day).isin(days).cast("int") if days else F.lit(0)


def holiday(day: Column | str, holidays: Iterable[str]) -> Column:
    return F.when((red_day(day, holidays) == 1) | (F.weekday(_c(day)) >= 5), 1).otherwise(0)


def weekend(day: Column | str, holidays: Iterable[str]) -> Column:
    """1 on Saturdays and Sundays that are not public holidays."""
    return F.when((F.weekday(_c(day)) >= 5) & (red_day(day, holidays) == 0), 1).otherwise(0)


def minute_start(ts: Column | str) -> Column:
    return (F.floor(F.minute(_c(ts)) / 20) * 20).cast("int")


def rounded_hour(ts: Column | str, minute: Column | str | None = None) -> Column:
    """The hour, rounded up from minute 30, on a 24-hour clock.

    ``minute`` may be a coarser minute, such as ``minute_start``.
    """
    minute = F.minute(_c(ts)) if minute is None else _c(minute)
    return F.pmod(F.hour(_c(ts)) + F.when(minute >= 30, 1).otherwise(0), F.lit(24))


def rounded_exposure(exposed: Column | str) -> Column:
    exposed = _c(exposed)
    return F.when(exposed < 25, 20).when(exposed >= 25, 30)


def prime_time(hour: Column | str, red: Column | str, holidays: Column | str) -> Column:
    hour, red, free = _c(hour), _c(red), _c(holidays)
    weekend_day = (red == 0) & (free == 1)
    rule = F
    for kind, days in (("weekend", weekend_day), ("weekday", free == 0)):
        for level, hours in K.PRIME_HOURS[kind].items():
            rule = rule.when(days & hour.isin(*hours), level)
    return rule.otherwise(0)


def keyword_flag(
    category: Column | str, name: Column | str, categories: Iterable[str], keyword: str
) -> Column:
    hit = _c(category).isin(*categories) & F.contains(_c(name), F.lit(keyword))
    return F.when(hit, 1).otherwise(0)


def keyword_flag_or_null(
    category: Column | str, name: Column | str, categories: Iterable[str], keyword: str
) -> Column:
    """As ``keyword_flag`` but null outside the listed categories."""
    hit = F.contains(_c(name), F.lit(keyword))
    return F.when(_c(category).isin(*categories), F.when(hit, 1).otherwise(0))


def luxury(price: Column | str, threshold: float = K.LUXURY_PRICE) -> Column:
    return F.when(_c(price) >= threshold, 1).otherwise(0)


def keyword_class(
    name: Column | str,
    rules: Iterable[tuple[str, Iterable[str]]] = K.PAY_RULES,
    default: str = K.PAY_DEFAULT,
) -> Column:
    """Label of the first rule with a word in ``name``."""
    found = F
    for label, words in rules:
        hit = F.lit(False)
        for word in words:
            hit = hit | F.contains(_c(name), F.lit(word))
        found = found.when(hit, label)
    return found.otherwise(default)


def season_flags(
    item: Column | str, seasons: Mapping[str, Iterable[str]]
) -> dict[str, Column]:
    return {
        season: F.when(_c(item).isin(*items), 1).otherwise(0) for season, items in seasons.items()
    }


def broadcast_day(ts: Column | str, start_hour: int = 1) -> Column:
    """TV day: the interval (d 01:00, d+1 01:00], closed on the right."""
    back = F.make_dt_interval(F.lit(0), F.lit(start_hour), F.lit(0), F.lit(0.000001))
    return F.to_date(_c(ts) - back)


def day_hour(day: Column | str, hour: Column | str) -> Column:
    return F.concat_ws("/", _c(day).cast("string"), _c(hour).cast("string"))


def shifted_day(month: Column | str, day: Column | str, carry_july: bool = True) -> Column:
    """Day of month moved so that weekdays of last December and June meet this June."""
    month, day = _c(month), _c(day)
    july = day + 30 - 2 if carry_july else day - 2
    return F.when(month == 12, day - 1).when(month == 7, july).otherwise(day - 2)


def growth_adjusted(
    sales: Column | str, category: Column | str, factors: Mapping[str, float]
) -> Column:
    pairs = [F.lit(x) for pair in factors.items() for x in pair]
    factor = F.create_map(*pairs)[_c(category)]
    return _c(sales) * F.coalesce(factor, F.lit(1.0))


def clamp_negative(value: Column | str) -> Column:
    return F.greatest(_c(value), F.lit(0.0))


def scaled_profit(value: Column | str, scale: float = K.PROFIT_SCALE) -> Column:
    return _c(value) * scale


def uniform(seed: str | int, *keys: Column | str) -> Column:
    """Repeatable number in [0, 1) from the md5 of seed and keys."""
    text = F.concat_ws("|", F.lit(str(seed)), *[_c(k).cast("string") for k in keys])
    head = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double")
    return head / float(2**32)
