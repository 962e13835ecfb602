from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from slotcast import constants as K
from slotcast.functions import scalar as S
from slotcast.operators import encode, evaluate, history, lags
from slotcast.operators.lookup import lookup_join, member_flag


def one(spark, column, **values):
    kinds = {datetime: "timestamp_ntz", date: "date", str: "string", int: "int", float: "double", type(None): "int"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]


@pytest.mark.parametrize(
    "ts,day",
    [
        (datetime(2024, 1, 2, 0, 59), date(2024, 1, 1)),
        (datetime(2024, 1, 2, 1), date(2024, 1, 1)),
        (datetime(2024, 1, 2, 1, 0, 0, 1), date(2024, 1, 2)),
    ],
)
def test_tv_day_is_closed_on_the_right(spark, ts, day):
    assert one(spark, S.broadcast_day("ts"), ts=ts) == day


@pytest.mark.parametrize(
    "ts,hour", [((0, 10), 0), ((0, 30), 1), ((23, 29), 23), ((23, 30), 0), ((9, 59), 10)]
)
def test_rounded_hour(spark, ts, hour):
    assert one(spark, S.rounded_hour("ts"), ts=datetime(2024, 1, 1, *ts)) == hour


def test_zero_fill_keeps_long_codes(spark):
    assert one(spark, S.zero_fill("c"), c=12) == "000012"
    assert one(spark, S.zero_fill("c"), c="1234567") == "1234567"


def test_public_holiday_is_not_a_weekend(spark):
    day = date(2020, 6, 6)  # a Saturday
    assert one(spark, S.holiday("d", K.TEST_HOLIDAYS), d=day) == 1
    assert one(spark, S.weekend("d", K.TEST_HOLIDAYS), d=day) == 0
    assert one(spark, S.weekend("d", K.TEST_HOLIDAYS), d=date(2020, 6, 7)) == 1


def test_first_keyword_rule_wins(spark):
    assert one(spark, S.keyword_class("n"), n="(무) 세트 일시불") == "ilsibul"
    assert one(spark, S.keyword_class("n"), n="무이자 세트") == "muiza"
    assert one(spark, S.keyword_class("n"), n="세트") == "none"


def test_growth_factor_of_unknown_category_is_one(spark):
    column = S.growth_adjusted("s", "c", K.GROWTH_FACTORS[12])
    assert one(spark, column, s=100.0, c="침구") == pytest.approx(66.5)
    assert one(spark, column, s=100.0, c="무형") == 100.0


def test_zero_price_gives_null(spark):
    assert one(spark, S.safe_divide("a", "b"), a=1.0, b=0.0) is None


def test_metrics_skip_zero_truth(spark):
    df = spark.createDataFrame([(0.0, 1.0), (10.0, 5.0)], "sales double, prediction double")
    m = evaluate.metrics(df).first()
    assert (m.mape, m.mae, m.zero_truth, m.n) == (50.0, 3.0, 1, 2)


def test_previous_week_rules(spark):
    rows = [(date(2024, 1, 1), "a", 1.0), (date(2024, 1, 15), "a", 2.0), (date(2024, 1, 8), "b", 4.0),
            (date(2024, 1, 16), "b", 9.0), (date(2024, 1, 9), None, 3.0)]
    df = spark.createDataFrame(rows, "ymd date, k string, unit_price double")
    got = {(r.ymd, r.k): r.p for r in lags.prev_week_mean_price(df, "k", "p").collect()}
    assert got[(date(2024, 1, 1), "a")] == 0  # first week
    assert got[(date(2024, 1, 15), "a")] is None  # absent last week
    assert got[(date(2024, 1, 16), "b")] == 4.0
    assert got[(date(2024, 1, 9), None)] is None and len(got) == 5


def test_year_end_does_not_leak_into_the_first_weeks(spark):
    rows = [(date(2019, 1, 2), "a", 1.0), (date(2019, 1, 8), "a", 2.0), (date(2019, 12, 31), "a", 50.0)]
    df = spark.createDataFrame(rows, "ymd date, k string, unit_price double")
    got = {r.ymd: r.p for r in lags.prev_week_mean_price(df, "k", "p").collect()}
    assert got == {date(2019, 1, 2): 0, date(2019, 1, 8): 1.0, date(2019, 12, 31): None}


def test_previous_day_is_the_previous_day_with_data(spark):
    rows = [(date(2024, 1, 1), "a", 1.0), (date(2024, 1, 5), "a", 2.0)]
    df = spark.createDataFrame(rows, "ymd date, category string, unit_price double")
    got = {r.ymd: r.p for r in lags.prev_day_mean_price(df, "p").collect()}
    assert got == {date(2024, 1, 1): 0, date(2024, 1, 5): 1.0}


def test_rolling_mean_excludes_the_day_itself(spark):
    rows = [(date(2024, 1, d), "a", float(d)) for d in (1, 2, 8, 9)]
    df = spark.createDataFrame(rows, "ymd date, category string, sales double")
    got = {r.ymd.day: r.rolling_mean_7 for r in lags.rolling_means(df, (7,)).collect()}
    assert got == {1: None, 2: 1.0, 8: 1.5, 9: 5.0}


def test_july_days_follow_june(spark):
    assert one(spark, S.shifted_day("m", "d"), m=7, d=1) == 29
    assert one(spark, S.shifted_day("m", "d", carry_july=False), m=7, d=1) == -1
    assert one(spark, S.shifted_day("m", "d"), m=12, d=3) == 2


def test_mean_of_means_is_not_the_plain_mean(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "x", 1.0), ("a", "y", 4.0)], "k string, p string, v double")
    assert history.mean_of_means(df, ["k"], "p", ["v"]).first().v == 2.5


def test_lookup_without_broadcast_gives_the_same(spark):
    facts = spark.range(100).withColumn("k", F.col("id") % 7)
    table = facts.groupBy("k").agg(F.sum("id").alias("s"))
    small = lookup_join(facts, table, "k").orderBy("id").collect()
    large = lookup_join(facts, table, "k", max_rows=0)
    assert large.orderBy("id").collect() == small


def test_member_flag_ignores_null_keys(spark):
    facts = spark.createDataFrame([("a",), (None,), ("b",)], "k string")
    members = spark.createDataFrame([("a",), (None,), ("a",)], "k string")
    got = member_flag(facts, members, ["k"], "f").collect()
    assert sorted((r.k or "", r.f) for r in got) == [("", 0), ("a", 1), ("b", 0)]


@pytest.mark.parametrize("chunks", [None, 3])
def test_codes_are_sorted_and_null_free(spark, chunks):
    df = spark.createDataFrame([("b", "z"), ("a", None), ("c", "y"), ("a", "z")], "p string, q string")
    got = {(r.column_name, r.value): r.code for r in encode.code_tables(df, ["p", "q"], chunks).collect()}
    assert got == {("p", "a"): 0, ("p", "b"): 1, ("p", "c"): 2, ("q", "y"): 0, ("q", "z"): 1}


def test_split_puts_the_border_row_into_validation(spark):
    rows = [(datetime(2024, 8, 31, 1), "a", 8), (datetime(2024, 8, 31, 2), "a", 8), (datetime(2024, 9, 1), "a", 9)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, product_code string, months int")
    train, val = evaluate.time_split(df, 8)
    assert (train.count(), val.count()) == (1, 2)


def test_one_hot_rows_keep_positions_of_all_columns(spark):
    rows = [(1, "b", 10), (2, "a", None), (3, None, 9), (4, "a", 10)]
    df = spark.createDataFrame(rows, "k int, p string, q int")
    names = {(r.column_name, r.value): r.position for r in encode.one_hot_names(df, ["q", "p"]).collect()}
    assert names == {("q", "10"): 0, ("q", "9"): 1, ("p", "a"): 2, ("p", "b"): 3}
    got = {r.k: r.hot for r in encode.one_hot_rows(df, ["q", "p"]).collect()}
    assert got == {1: [0, 3], 2: [2], 3: [1], 4: [0, 2]}
    later = spark.createDataFrame([(5, "c", 9)], "k int, p string, q int")
    assert encode.one_hot_rows(later, ["q", "p"], encode.one_hot_names(df, ["q", "p"]).cache()).first().hot == [1]
    assert encode.one_hot_rows(df.where("1 = 0"), ["q", "p"]).count() == 0
