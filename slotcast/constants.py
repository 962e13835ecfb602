"""Fixed values and default parameters."""

# --- fixed values: public holidays per mode -------------------------------------------------
TRAIN_HOLIDAYS = (
    "2019-01-01", "2019-02-04", "2019-02-05", "2019-02-06", "2019-03-01", "2019-05-06",
    "2019-06-06", "2019-08-15", "2019-09-12", "2019-09-13", "2019-10-03", "2019-10-09",
    "2019-12-25",
)
TEST_HOLIDAYS = ("2020-06-06",)

# --- fixed values: prime hours ---------------------------------------------------------------
PRIME_HOURS = {
    "weekday": {1: (9, 10, 11), 2: (16, 17, 18)},
    "weekend": {1: (7, 8, 9), 2: (13, 15, 16, 17)},
}

# --- fixed values: keyword rules on the product name ------------------------------------------
MEN_CATEGORIES = ("의류", "이미용", "잡화", "속옷")
MEN_KEYWORD = "남성"
PAY_RULES = (("ilsibul", ("(일)", "일시불")), ("muiza", ("(무)", "무이자")))
PAY_DEFAULT = "none"
LUXURY_PRICE = 490_000
DUMMY_SALES = 50_000

# --- fixed values: year-on-year growth factors per category -----------------------------------
GROWTH_FACTORS = {
    12: {
        "건강기능": 1.112, "농수축": 1.141, "이미용": 0.994, "의류": 0.792, "속옷": 0.792,
        "잡화": 1.357, "생활용품": 1.357, "가전": 1.227, "주방": 1.227, "침구": 0.665,
        "가구": 0.665,
    },
    6: {
        "건강기능": 1.12, "농수축": 1.307, "이미용": 0.897, "의류": 0.752, "속옷": 0.752,
        "잡화": 1.351, "생활용품": 1.351, "가전": 0.946, "주방": 0.946, "침구": 1.052,
        "가구": 1.052,
    },
}

# --- fixed values: category mix of the two-level schedule, categories in sorted order ----------
DRAWS_PER_DAY = 22

# --- fixed values: column groups ---------------------------------------------------------------
USELESS_COLUMNS = (
    "ts", "exposed_min", "mother_code", "product_name", "exposed", "ymd", "volume", "years",
    "days", "hours", "week_num", "holidays", "red", "min_range", "brand", "small_c_code",
    "middle_c_code", "big_c_code", "sales_power",
)
LAG_PERIOD_COLUMNS = (
    "lag_scode_price", "lag_scode_count", "lag_mcode_price", "lag_mcode_count",
    "lag_bigcat_price", "lag_bigcat_count", "lag_bigcat_price_day", "lag_bigcat_count_day",
    "lag_small_c_price", "lag_small_c_count", "lag_all_price_show", "lag_all_price_day",
)
HISTORY_COLUMNS = (
    "ts_pred", "rolling_mean_7", "rolling_mean_14", "rolling_mean_21", "rolling_mean_28",
    "mean_sales_origin",
)
MIDDLE_CLICK_COLUMNS = (
    "mid_click_r", "age30_middle", "age40_middle", "age50_middle", "age60above_middle",
    "pc_middle", "mobile_middle",
)
WEEKDAY_LAGS = (1, 2, 3, 4, 5)
WEEKEND_LAGS = (1, 2)
UNDIVIDED_LAGS = (1, 2, 5, 7)
ROLLING_DAYS = (7, 14, 21, 28)
PRICE_RATE_COLUMNS = (
    "lag_mcode_price", "lag_bigcat_price", "lag_small_c_price", "lag_bigcat_price_day",
    "lag_all_price_show", "lag_all_price_day",
)
ONE_HOT_COLUMNS = (
    "min_start", "japp", "parttime", "primetime", "exposed_t", "category", "weekdays",
    "small_c", "middle_c", "big_c", "pay", "men",
)
BASE_COLUMNS = (
    "ts", "exposed_min", "mother_code", "product_code", "product_name", "category",
    "unit_price", "sales",
)

# --- fixed values: boosting parameters and top-slice sizes -------------------------------------
MODEL_PARAMS = {
    ("weekday", "all"): {"stepSize": 0.001, "minInstancesPerNode": 135, "maxIter": 2940},
    ("weekend", "all"): {"stepSize": 0.001, "minInstancesPerNode": 134, "maxIter": 2928},
    ("weekday", "top"): {"stepSize": 0.0025, "minInstancesPerNode": 70, "maxIter": 4000},
    ("weekend", "top"): {"stepSize": 0.0025, "minInstancesPerNode": 30, "maxIter": 3500},
}
#: Rounds that models are fitted with unless told otherwise; the step grows to match.
ROUNDS = 20
#: A fit of so many rounds or more is grown in one task if its rows times inputs are ``FIT_CELLS`` at most (about 400 MB).
MANY_ROUNDS = 100
FIT_CELLS = 20_000_000
#: Width of the bins of time in which broadcast times meet shows.
BIN_MINUTES = 15
#: Times that share a part of such a bin, about.
PART_TIMES = 16
#: Wide rows that are exchanged and stored at once, and into how many slices a table is cut at most.
SLICE_ROWS = 500_000
MAX_SLICES = 8
#: More partitions than any table has, so that ``session.apart`` joins none of them.
MOST_PARTITIONS = 1_000_000
TOP_SLICES = {"weekday": (4004, 2013), "weekend": (2206, 999), "schedule": (5500, 2500)}
MIX_TOP = {
    "test": {"weekday": 727, "weekend": 249},
    "validation": {"weekday": 6017, "weekend": 3205},
    "schedule": 8000,
}
CV_MONTHS = (7, 8, 9)
CV_TOP_SHARES = {
    "weekday": ((2952, 1052), (4524, 2093)),
    "weekend": ((1205, 504), (2856, 1359)),
}
TOP_LIST_RANKS = (2, 100)
BRAND_QUANTILE = 0.7
PROFIT_SCALE = 3
RAIN_MM = 5
MAX_CARRIED_SLOTS = 8
OUTLIER_TREES = 50
OUTLIER_SAMPLES = 50
OUTLIER_SHARE = 0.05
SEED = 127
