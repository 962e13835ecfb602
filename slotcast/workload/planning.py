"""Candidate grids, schedules and end-to-end runs."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import scalar as S
from ..operators import reports, schedule
from ..operators.encode import stack
from ..operators.lookup import lookup_join
from ..plans import features as FE, forecasting, scheduling
from ..session import discard, new_path, scratch, settle, stored
from ..sources import bindings as B
from .base import feat, query, r, rs, sql, u_sql
from .joining import LEVELS, forecast_table
from .scanning import weather

MIX = (
    ("ECONOMY", 0.12), ("LARGE", 0.217), ("MEDIUM", 0.093), ("PROMO", 0.225), ("SMALL", 0.107),
    ("STANDARD", 0.238),
)
GRID = """
prods AS (SELECT DISTINCT product_code, big_c AS category FROM airings),
hour_slots AS (SELECT unnest(generate_series((SELECT min(ymd) FROM airings)::TIMESTAMP,
               (SELECT max(ymd) FROM airings)::TIMESTAMP + INTERVAL 23 HOUR, INTERVAL 1 HOUR)) AS ts),
grid AS (SELECT product_code, category, ts, CAST(ts - INTERVAL 1 HOUR - INTERVAL 1 MICROSECOND AS DATE) AS broadcast_day
         FROM prods, hour_slots)
"""


def products(spark, sf):
    return B.airings(spark, sf).select("product_code", F.col("big_c").alias("category")).distinct()


def _bounds(spark, sf):
    days = B.table(spark, sf, "events").select(F.to_date("ts").alias("d"))
    return days.select(F.min("d")).scalar(), days.select(F.max("d")).scalar()


def grid(spark, sf):
    return schedule.cross_schedule(products(spark, sf), *_bounds(spark, sf)).withColumn(
        "broadcast_day", S.broadcast_day("ts")
    )


def scored_grid(spark, sf):
    """Grid with a plain score: mean sales of the product plus mean of its category at the hour."""
    rows = feat(spark, sf)
    item = rows.groupBy("product_code").agg(F.avg("sales").alias("_item"))
    hour = rows.groupBy(F.col("big_c").alias("category"), F.col("hours_inweek")).agg(F.avg("sales").alias("_hour"))
    # one row per product is joined, before it unfolds into all slots; the cells are never shuffled
    # (spread by number, since the planner would join few products into one task)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = products(spark, sf).join(item, "product_code").repartition(tasks, "product_code")
    cells = schedule.cross_schedule(known, *_bounds(spark, sf)).withColumns(
        {"broadcast_day": S.broadcast_day("ts"), "hours_inweek": S.hours_in_week("ts")}
    )
    joined = lookup_join(cells, hour, ["category", "hours_inweek"])
    pred = F.col("_item") + F.coalesce(F.col("_hour"), F.lit(0.0))
    return joined.select("product_code", "category", "ts", "broadcast_day", pred.alias("pred"))


SCORED_GRID = GRID + """,
scored_grid AS (
  SELECT g.*, i.m + coalesce(h.m, 0) AS pred FROM grid g
  JOIN (SELECT product_code, avg(sales) AS m FROM feat GROUP BY 1) i USING (product_code)
  LEFT JOIN (SELECT big_c, hours_inweek, avg(sales) AS m FROM feat GROUP BY 1, 2) h
    ON h.big_c = g.category AND h.hours_inweek = hour(g.ts) + 24 * (isodow(g.ts) - 1)),
profits AS (SELECT broadcast_day, ts, category, avg(pred) AS profit FROM scored_grid GROUP BY ALL)
"""


@query("cross_schedule", sql("SELECT product_code, category, ts, broadcast_day FROM grid", GRID))
def cross_schedule(spark, sf):
    return grid(spark, sf)


@query(
    "grid_category_profit",
    sql(f"SELECT broadcast_day, ts, category, {rs('profit', 'profit')} FROM profits", SCORED_GRID),
)
def grid_category_profit(spark, sf):
    table = reports.slot_category_profit(scored_grid(spark, sf), ("broadcast_day", "ts", "category"))
    return table.withColumn("profit", r("profit", "profit"))


def _pick_sql():
    arms, upto = [], 0.0
    for category, p in MIX[:-1]:
        upto += p
        arms.append(f"WHEN u < CAST({upto!r} AS DOUBLE) THEN '{category}'")
    return f"CASE {' '.join(arms)} ELSE '{MIX[-1][0]}' END"


@query(
    "draw_category_mix",
    sql(
        f"""SELECT broadcast_day, category, count(*) AS draws FROM (
              SELECT broadcast_day, {_pick_sql()} AS category FROM (
                SELECT broadcast_day, {u_sql('127', "CAST(broadcast_day AS VARCHAR) || '|' || CAST(d AS VARCHAR)")} AS u
                FROM (SELECT DISTINCT broadcast_day FROM grid), range(1, 23) t(d))) GROUP BY ALL""",
        GRID,
    ),
)
def draw_category_mix(spark, sf):
    return schedule.draw_category_mix(grid(spark, sf), MIX)


LATE = "2024-01-27"


@query(
    "week_candidates",
    sql(
        f"""SELECT DISTINCT d.broadcast_day, o.product_code
            FROM (SELECT DISTINCT broadcast_day FROM grid) d
            JOIN (SELECT DISTINCT CAST(date_trunc('week', ymd) AS DATE) AS wk, product_code FROM airings) o
              ON o.wk = CAST(date_trunc('week', d.broadcast_day + 1) AS DATE)
              OR (d.broadcast_day + 1 >= DATE '{LATE}' AND o.wk = CAST(date_trunc('week', d.broadcast_day + 1) AS DATE) - 7)""",
        GRID,
    ),
)
def week_candidates(spark, sf):
    return schedule.week_candidates(B.airings(spark, sf), grid(spark, sf), LATE)


def _two_level(spark, sf):
    return scheduling.two_level(scored_grid(spark, sf), B.airings(spark, sf), MIX, LATE)


@query("assign_flat")
def assign_flat(spark, sf):
    return scheduling.flat(scored_grid(spark, sf))


@query("assign_categories")
def assign_categories(spark, sf):
    return _two_level(spark, sf)["categories"]


@query("assign_products")
def assign_products(spark, sf):
    return _two_level(spark, sf)["products"]


def _proven(edges, keys, slot, item, copies=None, slots=None):
    """Counts of each group and whether the prices prove its schedule, up to rounding."""
    edges = settle(edges)
    solved = settle(schedule.solve_groups(edges, keys, slot, item, copies, slots))
    checked = schedule.proof(edges, solved, keys, slot, item)
    proven = (F.col("gap") < 1e-9) & (F.col("above") < 1e-6)
    return checked.select(*keys, "n_slots", "n_filled", "n_repeated", proven.alias("proven"))


@query(
    "assign_flat_proof",
    sql(
        """SELECT CAST(date_trunc('week', ts) AS DATE) AS week, count(DISTINCT ts) AS n_slots,
                  least(count(DISTINCT ts), count(DISTINCT product_code)) AS n_filled, 0 AS n_repeated, true AS proven
           FROM grid GROUP BY 1""", GRID,
    ),
)
def assign_flat_proof(spark, sf):
    """The weekly schedules are whole, and no other is worth more."""
    return _proven(scheduling.flat_edges(scored_grid(spark, sf)), ["week"], "ts", "product_code")


DRAWN = SCORED_GRID + f""",
drawn AS (SELECT broadcast_day, category, count(*) AS draws FROM (
    SELECT broadcast_day, {_pick_sql()} AS category FROM (
      SELECT broadcast_day, {u_sql('127', "CAST(broadcast_day AS VARCHAR) || '|' || CAST(d AS VARCHAR)")} AS u
      FROM (SELECT DISTINCT broadcast_day FROM grid), range(1, 23) t(d))) GROUP BY ALL)
"""


@query(
    "assign_categories_proof",
    sql(
        """SELECT p.broadcast_day, n_slots, least(n_slots, coalesce(n_draws, 0)) AS n_filled, 0 AS n_repeated, true AS proven
           FROM (SELECT broadcast_day, count(DISTINCT ts) AS n_slots FROM profits GROUP BY 1) p
           LEFT JOIN (SELECT broadcast_day, CAST(sum(draws) AS BIGINT) AS n_draws FROM drawn SEMI JOIN profits USING (broadcast_day, category)
                      GROUP BY 1) USING (broadcast_day)""", DRAWN,
    ),
)
def assign_categories_proof(spark, sf):
    """Every slot of a day is there, as many as drawn are filled, and no other choice is worth more."""
    profits = settle(reports.slot_category_profit(scored_grid(spark, sf), ("broadcast_day", "ts", "category")))
    drawn = schedule.draw_category_mix(profits, MIX)
    edges = profits.join(drawn, ["broadcast_day", "category"])
    return _proven(edges, ["broadcast_day"], "ts", "category", "draws", schedule.calendar_slots(profits))


@query("assign_products_proof")
def assign_products_proof(spark, sf):
    """Products of each day and category: whole, none twice, and none worth more."""
    plan = _two_level(spark, sf)
    slots = plan["categories"].where("category IS NOT NULL").select("broadcast_day", "category", "ts")
    return _proven(plan["edges"], ["broadcast_day", "category"], "ts", "product_code", slots=slots)


@query("two_level_profit")
def two_level_profit(spark, sf):
    plan = _two_level(spark, sf)
    flat = settle(scheduling.flat(scored_grid(spark, sf)))
    tables = {"categories": plan["categories"], "products": plan["products"], "flat": flat}
    totals = [
        schedule.total_profit(t).withColumn("schedule", F.lit(n)) for n, t in tables.items()
    ]
    return stack(totals)


BEST = SCORED_GRID + """,
best AS (SELECT ts, category, profit FROM profits
         QUALIFY row_number() OVER (PARTITION BY ts ORDER BY profit DESC, category) = 1)
"""


def best_category(spark, sf):
    """The single best category of each slot."""
    table = reports.slot_category_profit(scored_grid(spark, sf), ("ts", "category"))
    top = F.max_by(F.struct("category", "profit"), F.struct("profit", "category"))
    return table.groupBy("ts").agg(top.alias("b")).select("ts", "b.category", "b.profit")


@query(
    "schedule_pivot",
    sql(
        "SELECT ts, " + ", ".join(f"count(*) FILTER (category = '{c}') AS \"{c}\"" for c, _ in MIX)
        + " FROM best GROUP BY ts", BEST,
    ),
)
def schedule_pivot(spark, sf):
    return schedule.schedule_pivot(best_category(spark, sf), [c for c, _ in MIX])


@query("total_profit", sql(f"SELECT {rs('sum(profit * 3)', 'total_profit', 5)} FROM best", BEST))
def total_profit(spark, sf):
    return schedule.total_profit(best_category(spark, sf)).select(r("total_profit", "total_profit", 5))


@query(
    "schedule_lookup",
    sql(
        f"""SELECT s.product_code, s.ts, {rs('s.profit', 'profit')}, i.product_name, c.category, c.exposed_min
            FROM (SELECT product_code, ts, pred AS profit FROM scored_grid
                  QUALIFY row_number() OVER (PARTITION BY product_code ORDER BY pred DESC, ts) = 1) s
            LEFT JOIN (SELECT DISTINCT product_code, product_name FROM airings) i USING (product_code)
            LEFT JOIN (SELECT product_code, min(big_c) AS category, min(exposed_min) AS exposed_min
                       FROM airings GROUP BY 1) c USING (product_code)""",
        SCORED_GRID,
    ),
)
def schedule_lookup(spark, sf):
    rows = B.airings(spark, sf)
    cells = scored_grid(spark, sf).select("product_code", "ts", "pred")
    latest_first = F.struct("pred", (-F.unix_micros(F.col("ts").cast("timestamp"))).alias("t"), "ts")
    best = cells.groupBy("product_code").agg(F.max(latest_first).alias("b")).select(
        "product_code", "b.ts", F.col("b.pred").alias("profit")
    )
    items = rows.select("product_code", "product_name").distinct()
    catalogue = rows.groupBy("product_code").agg(
        F.min("big_c").alias("category"), F.min("exposed_min").alias("exposed_min")
    )
    joined = schedule.schedule_lookup(best, items, catalogue, "product_code")
    return joined.withColumn("profit", r("profit", "profit"))


@query(
    "submission",
    sql(
        f"""SELECT ts, exposed_min, mother_code, product_code, product_name, category,
                   CASE WHEN k % 10 = 0 THEN 0.0 ELSE unit_price END AS unit_price,
                   {rs('CASE WHEN k % 10 = 0 THEN 0.0 ELSE greatest(sales - 5, 0) END', 'sales')} FROM feat"""
    ),
)
def submission(spark, sf):
    price = F.when(F.col("k") % 10 == 0, 0.0).otherwise(F.col("unit_price"))
    raw = feat(spark, sf).withColumn("unit_price", price)
    scored = raw.where("unit_price <> 0").withColumn("sales", S.clamp_negative(F.col("sales") - 5))
    parts = [scored.where("weekends = 0"), scored.where("weekends = 1")]
    return schedule.submission(raw, parts).withColumn("sales", r("sales", "sales"))


# --- end-to-end runs on the airings: days 1-20 as last year, days 21-30 as the test schedule ----

CONFIG = FE.FeatureConfig(
    holidays=B.HOLIDAYS, seasons=B.SEASONS, run_key="category", carry_key="category",
    men_categories=("view", "click", "purchase"), men_keyword="red",
    pay_rules=(("ilsibul", ("red", "small")), ("muiza", ("ring", "hot"))), luxury_price=905,
)
TREE = ["small_c", "middle_c", "big_c", "original_c", *FE.LEVEL_KEYS.values()]


def _base_rows(spark, sf):
    """Airings, stored since every side table and stage reads them, and the schedule rows made of them."""
    aired = stored(B.airings(spark, sf), "airings")
    rows = B.airings_with_gaps(spark, sf, lambda *_: aired).withColumns(
        {f"{c}_code": F.col(c) for c in ("small_c", "middle_c", "big_c")}
    )
    return aired, rows.withColumn("volume", S.safe_divide("sales", "unit_price"))


def _side(spark, sf, aired, rows, **more):
    def codes(make):
        return stack(
            [make(key).withColumn("code", F.concat(F.lit(f"{lv}:"), "code")) for lv, key in LEVELS.items()]
        )

    by = F.col("product_code").cast("long")
    plain = feat(spark, sf, aired)
    return FE.SideTables(
        tree=rows.select("ts", "product_code", *TREE),
        clicks={lv: B.click_rates(rows, key).withColumnRenamed(key, "code") for lv, key in LEVELS.items()},
        age=stack(
            [B.shares(rows, key, by % 4, ["age30", "age40", "age50", "age60above"]).withColumnRenamed(key, "code")
             for key in LEVELS.values()]
        ),
        device=stack(
            [B.shares(rows, key, by % 2, ["pc", "mobile"]).withColumnRenamed(key, "code") for key in LEVELS.values()]
        ),
        weather=weather(spark, sf),
        forecast=forecast_table(plain),
        **more,
    )


RAW = [
    "ts", "ymd", "exposed_min", "exposed", "mother_code", "product_code", "product_name", "category",
    "unit_price", "sales", "volume",
]


UNDIVIDED = replace(CONFIG, divided=False)


def _train(spark, sf, config):
    """Training features of all days; the airings go once the side tables are looked up."""
    with scratch(spark):
        aired, rows = _base_rows(spark, sf)
        made = FE.run_all(rows.select(*RAW), _side(spark, sf, aired, rows), config)
        discard(aired)
    return made


@query("train_features_undivided")
def train_features_undivided(spark, sf):
    """Full training feature set with sales lags over all days."""
    return _train(spark, sf, UNDIVIDED).frame


@query(
    "undivided_lags",
    sql(
        "SELECT ts, " + ", ".join(rs(f"lag_sales_{n}", f"lag_sales_{n}", 7) for n in K.UNDIVIDED_LAGS)
        + " FROM kept LEFT JOIN (SELECT ymd, hours, "
        + ", ".join(f"lag(s, {n}) OVER (PARTITION BY hours ORDER BY ymd) AS lag_sales_{n}" for n in K.UNDIVIDED_LAGS)
        + " FROM (SELECT ymd, hours, sum(sales) AS s FROM kept GROUP BY ALL)) USING (ymd, hours)",
        "kept AS (SELECT ts, ymd, hour(ts) AS hours, sales FROM gaps WHERE sales IS NOT NULL AND sales <> 50000)",
    ),
)
def undivided_lags(spark, sf):
    """The undivided sales lags of the full feature set."""
    made = train_features_undivided(spark, sf)
    return made.select("ts", *[r(f"lag_sales_{n}", f"lag_sales_{n}", 7) for n in K.UNDIVIDED_LAGS])


@query("train_features")
def train_features(spark, sf):
    """Full training feature set, written and read back."""
    folder = FE.write_features(_train(spark, sf, CONFIG), new_path(spark, "train"))
    return FE.read_features(spark, folder)


def _years(spark, sf, config=CONFIG):
    """Training features of days 1-20 moved into June and December, and the later test rows."""
    aired, rows = _base_rows(spark, sf)
    past, late = rows.where(F.dayofmonth("ymd") <= 20), rows.where(F.dayofmonth("ymd") > 20)
    side = _side(spark, sf, aired, rows)
    with scratch(spark) as run:
        made = FE.run_all(past.select(*RAW), side, config)
        train = stored(made.frame, "train")
        run.free(train)
    month = F.when(F.col("days") <= 8, 6).when(F.col("days") <= 14, 8).otherwise(12)
    return rows, late, train.withColumns({"months": month, "days": F.col("days") + 10}), made.lists, side


@query("test_features")
def test_features(spark, sf):
    """Test rows with last year's history and the fitted lists."""
    _, late, train, fitted, side = _years(spark, sf)
    side = replace(side, lists=fitted, history=train)
    return FE.run_all(late.select(*RAW), side, replace(CONFIG, mode="test")).frame


def _candidates(spark, sf, mode, config=CONFIG):
    """Features of the product-by-slot grid, with training features and raw rows."""
    rows, _, train, fitted, side = _years(spark, sf, config)
    catalogue = rows.groupBy("product_code").agg(
        *[F.min(c).alias(c) for c in ("mother_code", "product_name", "unit_price", "exposed", *TREE)],
        F.min("category").alias("category"),
    )
    # few products would unfold into all their slots in one task, so they are spread by number first
    # (without a key, since the planner drops a second exchange by the key of the groups)
    spread = catalogue.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    cells = schedule.cross_schedule(spread, *_bounds(spark, sf)).withColumn("ymd", F.to_date("ts"))
    side = replace(side, lists=fitted, history=train)
    made = FE.run_candidates(cells, side, replace(config, mode=mode))
    return rows, train, made


@query("candidate_features")
def candidate_features(spark, sf):
    """Reduced features of the product-by-slot grid, shows by the hour."""
    return _candidates(spark, sf, "hungarian")[2]


@query("candidate_features_undivided")
def candidate_features_undivided(spark, sf):
    """The grid with sales lags over all days, as the scheduler takes them."""
    return _candidates(spark, sf, "hungarian", UNDIVIDED)[2]


@query("candidate_features_per_slot")
def candidate_features_per_slot(spark, sf):
    """Reduced features of the grid where every slot is its own show."""
    return _candidates(spark, sf, "hungarian_h1")[2]


@query("model_schedule")
def model_schedule(spark, sf):
    """Undivided grid features, models on the reduced columns, scores, two-level schedule with item names.

    Categories are drawn with their shares of the shows seen in training.
    """
    rows, train, made = _candidates(spark, sf, "hungarian", UNDIVIDED)
    scored = settle(forecasting.score_candidates(train, made))
    shares = reports.category_mix(train, include_margin=False).where("category IS NOT NULL AND category != 'All'")
    mix = [tuple(row) for row in shares.orderBy("category").select("category", "mix").collect()]  # one per category
    plan = scheduling.two_level(scored, rows, mix, LATE)
    items = rows.select("product_code", "product_name").distinct()
    prices = rows.groupBy("product_code").agg(F.min("unit_price").alias("unit_price"))
    named = schedule.schedule_lookup(plan["products"], items, prices, "product_code")
    return named.withColumn("value", S.scaled_profit("profit"))


@query("forecast")
def forecast(spark, sf):
    """Train four models, predict the later days, add unpriced rows."""
    _, late, train, fitted, side = _years(spark, sf)
    price = F.when(F.col("k") % 10 == 0, 0.0).otherwise(F.col("unit_price"))
    raw = late.withColumn("unit_price", price).select(*RAW)
    side = replace(side, lists=fitted, history=train)
    test = stored(FE.run_all(raw, side, replace(CONFIG, mode="test")).frame, "test")
    return forecasting.forecast(train, raw, test)


@query("validate_parts")
def validate_parts(spark, sf):
    """Error of the mixed models of both parts on the rows after the training months."""
    train = _years(spark, sf)[2]
    coded = stored(forecasting.encoded([train])[0], "coded")
    return forecasting.validate_parts(forecasting.train_parts(coded), coded)


@query("counterfactual")
def counterfactual(spark, sf):
    _, late, train, fitted, side = _years(spark, sf)
    side = replace(side, lists=fitted, history=train)
    return forecasting.counterfactual(train, late.select(*RAW), side, CONFIG)
