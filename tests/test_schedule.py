from datetime import date, datetime
from itertools import permutations
import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from slotcast.operators import schedule as P
from slotcast.operators.reports import triplet_wins

TOY = [
    ([[6, 2, 7], [4, 11, 3], [12, 5, 1]], 30),
    ([[-5, -7], [-3, -2]], -7),
    ([[1.5, 8.25, 3, 0], [2, 8, 7.5, 6], [9, 4, 4, 4.75]], 24.75),
]
EDGE = "g int, slot int, item int, profit double"


def brute(matrix):
    m = np.array(matrix, float)
    if m.shape[0] > m.shape[1]:
        m = m.T
    return max(sum(m[i, c] for i, c in enumerate(p)) for p in permutations(range(m.shape[1]), m.shape[0]))


def edge_rows(matrix, group=0):
    return [(group, i, j, float(v)) for i, row in enumerate(matrix) for j, v in enumerate(row)]


@pytest.mark.parametrize("matrix,best", TOY)
def test_toy_matrices(spark, matrix, best):
    pairs = P.best_assignment(np.array(matrix, float))
    assert sum(matrix[r][c] for r, c in pairs) == best == brute(matrix)
    df = spark.createDataFrame(edge_rows(matrix), EDGE)
    assert P.total_profit(P.assign(df, ["g"], "slot", "item"), 1).first()[0] == best


def test_solver_against_enumeration():
    rng = random.Random(5)
    for _ in range(200):
        shape = rng.randint(1, 5), rng.randint(1, 6)
        m = np.array([[rng.randint(-9, 30) for _ in range(shape[1])] for _ in range(shape[0])], float)
        pairs = P.best_assignment(m)
        assert len(pairs) == min(shape) and len({c for _, c in pairs}) == len(pairs)
        assert sum(m[r, c] for r, c in pairs) == brute(m)


def test_solver_fills_as_many_slots_as_allowed():
    nan = float("nan")
    m = np.array([[9.0, nan, nan], [8.0, 1.0, nan], [nan, nan, nan]])
    assert P.best_assignment(m) == [(0, 0), (1, 1)]


def groups_of(seed, slots, items, groups=3):
    rng = random.Random(seed)
    return [
        [[rng.randint(1, 40) for _ in range(items)] for _ in range(slots)] for _ in range(groups)
    ]


@pytest.mark.parametrize("slots,items", [(4, 6), (6, 4), (5, 5), (3, 7)])
def test_groups_match_enumeration(spark, slots, items):
    tables = groups_of(slots * 10 + items, slots, items)
    rows = [e for g, t in enumerate(tables) for e in edge_rows(t, g)]
    df = spark.createDataFrame(rows, EDGE).repartition(3)
    want = {g: brute(t) for g, t in enumerate(tables)}
    got = P.assign(df, ["g"], "slot", "item").collect()
    filled = [r for r in got if r.item is not None]
    assert len({(r.g, r.slot) for r in got}) == len(got) == len(tables) * slots  # empty slots stay
    assert len(filled) == len({(r.g, r.item) for r in filled}) == len(tables) * min(slots, items)
    assert all((r.item is None) == (r.profit is None) for r in got)
    assert {g: sum(r.profit for r in filled if r.g == g) for g in want} == want


def test_an_edge_given_twice_is_refused(spark):
    df = spark.createDataFrame([(0, 0, 0, 1.0), (0, 0, 0, 3.0)], EDGE)
    with pytest.raises(Exception, match="duplicate entries"):
        P._solver(["g"], "slot", "item")(df.withColumn("copies", F.lit(1)).toPandas())


def test_contenders_keep_the_optimum(spark):
    [table] = groups_of(4, 3, 7, 1)
    df = spark.createDataFrame(edge_rows(table), EDGE)
    kept = P.keep_contenders(df, ["g"], "slot", "item")
    assert kept.count() == 9
    assert P.assign(kept, ["g"], "slot", "item").agg({"profit": "sum"}).first()[0] == brute(table)


def test_categories_are_used_as_often_as_drawn(spark):
    rng = random.Random(8)
    day = date(2024, 1, 1)
    profits = [(day, h, c, float(rng.randint(1, 50))) for h in range(5) for c in "abc"]
    draws = [(day, "a", 3), (day, "b", 1)]
    p = spark.createDataFrame(profits, "broadcast_day date, ts int, category string, profit double")
    d = spark.createDataFrame(draws, "broadcast_day date, category string, draws bigint")
    got = P.assign_categories(p, d).collect()
    table = {(h, c): v for _, h, c, v in profits}
    matrix = [[table[h, c] for c in "aaab"] for h in range(5)]
    assert sum(r.profit for r in got if r.category) == brute(matrix)
    assert len(got) == 5 and sum(r.category is None for r in got) == 1  # four draws for five slots
    used = [r.category for r in got]
    assert (used.count("a"), used.count("b"), used.count("c")) == (3, 1, 0)


def test_draws_sum_up_and_repeat(spark):
    days = spark.createDataFrame([(date(2024, 1, d),) for d in range(1, 31)], "broadcast_day date")
    mix = [("a", 0.7), ("b", 0.2), ("c", 0.1)]
    first = P.draw_category_mix(days, mix).collect()
    assert sum(r.draws for r in first) == 30 * 22
    assert sorted(first) == sorted(P.draw_category_mix(days, mix).collect())
    share = sum(r.draws for r in first if r.category == "a") / 660
    assert 0.63 < share < 0.77


def test_late_days_take_two_weeks(spark):
    offers = spark.createDataFrame(
        [(date(2020, 6, 24), "old"), (date(2020, 6, 30), "new")], "ymd date, product_code string"
    )
    days = spark.createDataFrame([(date(2020, 6, 26),), (date(2020, 6, 29),)], "broadcast_day date")
    got = {tuple(r) for r in P.week_candidates(offers, days, "2020-06-29").collect()}
    assert got == {
        (date(2020, 6, 26), "old"), (date(2020, 6, 29), "old"), (date(2020, 6, 29), "new"),
    }


def test_grid_covers_all_slots(spark):
    products = spark.createDataFrame([("a",), ("b",)], "product_code string")
    cells = P.cross_schedule(products, "2020-06-01", "2020-06-02")
    assert cells.count() == 96
    assert cells.agg({"ts": "max"}).first()[0] == datetime(2020, 6, 2, 23)


def test_triplet_wins_match_all_triplets(spark):
    from collections import Counter
    from itertools import combinations

    rng = random.Random(2)
    strength = {f"c{i:02d}": rng.randint(1, 6) for i in range(12)}
    wins = Counter(max(t, key=lambda c: (strength[c], [-ord(x) for x in c])) for t in combinations(sorted(strength), 3))
    df = spark.createDataFrame(list(strength.items()), "c string, s int")
    assert {r.c: r.wins for r in triplet_wins(df, "c", "s").collect()} == dict(wins)


def test_prices_prove_the_assignment():
    rng = random.Random(21)
    for _ in range(200):
        shape = rng.randint(1, 6), rng.randint(1, 7)
        m = np.array([[rng.choice([float("nan"), rng.randint(-9, 30)]) for _ in range(shape[1])] for _ in range(shape[0])], float)
        pairs, rows, columns, empty = P.priced_assignment(m)
        allowed = ~np.isnan(m)
        assert (columns >= -1e-9).all() and (rows >= empty - 1e-9).all()
        assert ((m - rows[:, None] - columns)[allowed] <= 1e-9).all()
        value = sum(m[r, c] for r, c in pairs) + empty * (shape[0] - len(pairs))
        assert abs(value - rows.sum() - columns.sum()) < 1e-6
        assert set(np.flatnonzero(columns > 1e-9)) <= {c for _, c in pairs}


def test_slots_without_edges_stay(spark):
    df = spark.createDataFrame(
        [(0, 1, 7, 5.0), (0, 1, 8, float("nan")), (0, 2, 7, None), (1, 3, 7, float("nan"))], EDGE
    )
    slots = spark.createDataFrame([(0, 1), (0, 9), (2, 4)], "g int, slot int")
    got = {(r.g, r.slot): (r.item, r.profit) for r in P.assign(df, ["g"], "slot", "item", slots=slots).collect()}
    assert got == {(0, 1): (7, 5.0), **{k: (None, None) for k in ((0, 2), (0, 9), (1, 3), (2, 4))}}


def test_nan_profits_push_out_no_edge(spark):
    df = spark.createDataFrame([(0, 0, i, float("nan")) for i in range(3)] + [(0, 0, 9, 5.0)], EDGE)
    assert [tuple(r) for r in P.assign(df, ["g"], "slot", "item").collect()] == [(0, 0, 9, 5.0)]


def test_proof_holds_for_best_and_fails_for_others(spark):
    rows = [row for g, m in enumerate(groups_of(22, 5, 30)) for row in edge_rows(m, g)]
    df = spark.createDataFrame(rows, EDGE)
    solved = P.solve_groups(df, ["g"], "slot", "item").cache()
    good = P.proof(df, solved, ["g"], "slot", "item").collect()
    assert all(r.gap < 1e-9 and r.above < 1e-9 and r.n_filled == 5 and not r.n_repeated for r in good)
    kept = solved.where("kind = 'item' OR slot > 0")
    first = df.where("slot = 0").groupBy("g").agg(F.min_by("item", "profit").alias("item"), F.min("profit").alias("profit"))
    other = first.join(solved.where("kind = 'slot' AND slot = 0").drop("item", "profit"), "g")
    bad = P.proof(df, kept.unionByName(other.select(kept.columns)), ["g"], "slot", "item").collect()
    assert all(r.gap > 1e-6 for r in bad)
