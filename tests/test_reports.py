"""Correlations against numpy."""

import random

import numpy as np
import pytest

from slotcast.operators import reports


@pytest.mark.parametrize("offset", [0.0, 1.7e9])
def test_correlations_over_known_pairs(spark, offset):
    rng = random.Random(5)
    rows = []
    for i in range(900):
        x = rng.gauss(0, 1)
        row = [offset + x, x * 3 + rng.gauss(0, 2), rng.randint(0, 3), 7.1, offset - i]
        rows.append(tuple(None if k < 4 and rng.random() < 0.2 else v for k, v in enumerate(row)))
    names = ["a", "b", "c", "flat", "e"]
    df = spark.createDataFrame(rows, "a double, b double, c int, flat double, e double").repartition(5)
    got = {(r.col_a, r.col_b): r["corr"] for r in reports.corr_matrix(df, names).collect()}
    assert len(got) == 10
    data = np.array([[np.nan if v is None else v for v in row] for row in rows], dtype=float)
    data[:, [0, 4]] -= offset  # exact, and takes the rounding of large means out of the expected values
    for (a, b), value in got.items():
        x, y = (data[:, names.index(c)] for c in (a, b))
        both = ~np.isnan(x) & ~np.isnan(y)
        if "flat" in (a, b):
            assert value is None
        else:
            assert value == pytest.approx(np.corrcoef(x[both], y[both])[0, 1], abs=1e-7 if offset else 1e-12)


def test_correlations_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1.0, 2.0, nan, None), (2.0, 4.0, 1.0, 5.0), (3.0, 7.0, 2.0, None), (4.0, None, 5.0, None), (None, inf, 2.0, None)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    got = {(r.col_a, r.col_b): r["corr"] for r in reports.corr_matrix(df, ["a", "b", "c", "d"]).collect()}
    assert got["a", "b"] == pytest.approx(np.corrcoef([1, 2, 3], [2, 4, 7])[0, 1])  # infinity stands beside a null
    assert np.isnan(got["a", "c"]) and np.isnan(got["b", "c"])
    assert got["a", "d"] is got["b", "d"] is got["c", "d"] is None
    assert reports.corr_matrix(df.where("false"), ["a", "b"]).count() == 0
    assert reports.corr_matrix(df, ["a"]).count() == 0


def test_correlations_unfold_no_rows(spark):
    df = spark.range(10).selectExpr("id as a", "id * id as b", "-id as c")
    plan = reports.corr_matrix(df, ["a", "b", "c"])._jdf.queryExecution().toString()
    assert "Generate" not in plan and "MapInArrow" in plan
