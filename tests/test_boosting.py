"""Trees grown in one task against Spark's trainer, and the rounds that the end-to-end runs ask for."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from slotcast import constants as K
from slotcast.operators import boosting, model
from slotcast.plans import forecasting

PARAMS = {"maxIter": 6, "stepSize": 0.1, "minInstancesPerNode": 7}


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    n = 900
    x, y, kind, late = rng.normal(size=n), rng.integers(0, 40, n), rng.integers(0, 9, n), rng.normal(size=n)
    sales = 3 * np.sin(2 * x) + 0.1 * y + np.cos(kind) + late + 0.1 * rng.normal(size=n)
    made = [
        (float(a), int(b), "abcdefghi"[c] if c < 8 else None, float(d) if d > -1 else None, float(s))
        for a, b, c, d, s in zip(x, y, kind, late, sales)
    ]
    return spark.createDataFrame(made, "x double, y int, kind string, lag_sales_1 double, sales double").coalesce(2)


NAMES = ["x", "y", "kind", "lag_sales_1"]


def fit(rows, monkeypatch, many, params=PARAMS, bins=32):
    monkeypatch.setattr(K, "MANY_ROUNDS", many)
    return model.train_model(rows, NAMES, params, categorical=["kind"], max_bins=bins)


def test_trees_are_those_of_sparks_trainer(rows, monkeypatch, tmp_path):
    own = fit(rows, monkeypatch, 1)
    monkeypatch.setattr(boosting, "fit_boosted", None)  # not used from here on
    theirs = fit(rows, monkeypatch, 1000)
    scored = model.predict(theirs, model.predict(own, rows, NAMES, "a", ["kind"]), NAMES, "b", ["kind"])
    assert scored.where(F.abs(F.col("a") - F.col("b")) > 1e-9).count() == 0
    assert scored.agg(F.stddev("a")).first()[0] > 0.5
    a, b = own.stages[-1], theirs.stages[-1]
    assert a.getNumTrees == b.getNumTrees == 6 and a.treeWeights == b.treeWeights and a.numFeatures == b.numFeatures
    assert a.totalNumNodes == b.totalNumNodes
    assert np.allclose(a.featureImportances.toArray(), b.featureImportances.toArray(), atol=1e-9)
    loaded = model.load_model(model.save_model(own, str(tmp_path / "m")))
    assert model.predict(loaded, rows, NAMES, "c", ["kind"]).agg(F.sum("c")).first()[0] == pytest.approx(
        scored.agg(F.sum("a")).first()[0]
    )


def test_large_fits_and_odd_labels(rows, monkeypatch):
    monkeypatch.setattr(K, "FIT_CELLS", 900 * 4)  # with the flag of the lag there are five inputs
    monkeypatch.setattr(boosting, "fit_boosted", None)
    assert fit(rows, monkeypatch, 1).stages[-1].getNumTrees == 6
    monkeypatch.undo()
    flat = rows.select("x", "y", "kind", "lag_sales_1", F.lit(2.0).alias("sales"))
    assert fit(flat, monkeypatch, 1).stages[-1].totalNumNodes == 6  # roots only
    with pytest.raises(Exception, match="null or NaN"):
        fit(rows.withColumn("sales", F.when(F.col("y") > 3, F.col("sales"))), monkeypatch, 1)
    few = fit(rows.limit(3), monkeypatch, 1, {**PARAMS, "minInstancesPerNode": 1})  # fewer rows than categories
    assert few.stages[-1].getNumTrees == 6


def test_bins_hold_about_equal_counts():
    values = np.repeat(np.arange(100.0), 10)
    cuts = boosting.thresholds(values, 10)
    assert len(cuts) == 9 and set(np.diff(cuts)) == {10.0}
    assert list(boosting.thresholds(np.array([3.0, 1.0, 1.0]), 10)) == [2.0]
    assert list(boosting.thresholds(np.array([3.0, 3.0]), 10)) == []


@pytest.mark.parametrize("run", ["forecast", "counterfactual"])
def test_runs_take_all_rounds_of_the_table(run, rows, monkeypatch):
    asked = []

    class Asked(Exception):
        pass

    def train(own, names, params, **_):
        asked.append(params)
        raise Asked

    frame = rows.selectExpr(
        "current_timestamp() as ts", "string(y) as product_code", "x as mean_sales_origin", "8 as months",
        "y % 2 as weekends", "kind as category", "sales", "lag_sales_1",
    )
    monkeypatch.setattr(model, "train_model", train)
    monkeypatch.setattr(forecasting, "stage", lambda *_: None)
    monkeypatch.setattr(forecasting, "finish", lambda *_: type("Made", (), {"frame": frame}))
    with pytest.raises(Asked):
        if run == "forecast":
            forecasting.forecast(frame, frame, frame)
        else:
            forecasting.counterfactual(frame, frame, None, forecasting.FeatureConfig())
    assert asked and all(p in K.MODEL_PARAMS.values() and p["maxIter"] > 2900 for p in asked)


def test_candidates_are_scored_in_one_pass_of_narrow_rows(spark, monkeypatch):
    made = spark.range(400).select(
        F.expr("timestamp_ntz'2024-06-01' + make_interval(0, 0, 0, 0, int(id))").alias("ts"),
        F.concat(F.lit("p"), F.col("id") % 20).alias("product_code"), F.concat(F.lit("cat"), F.col("id") % 3).alias("category"),
        F.when(F.col("id") % 2 == 0, "s1").otherwise("s2").alias("small_c"), (F.col("id") % 24).cast("int").alias("hours_inweek"),
        F.when(F.col("id") < 200, 8).otherwise(12).alias("months"), (F.col("id") * 7 % 100).cast("double").alias("mean_sales_origin"),
    )
    train = made.withColumn("sales", F.col("mean_sales_origin") + F.col("hours_inweek"))
    lost = made.where("product_code = 'p3'").limit(1).withColumn("product_code", F.lit(None).cast("string"))
    grid = made.withColumns({"months": F.lit(6)}).unionByName(lost)
    kept_tables = {}

    def stored(df, label="stored"):
        kept_tables[label] = df.columns
        return settled(df)

    settled = forecasting.settle
    monkeypatch.setattr(forecasting, "stored", stored)
    for tier in ("all", "top"):  # so few rows split too
        monkeypatch.setitem(K.MODEL_PARAMS, ("weekday", tier), {"stepSize": 0.1, "minInstancesPerNode": 5, "maxIter": 3})
    scored = forecasting.score_candidates(train, grid, month=8, sizes=(100, 50), n_top=10, rounds=3).collect()
    assert "sales" in kept_tables["coded"] and len(kept_tables["scored"]) == 6  # no other table, and no wide grid
    assert len(kept_tables) == 2
    assert scored[0].asDict().keys() == {"ts", "product_code", "category", "pred", "pred_mixed"}
    want = {(r.ts, r.product_code): r for r in made.collect()}
    assert len(scored) == 400 and all(want[r.ts, r.product_code].category == r.category for r in scored)
    best = sorted(want, key=lambda k: (-want[k].mean_sales_origin, *k))[:10]
    assert {(r.ts, r.product_code) for r in scored if r.pred != r.pred_mixed} <= set(best)
    assert len({r.pred for r in scored}) > 1
