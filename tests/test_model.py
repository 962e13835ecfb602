import random

import pytest
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from slotcast.operators import evaluate, model, outliers


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(1)
    rows = [(i, rng.gauss(10, 1), rng.gauss(5, 1)) for i in range(950)]
    rows += [(950 + i, rng.uniform(40, 90), rng.uniform(40, 90)) for i in range(50)]
    return spark.createDataFrame(rows, "id int, x double, y double").repartition(4)


def test_outlier_share_and_repeatability(points):
    first = outliers.flag_outliers(points, ["x", "y"], ["id"], 0.05).select("id", "outlier").collect()
    again = outliers.flag_outliers(points, ["x", "y"], ["id"], 0.05).select("id", "outlier").collect()
    assert sorted(first) == sorted(again)
    flagged = {r.id for r in first if r.outlier}
    assert 45 <= len(flagged) <= 50
    assert len([i for i in flagged if i >= 950]) >= 45
    kept = outliers.remove_outliers(points, ["x", "y"], ["id"], 0.05)
    assert kept.columns == ["id", "x", "y"] and kept.count() == 1000 - len(flagged)


def test_silhouette_matches_the_evaluator(points):
    rows = model.cluster(points, ["x", "y"], 4)
    own = model.sample_silhouettes(rows, ["x", "y"]).agg(F.avg("silhouette")).first()[0]
    vectors = VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(rows)
    spark_value = ClusteringEvaluator(predictionCol="cluster").evaluate(vectors)
    assert own == pytest.approx(spark_value, abs=1e-9)


def test_clusterings_stand_still_and_bad_ones_are_found(points, monkeypatch):
    rows = points.withColumn("x", F.when(F.col("id") != 3, F.col("x")))
    assert tuple(model.cluster_proof(rows, ["x", "y"], 3).first()) == (999, 0, 0)
    both = model.kmeans_proof(rows, [("x", "y"), ("y", "id")], (2, 3)).collect()
    assert sorted((r.features, r.k, r.n, r.misplaced, r.off_centre) for r in both) == [
        ("x+y", 2, 999, 0, 0), ("x+y", 3, 999, 0, 0), ("y+id", 2, 1000, 0, 0), ("y+id", 3, 1000, 0, 0)
    ]
    monkeypatch.setattr(model, "CLUSTER_ROUNDS", 1)
    bad = model.cluster_proof(points, ["x", "y"], 6).first()
    assert bad.n == 1000 and bad.off_centre > 0
    fitted = model._clustered
    monkeypatch.setattr(model, "_clustered", lambda *a: (fitted(*a)[0].withColumn("cluster", F.lit(0)), fitted(*a)[1]))
    assert model.cluster_proof(points, ["x", "y"], 3).first().misplaced > 0


def test_model_beats_the_mean_and_survives_saving(spark, points, tmp_path):
    df = points.withColumn("sales", 3 * F.col("x") + F.col("y")).withColumn(
        "kind", F.when(F.col("id") % 2 == 0, "a").otherwise("b")
    )
    fitted = model.train_model(
        df, ["x", "y", "kind"], {"maxIter": 5, "stepSize": 0.3, "minInstancesPerNode": 5}, categorical=["kind"]
    )
    loaded = model.load_model(model.save_model(fitted, str(tmp_path / "m")))
    scored = model.predict(loaded, df, ["x", "y", "kind"], "prediction", ["kind"])
    assert scored.columns == [*df.columns, "prediction"]
    mean = df.agg(F.avg("sales")).first()[0]
    rmse = evaluate.metrics(scored).first().rmse
    plain = evaluate.metrics(df.withColumn("prediction", F.lit(mean))).first().rmse
    assert rmse < plain / 2
    top = model.feature_importance(spark, loaded, 2).collect()
    assert len(top) == 2 and top[0].feature in ("x", "y")


def test_mixing_takes_exactly_the_top_rows(spark):
    rows = [(i, float(i // 3), 1.0, 2.0) for i in range(30)]
    df = spark.createDataFrame(rows, "id int, mean_sales_origin double, pred_base double, pred_top double")
    mixed = evaluate.mix_predictions(df, 7, keys=["id"]).collect()
    want = set(sorted(range(30), key=lambda i: (-(i // 3), i))[:7])
    assert {r.id for r in mixed if r.prediction == 2.0} == want
