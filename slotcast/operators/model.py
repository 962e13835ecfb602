"""Boosted-tree models, prediction, importance and clustering."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import constants as K
from ..session import settle, shared_dir
from . import boosting, ordered as O
from .encode import stack
from .evaluate import metrics, mix_predictions, month_holdout, time_split, top_slice

KEYS = ["ts", "product_code"]


_IN, _SET, _NULL = "_in", "_set", "_null"
#: Parameters that ``boosting`` takes.
BOOSTED = {"maxIter", "stepSize", "minInstancesPerNode"}
#: Columns that are null where there is no past; a flag tells that from a zero.
FLAGGED = "lag_sales"


def input_names(columns: Sequence[str]) -> list[str]:
    flags = [f"{c}{_NULL}" for c in columns if c.startswith(FLAGGED)]
    return [f"{c}{_IN}" for c in columns] + flags


def with_inputs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add the numeric model inputs: ``<name>_in`` with nulls as 0, and ``<name>_null`` for sales lags."""
    values = {f"{c}{_IN}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns}
    flags = {f"{c}{_NULL}": F.col(c).isNull().cast("double") for c in columns if c.startswith(FLAGGED)}
    return df.withColumns({**values, **flags})


def train_model(
    train: DataFrame, features: Sequence[str], params: dict, label: str = "sales",
    categorical: Sequence[str] = (), max_bins: int = 256, seed: int = K.SEED,
) -> PipelineModel:
    """Boosted regression trees on named features; ``categorical`` ones are split as sets.

    A column with more values than ``max_bins`` raises the number of bins to match.  Fits of many rounds whose
    rows a task can hold are grown without jobs per level (``boosting``), all others by Spark's trainer.
    """
    shared_dir(train.sparkSession)
    numeric = [f for f in features if f not in categorical]
    rows = with_inputs(train.select(*dict.fromkeys([*numeric, *categorical, label])), numeric)
    stages = []
    if categorical:
        indexer = StringIndexer(
            inputCols=list(categorical), outputCols=[f"{c}{_SET}" for c in categorical],
            stringOrderType="alphabetAsc", handleInvalid="keep",
        ).fit(rows)
        stages.append(indexer)
        # one more value stands for what was not seen
        max_bins = max(max_bins, 1 + max(len(values) for values in indexer.labelsArray))
    assembled = input_names(numeric) + [f"{c}{_SET}" for c in categorical]
    stages.append(VectorAssembler(inputCols=assembled, outputCol="features"))
    if K.MANY_ROUNDS <= params["maxIter"] and params.keys() <= BOOSTED and 0 < rows.count() <= K.FIT_CELLS // len(assembled):
        ready = PipelineModel(stages)
        sizes = [1 + len(values) for values in indexer.labelsArray] if categorical else []
        fitted = boosting.fit_boosted(
            ready.transform(rows), label, dict(enumerate(sizes, len(assembled) - len(sizes))),
            params["maxIter"], params["stepSize"], params["minInstancesPerNode"], max_bins, seed,
        )
        return PipelineModel([*stages, fitted])
    stages.append(
        GBTRegressor(
            labelCol=label, predictionCol="prediction", seed=seed, maxBins=max_bins,
            checkpointInterval=10, **params,
        )
    )
    return Pipeline(stages=stages).fit(rows)


def predict(
    model: PipelineModel, df: DataFrame, features: Sequence[str], name: str,
    categorical: Sequence[str] = (),
) -> DataFrame:
    """``df`` with the model's value as ``name``; feature columns keep their own values."""
    numeric = [f for f in features if f not in categorical]
    ready = PipelineModel(model.stages[:-1]).transform(with_inputs(df, numeric))
    if model.stages[-1].getNumTrees >= K.MANY_ROUNDS:
        # the assembler makes vectors sparse, in which each of the trees' thousands of looks is a search
        ready = ready.withColumn("features", array_to_vector(vector_to_array("features")))
    scored = model.stages[-1].transform(ready)
    return scored.select(*df.columns, F.col("prediction").alias(name))


def fit_side_by_side(spark: SparkSession, fits: Sequence[Callable], most: int = 4) -> list:
    """Results of independent fits, at most ``most`` of which run at a time.

    A boosting round is a chain of short jobs, so one fit leaves most of a cluster idle.
    """
    with ThreadPool(min(most, len(fits))) as pool:
        return pool.map(lambda fit: fit(), [inheritable_thread_target(spark)(f) for f in fits], chunksize=1)


def save_model(model: PipelineModel, path: str) -> str:
    model.write().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def scaled_params(part: str, tier: str, rounds: int | None = K.ROUNDS) -> dict:
    """Parameter table entry with ``rounds`` trees and a step to match; None keeps the table's own."""
    params = dict(K.MODEL_PARAMS[(part, tier)])
    if rounds is not None:
        params["stepSize"] = min(0.3, params["stepSize"] * params["maxIter"] / rounds)
        params["maxIter"] = rounds
    return params


def fit_two_tier(
    df: DataFrame, features: Sequence[str], part: str, month: int = 8,
    sizes: tuple[int, int] | None = None, rounds: int | None = K.ROUNDS,
    categorical: Sequence[str] = (), keys: Sequence[str] = KEYS,
) -> tuple[PipelineModel, PipelineModel]:
    """Base model on the rows up to ``month`` and top model on the best-selling rows."""
    train, _ = time_split(df, month, list(keys))
    top_train, _ = top_slice(df, *(sizes or K.TOP_SLICES[part]), list(keys))
    fits = [
        lambda rows=rows, tier=tier: train_model(
            rows, features, scaled_params(part, tier, rounds), categorical=categorical
        )
        for rows, tier in ((train, "all"), (top_train, "top"))
    ]
    return tuple(fit_side_by_side(df.sparkSession, fits))


def score_two_tier(
    models: tuple[PipelineModel, PipelineModel], df: DataFrame, features: Sequence[str], n: int,
    categorical: Sequence[str] = (), keys: Sequence[str] = KEYS, ranked: DataFrame | None = None,
) -> DataFrame:
    """Predictions of both models and their mix over the ``n`` best-selling rows."""
    base, top = models
    both = predict(top, predict(base, df, features, "pred_base", categorical), features, "pred_top", categorical)
    return mix_predictions(both, n, keys=list(keys), ranked=ranked)


def robust_check(
    df: DataFrame, features: Sequence[str], part: str, month: int = 8, holdout: int = 12,
    sizes: tuple[int, int] | None = None, rounds: int | None = K.ROUNDS, **options,
) -> DataFrame:
    """Metrics of the mixed model on one held-out month."""
    sizes = sizes or K.TOP_SLICES[part]
    models = fit_two_tier(df, features, part, month, sizes, rounds, **options)
    scored = score_two_tier(
        models, month_holdout(df, holdout), features, sum(sizes), ranked=df, **options
    )
    return metrics(scored).withColumn("part", F.lit(part))


def expanding_cv(
    df: DataFrame, features: Sequence[str], part: str, months: Sequence[int] = K.CV_MONTHS,
    shares: Sequence[tuple[int, int]] | None = None, rounds: int | None = K.ROUNDS,
    categorical: Sequence[str] = (), keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Metrics per validation month: base model, and mixed model for each top size.

    Top models do not depend on the month, so each is fitted once.
    """
    rows, keys = [], list(keys)
    shares = K.CV_TOP_SHARES[part] if shares is None else shares
    ranks = [settle(O.top_positions(df, "mean_sales_origin", keys, sum(s))) for s in shares]
    slices = [top_slice(df, *s, keys, best=best)[0] for s, best in zip(shares, ranks)]
    splits = [time_split(df, month, keys) for month in months]
    fits = [
        lambda own=own, tier=tier: train_model(
            own, features, scaled_params(part, tier, rounds), categorical=categorical
        )
        for own, tier in [*((t, "all") for t, _ in splits), *((s, "top") for s in slices)]
    ]
    models = fit_side_by_side(df.sparkSession, fits)
    tops = [(sum(s), best, top) for s, best, top in zip(shares, ranks, models[len(splits):])]
    for month, (_, val), base in zip(months, splits, models):
        scored = predict(base, val, features, "pred_base", categorical)
        rows.append((month, "base", 0, metrics(scored, pred="pred_base")))
        for n, best, top in tops:
            both = predict(top, scored, features, "pred_top", categorical)
            rows.append((month, "mixed", n, metrics(mix_predictions(both, n, keys=keys, best=best))))
    return stack(
        [
            m.select(
                F.lit(part).alias("part"), F.lit(month).alias("month"), F.lit(kind).alias("kind"),
                F.lit(n).alias("top_rows"), *m.columns,
            )
            for month, kind, n, m in rows
        ]
    )


def feature_importance(spark: SparkSession, model: PipelineModel, k: int = 30) -> DataFrame:
    """The ``k`` most important features; a null flag counts for its column."""
    names = [c.removesuffix(_IN).removesuffix(_SET).removesuffix(_NULL) for c in model.stages[-2].getInputCols()]
    values = model.stages[-1].featureImportances.toArray()
    rows = [(n, float(v)) for n, v in zip(names, values)]  # as many as the model has inputs
    parts = spark.createDataFrame(rows, "feature string, importance double")
    table = parts.groupBy("feature").agg(F.sum("importance").alias("importance"))
    return table.orderBy(F.desc("importance"), "feature").limit(k)


def sample_silhouettes(df: DataFrame, features: Sequence[str], cluster: str = "cluster") -> DataFrame:
    """Squared-distance silhouette of every row, from per-cluster sums (no pairs of rows).

    Mean squared distance from x to a cluster is |x|² - 2 x·mean + mean |c|².  The cluster table
    has k rows, kept as one array.
    """
    squares = sum((F.col(f) * F.col(f) for f in features), F.lit(0.0))
    stats = df.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("n"), F.avg(squares).alias("sq"),
        *[F.avg(f).alias(f"m_{f}") for f in features],
    )
    table = stats.agg(F.collect_list(F.struct(*stats.columns)).alias("t")).scalar()  # k entries

    def distance(s):
        dot = sum((F.col(f) * s[f"m_{f}"] for f in features), F.lit(0.0))
        return squares - 2 * dot + s["sq"]

    rows = df.withColumn("_t", table)
    own = F.filter("_t", lambda s: s[cluster] == F.col(cluster))[0]
    others = F.filter("_t", lambda s: s[cluster] != F.col(cluster))
    rows = rows.withColumns(
        {
            "_n": own["n"],
            "_a": F.try_divide(distance(own) * own["n"], own["n"] - 1),
            "_b": F.array_min(F.transform(others, distance)),
        }
    )
    value = F.when(F.col("_n") <= 1, 0.0).otherwise(
        F.coalesce(F.try_divide(F.col("_b") - F.col("_a"), F.greatest("_a", "_b")), F.lit(0.0))
    )
    return rows.withColumn("silhouette", value).drop("_t", "_n", "_a", "_b")


#: Lloyd's rounds at most, and the movement of the centres at which they stop.
CLUSTER_ROUNDS, CLUSTER_MOVE = 300, 1e-6


def _clustered(df: DataFrame, features: Sequence[str], k: int, seed: int) -> tuple[DataFrame, list[list[float]]]:
    """Rows with ``cluster``, and the k centres."""
    assembler = VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="skip")
    points = assembler.transform(df)
    fitted = KMeans(
        k=k, seed=seed, maxIter=CLUSTER_ROUNDS, tol=CLUSTER_MOVE, featuresCol="_features", predictionCol="cluster"
    ).fit(points)
    return fitted.transform(points).drop("_features"), [[float(v) for v in c] for c in fitted.clusterCenters()]


def cluster(df: DataFrame, features: Sequence[str], k: int, seed: int = 10) -> DataFrame:
    """Add the k-means ``cluster`` of each row; rows with a null or NaN feature go."""
    return _clustered(df, features, k, seed)[0]


def cluster_proof(df: DataFrame, features: Sequence[str], k: int, seed: int = 10) -> DataFrame:
    """Check that a clustering stands still, from its rows and centres alone; one row.

    ``misplaced`` counts rows that are nearer to another centre than to their own, ``off_centre``
    clusters whose centre is not the mean of their rows.  Both are 0 at a fixed point.
    """
    rows, centres = _clustered(df, features, k, seed)
    gaps = [sum((F.pow(F.col(f) - F.lit(v), F.lit(2)) for f, v in zip(features, c)), F.lit(0.0)) for c in centres]
    own = F.element_at(F.array(*gaps), F.col("cluster") + 1)
    slack = F.lit(1 + 1e-9)  # rounding of a squared distance
    per = rows.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(own > F.array_min(F.array(*gaps)) * slack + F.lit(1e-9)).alias("misplaced"),
        *[F.avg(f).alias(f"_m{i}") for i, f in enumerate(features)],
    )
    table = F.array(*[F.array(*map(F.lit, c)) for c in centres])
    centre = F.element_at(table, F.col("cluster") + 1)
    shift = F.greatest(F.lit(0.0), *[F.abs(F.col(f"_m{i}") - centre[i]) / (1 + F.abs(centre[i])) for i in range(len(features))])
    return per.agg(
        F.sum("n").alias("n"), F.sum("misplaced").alias("misplaced"),
        F.count_if(shift > 10 * CLUSTER_MOVE).alias("off_centre"),
    )


def _per_pair(df: DataFrame, pairs, ks, table) -> DataFrame:
    """``table(rows, pair, k)`` of each feature pair and k, over rows that are stored once."""
    rows = settle(df.select(*dict.fromkeys(f for pair in pairs for f in pair)))

    def one(pair, k):
        made = table(rows, pair, k)
        return made.select(F.lit("+".join(pair)).alias("features"), F.lit(k).alias("k"), *made.columns)

    runs = [lambda pair=pair, k=k: one(pair, k) for pair in pairs for k in ks]
    return stack(fit_side_by_side(df.sparkSession, runs))


def kmeans_report(
    df: DataFrame, pairs: Sequence[tuple[str, str]], ks: Sequence[int] = (4, 5, 6), seed: int = 10
) -> DataFrame:
    """Average silhouette and size per cluster for each feature pair and k."""

    def table(rows, pair, k):
        scored = sample_silhouettes(cluster(rows, pair, k, seed), pair)
        return scored.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.avg("silhouette").alias("silhouette"))

    return _per_pair(df, pairs, ks, table)


def kmeans_proof(
    df: DataFrame, pairs: Sequence[tuple[str, str]], ks: Sequence[int] = (4, 5, 6), seed: int = 10
) -> DataFrame:
    """``cluster_proof`` of each clustering of ``kmeans_report``."""
    return _per_pair(df, pairs, ks, lambda rows, pair, k: cluster_proof(rows, pair, k, seed))
