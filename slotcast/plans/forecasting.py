"""Feature tables to models, predictions, submission, candidate scores, counterfactual run."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F

from .. import constants as K
from ..operators import encode, model
from ..operators.evaluate import metrics, mix_predictions, time_split
from ..operators.schedule import submission
from ..session import apart, settle, stored
from .features import FeatureConfig, SideTables, finish, stage

PARTS = {"weekday": 0, "weekend": 1}
KEYS = ("ts", "product_code")
CODED = ("product_no", "category", "weekdays", "small_c", "middle_c", "big_c", "original_c", "pay", "exposed_t")
SETS = ("weekdays", "small_c", "middle_c", "big_c")
NOT_INPUTS = (*K.USELESS_COLUMNS, *KEYS, "sales", "show_id", "broadcast_day", "k")
CANDIDATE_DROPS = ("product_no", "original_c", "min_start")  # the reduced chain has no start minute
Models = Mapping[str, tuple[PipelineModel, PipelineModel]]


def encoded(frames: Sequence[DataFrame], columns: Sequence[str] = CODED) -> list[DataFrame]:
    """Zero-fill lag columns and code the string columns, fitted over all frames.

    The product code stays as the key; its code is the column ``product_no``.
    """
    frames = [f.withColumn("product_no", F.col("product_code")) for f in frames]
    columns = [c for c in columns if all(c in f.columns for f in frames)]
    values = [f.select(*columns).distinct() for f in frames]  # many rows have few of them
    codes = settle(encode.code_tables(encode.stack(values), columns))
    return [encode.label_encode(encode.na_to_zeroes(f), columns, codes) for f in frames]


def input_columns(df: DataFrame, part: str | None = None, shared: Sequence[str] | None = None):
    """Numeric columns by name, without keys, target, dropped columns and the other part's lags."""
    other = {"weekday": "lag_sales_wk_", "weekend": "lag_sales_wd_"}.get(part)
    return [
        c for c, kind in df.dtypes
        if c not in NOT_INPUTS
        and kind not in ("string", "date", "timestamp_ntz")
        and not (other and c.startswith(other))
        and (shared is None or c in shared)
    ]


def train_parts(
    train: DataFrame, month: int = 8, sizes: Mapping[str, tuple[int, int]] | None = None,
    rounds: int | None = K.ROUNDS, shared: Sequence[str] | None = None,
) -> Models:
    """Base and top model for weekdays and weekends on encoded features."""
    sizes = sizes or K.TOP_SLICES

    def fit(part: str) -> tuple[PipelineModel, PipelineModel]:
        own = train.where(F.col("weekends") == PARTS[part])
        names = input_columns(own, part, shared)
        sets = [c for c in names if c in SETS]
        return model.fit_two_tier(own, names, part, month, sizes[part], rounds, sets)

    fits = [lambda part=part: fit(part) for part in PARTS]
    return dict(zip(PARTS, model.fit_side_by_side(train.sparkSession, fits)))


def _score(models, rows, part, n, shared, ranked=None):
    names = input_columns(rows, part, shared)
    sets = [c for c in names if c in SETS]
    return model.score_two_tier(models, rows, names, n, sets, ranked=ranked)


def validate_parts(
    models: Models, train: DataFrame, month: int = 8,
    sizes: Mapping[str, tuple[int, int]] | None = None, shared: Sequence[str] | None = None,
) -> DataFrame:
    """Metrics of the mixed prediction on the rows after ``month``, per part."""
    sizes, rows = sizes or K.TOP_SLICES, []
    for part, flag in PARTS.items():
        own = train.where(F.col("weekends") == flag)
        _, val = time_split(own, month)
        mixed = _score(models[part], val, part, sum(sizes[part]), shared, ranked=own)
        rows.append(metrics(mixed).withColumn("part", F.lit(part)))
    return encode.stack(rows)


def predict_parts(
    models: Models, test: DataFrame, n_top: Mapping[str, int] | None = None,
    shared: Sequence[str] | None = None,
) -> DataFrame:
    """Key and mixed prediction as ``sales`` for the rows of both parts."""
    n_top, parts = n_top or K.MIX_TOP["test"], []
    for part, flag in PARTS.items():
        scored = _score(models[part], test.where(F.col("weekends") == flag), part, n_top[part], shared)
        parts.append(scored.select(*KEYS, F.col("prediction").alias("sales")))
    return encode.stack(parts)


def _predicted(
    train: DataFrame, test: DataFrame, n_top: Mapping[str, int] | None, **options
) -> DataFrame:
    """Encode jointly, train on the shared columns, and return test rows with predictions."""
    shared = [c for c in [*train.columns, "product_no"] if c in [*test.columns, "product_no"]]
    coded_train, coded_test = (stored(f, "coded") for f in encoded([train, test]))
    models = train_parts(coded_train, shared=shared, **options)
    if coded_test.count() * len(coded_test.columns) <= K.FIT_CELLS:  # too few for many tasks, but each row takes long
        coded_test = coded_test.repartition(int(test.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = settle(predict_parts(models, coded_test, n_top, shared))
    return test.drop("sales").join(found, list(KEYS))


def forecast(
    train: DataFrame, raw_test: DataFrame, test: DataFrame,
    n_top: Mapping[str, int] | None = None, rounds: int | None = None, **options,
) -> DataFrame:
    """Train, predict and build the submission; the models take all rounds of the parameter table."""
    return submission(raw_test, [_predicted(train, test, n_top, rounds=rounds, **options)])


def score_candidates(
    train: DataFrame, candidates: DataFrame, month: int = 8,
    sizes: tuple[int, int] = K.TOP_SLICES["schedule"], n_top: int = K.MIX_TOP["schedule"],
    rounds: int | None = K.ROUNDS, kept: Sequence[str] = ("category",),
) -> DataFrame:
    """Key and ``kept`` columns of candidates, the base model's value ``pred`` and the mixed one ``pred_mixed``, stored.

    Both models are fitted on the columns that candidates have as well.  Candidates are many, so they are neither
    stored nor joined with their scores: one pass makes, codes and scores them and stores narrow rows.
    """
    shared = [c for c in train.columns if c in candidates.columns and c not in CANDIDATE_DROPS]
    own = {c: f"_own_{c}" for c in kept}
    score = "mean_sales_origin"
    named = candidates.where(F.col(KEYS[0]).isNotNull() & F.col(KEYS[1]).isNotNull()).withColumns(
        {name: F.col(c) for c, name in own.items()}
    )
    needed = [c for c in named.columns if c in {*shared, *own.values(), *KEYS, *CODED, score}]
    coded_train, coded_grid = encoded([train, apart(named.select(*needed))])
    coded_train = stored(coded_train, "coded")
    names = input_columns(coded_train, None, shared)
    sets = [c for c in names if c in SETS]
    base, top = model.fit_two_tier(coded_train, names, "weekday", month, sizes, rounds, sets)
    rows = apart(coded_grid.select(*KEYS, *own.values(), *dict.fromkeys([score, *names])))
    for fitted, name in ((base, "pred_base"), (top, "pred_top")):
        rows = apart(model.predict(fitted, rows, names, name, sets))
    scored = stored(rows.select(*KEYS, *own.values(), score, "pred_base", "pred_top"), "scored")
    mixed = mix_predictions(scored, n_top, keys=list(KEYS))
    return mixed.select(
        *KEYS, *[F.col(name).alias(c) for c, name in own.items()],
        F.col("pred_base").alias("pred"), F.col("prediction").alias("pred_mixed"),
    )


def counterfactual(
    train: DataFrame, raw_test: DataFrame, side: SideTables, config: FeatureConfig,
    n_top: Mapping[str, int] | None = None, rounds: int | None = None, **options,
) -> DataFrame:
    """Predictions without December history and click signals, next to the normal ones.

    The models are fitted again on the columns that each test set has, with all rounds of the parameter table.
    """
    config = replace(config, mode="test")
    staged = stage(raw_test, side, config)  # shows and categories are the same in both runs
    tests = [stored(finish(staged, side, replace(config, counterfactual=off)).frame, "test") for off in (False, True)]
    runs = [lambda test=test: _predicted(train, test, n_top, rounds=rounds, **options) for test in tests]
    normal, without = model.fit_side_by_side(train.sparkSession, runs)
    normal = normal.select(*KEYS, F.col("sales").alias("sales_normal"))
    kept = without.select(*[c for c in K.BASE_COLUMNS if c in without.columns])
    return kept.join(normal, list(KEYS)).withColumn(
        "difference", F.col("sales_normal") - F.col("sales")
    )
