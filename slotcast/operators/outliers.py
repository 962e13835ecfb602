"""Isolation forest: sampled trees grown in tasks, rows scored in Arrow batches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import constants as K
from ..functions.scalar import uniform
from ..session import settle, ship
from . import ordered as O

NODE_SCHEMA = "tree int, node int, feature int, split double, left int, right int, path double"


def expected_path(n: int) -> float:
    """Mean depth of an unsuccessful search in a binary tree of ``n`` points."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2.0 * (math.log(n - 1) + np.euler_gamma) - 2.0 * (n - 1) / n


def _grow(sample: pd.DataFrame, columns: list[str], seed: int) -> pd.DataFrame:
    tree = int(sample["tree"].iloc[0])
    points = sample.sort_values(["_u", *columns])[columns].to_numpy(float)
    rng = np.random.default_rng([seed, tree])
    max_depth = max(1, math.ceil(math.log2(max(2, len(points)))))
    nodes, work = [], [(0, points, 0)]
    count = 1
    while work:
        node, rows, depth = work.pop()
        spread = np.flatnonzero(rows.max(axis=0) > rows.min(axis=0)) if len(rows) else []
        if depth >= max_depth or len(rows) <= 1 or len(spread) == 0:
            nodes.append((tree, node, -1, 0.0, -1, -1, depth + expected_path(len(rows))))
            continue
        feature = int(rng.choice(spread))
        low, high = rows[:, feature].min(), rows[:, feature].max()
        split = float(rng.uniform(low, high))
        below = rows[:, feature] <= split
        left, right = count, count + 1
        count += 2
        nodes.append((tree, node, feature, split, left, right, 0.0))
        work += [(left, rows[below], depth + 1), (right, rows[~below], depth + 1)]
    return pd.DataFrame(nodes, columns=["tree", "node", "feature", "split", "left", "right", "path"])


def _smallest(rows: DataFrame, n: int, columns: list[str]) -> DataFrame:
    """The ``n`` rows with the smallest hashes, looked for below a hash limit first."""
    total = rows.count()
    if total > 8 * n:
        near = rows.where(F.col("_u") < 4.0 * n / total)
        rows = near if near.count() >= n else rows
    return rows.orderBy("_u", *columns).limit(n)


def fit_forest(
    df: DataFrame, columns: list[str], keys: list[str], trees: int = K.OUTLIER_TREES,
    samples: int = K.OUTLIER_SAMPLES, seed: int = K.SEED,
) -> DataFrame:
    """Tree nodes grown on hash-chosen samples of ``samples`` rows per tree.

    The pool holds trees * samples rows, so all later steps are bounded by the parameters.
    """
    ship(df.sparkSession)
    values = [F.col(c).cast("double").alias(c) for c in columns]
    rows = df.select(*values, uniform(seed, *keys).alias("_u")).dropna()
    pool = settle(_smallest(rows, trees * samples, columns))
    each = pool.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    drawn = Window.partitionBy("tree").orderBy(uniform(seed, "tree", "_u"), "_u", *columns)
    chosen = each.withColumn("_n", F.row_number().over(drawn)).where(F.col("_n") <= samples)
    return chosen.groupBy("tree").applyInPandas(lambda s: _grow(s, columns, seed), NODE_SCHEMA)


def anomaly_score(nodes: DataFrame, columns: list[str], samples: int = K.OUTLIER_SAMPLES) -> Column:
    """Score column in (0, 1); higher is more isolated."""
    table = nodes.orderBy("tree", "node").toPandas()  # bounded by trees * samples
    forest = [
        tuple(t[c].to_numpy() for c in ("feature", "split", "left", "right", "path"))
        for _, t in table.groupby("tree")
    ]
    norm = expected_path(samples)

    @F.pandas_udf("double")
    def score(*series: pd.Series) -> pd.Series:
        x = np.column_stack([s.to_numpy(float) for s in series])
        total = np.zeros(len(x))
        for feature, split, left, right, path in forest:
            at = np.zeros(len(x), dtype=int)
            inner = feature[at] >= 0
            while inner.any():
                i = np.flatnonzero(inner)
                down = x[i, feature[at[i]]] <= split[at[i]]
                at[i] = np.where(down, left[at[i]], right[at[i]])
                inner = feature[at] >= 0
            total += path[at]
        return pd.Series(2.0 ** (-(total / len(forest)) / norm))

    return score(*[F.col(c).cast("double") for c in columns])


def flag_outliers(
    df: DataFrame, columns: list[str], keys: list[str], share: float = K.OUTLIER_SHARE,
    trees: int = K.OUTLIER_TREES, samples: int = K.OUTLIER_SAMPLES, seed: int = K.SEED,
) -> DataFrame:
    """Add ``score`` and ``outlier``: 1 for the ``share`` most isolated rows.

    The scored rows are stored: the cut and the flag both need them.
    """
    nodes = settle(fit_forest(df, columns, keys, trees, samples, seed))
    scored = settle(df.withColumn("score", anomaly_score(nodes, columns, samples)))
    cut = O.quantiles(scored, "score", [1.0 - share], stored=True).select("q0").scalar()
    return scored.withColumn("outlier", (F.col("score") > cut).cast("int"))


def remove_outliers(
    df: DataFrame, columns: list[str], keys: list[str], share: float = K.OUTLIER_SHARE, **options
) -> DataFrame:
    """Keep the inliers."""
    flagged = flag_outliers(df, columns, keys, share, **options)
    return flagged.where("outlier = 0").drop("score", "outlier")
