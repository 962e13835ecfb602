"""Column selection, null filling and encodings."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import constants as K
from ..session import settle
from . import ordered as O
from .lookup import lookup_join


def drop_useless(df: DataFrame, columns: Sequence[str] = K.USELESS_COLUMNS) -> DataFrame:
    return df.drop(*columns)


def na_to_zeroes(
    df: DataFrame,
    columns: Sequence[str] = K.LAG_PERIOD_COLUMNS + K.HISTORY_COLUMNS + K.MIDDLE_CLICK_COLUMNS,
) -> DataFrame:
    return df.fillna(0, subset=[c for c in columns if c in df.columns])


def select_common(df: DataFrame, other: DataFrame) -> DataFrame:
    """Only the columns that ``other`` has too."""
    return df.select(*[c for c in df.columns if c in other.columns])


def stack(frames: Sequence[DataFrame], outer: bool = False) -> DataFrame:
    """Union by name; with ``outer`` missing columns become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=outer), frames)


def drop_rows(df: DataFrame, mode: str, dummy_sales: float = K.DUMMY_SALES) -> DataFrame:
    """Train: rows with real sales; test and hourly grid: priced rows; weekly grid: all rows."""
    if mode == "train":
        return df.where(F.col("sales").isNotNull() & (F.col("sales") != dummy_sales))
    if mode in ("test", "hungarian"):
        return df.where(F.col("unit_price").isNull() | (F.col("unit_price") != 0))
    return df


def string_columns(df: DataFrame) -> list[str]:
    return [name for name, kind in df.dtypes if kind == "string"]


def code_table(df: DataFrame, column: str, chunks: int | None = None) -> DataFrame:
    """Value and code 0..k-1 in sorted order of the distinct values."""
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    placed = O.with_position(O.in_order(values, column, chunks=chunks))
    return placed.select(column, F.col(O.POSITION).cast("int").alias("code"))


def code_tables(df: DataFrame, columns: Sequence[str], chunks: int | None = None) -> DataFrame:
    """Codes of several columns at once: (column_name, value, code).

    One pass over the facts and one sort for all columns.
    """
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value")) for c in columns]
    )
    distinct = df.select(F.inline(pairs)).where(F.col("value").isNotNull()).distinct()
    placed = O.with_position(O.in_order(distinct, "column_name", "value", chunks=chunks))
    base = placed.groupBy("column_name").agg(F.min(O.POSITION).alias("_base"))
    return placed.join(F.broadcast(base), "column_name").select(  # one row per encoded column
        "column_name", "value", (F.col(O.POSITION) - F.col("_base")).cast("int").alias("code")
    )


def label_encode(
    df: DataFrame, columns: Sequence[str] | None = None, codes: DataFrame | None = None
) -> DataFrame:
    """Replace string columns by their codes, fitted on ``df`` unless stored ``codes`` are given."""
    columns = list(columns or string_columns(df))
    codes = settle(code_tables(df, columns)) if codes is None else codes
    order = df.columns
    for c in columns:
        one = codes.where(F.col("column_name") == c).select(
            F.col("value").alias(c), F.col("code").alias("_code")
        )
        df = lookup_join(df, one, c, stored=True).drop(c).withColumnRenamed("_code", c)
    return df.select(*order)


def factorize(df: DataFrame, column: str, order: str = "ts") -> DataFrame:
    """Value and code by first appearance."""
    firsts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.min(order).alias("_first"))
    placed = O.with_position(O.in_order(firsts, "_first", column))
    return placed.select(column, F.col(O.POSITION).cast("int").alias("code"))


def one_hot(df: DataFrame, values: dict[str, Sequence]) -> DataFrame:
    """Replace each column by one 0/1 column per listed value, named column_value."""
    flags: list[Column] = []
    for c, options in values.items():
        for v in options:
            hit = F.when(F.col(c) == F.lit(v), 1).otherwise(0)
            flags.append(hit.alias(f"{c}_{str(v).replace(' ', '_')}"))
    return df.select(*[c for c in df.columns if c not in values], *flags)


def one_hot_vectors(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One sparse vector ``<column>_vec`` per column, for columns with many values.

    The codes come from a distributed table; only the largest code reaches the driver.
    """
    indexed = {f"{c}_idx": F.col(c) for c in columns}
    coded = label_encode(df.withColumns(indexed), list(indexed))
    encode = OneHotEncoder(
        inputCols=list(indexed), outputCols=[f"{c}_vec" for c in columns], dropLast=False,
        handleInvalid="keep",
    )
    prepared = coded.withColumns({i: F.col(i).cast("double") for i in indexed})
    return encode.fit(prepared).transform(prepared).drop(*indexed)


def one_hot_names(df: DataFrame, columns: Sequence[str] = K.ONE_HOT_COLUMNS) -> DataFrame:
    """All 0/1 columns of a one-hot encoding: (position, column_name, value).

    Values count as text; positions go by the order of ``columns`` and then by value.
    """
    codes = settle(code_tables(df.select(*[F.col(c).cast("string").alias(c) for c in columns]), columns))
    place = F.create_map(*[x for i, c in enumerate(columns) for x in (F.lit(c), F.lit(i))])
    sizes = codes.groupBy("column_name").agg(F.count(F.lit(1)).alias("_n"))  # one row per column
    before = Window.orderBy(place[F.col("column_name")]).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("column_name", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return codes.join(F.broadcast(offsets), "column_name").select(
        (F.col("_base") + F.col("code")).cast("int").alias("position"), "column_name", "value"
    )


def one_hot_rows(
    df: DataFrame, columns: Sequence[str] = K.ONE_HOT_COLUMNS, names: DataFrame | None = None,
    output: str = "hot",
) -> DataFrame:
    """Replace the columns by the sorted positions of their ones, a sparse row of all 0/1 columns.

    ``names`` are stored names of another table, else they are taken from ``df``.  Nulls and values without
    a name have no one.
    """
    names = settle(one_hot_names(df, columns)) if names is None else names
    others, found = [c for c in df.columns if c not in columns], []
    for i, c in enumerate(columns):
        own = names.where(F.col("column_name") == c).select(
            F.col("value").alias(f"_v{i}"), F.col("position").alias(f"_p{i}")
        )
        df = lookup_join(df.withColumn(f"_v{i}", F.col(c).cast("string")), own, f"_v{i}", stored=True)
        found.append(F.col(f"_p{i}"))
    return df.select(*others, F.array_sort(F.array_compact(F.array(*found))).alias(output))
