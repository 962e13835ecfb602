"""Global order without a single-task window.

``in_order`` range-partitions the rows and keeps the result, so every row has a chunk number and a
place inside its chunk.  The other functions run a window inside each chunk and carry one summary
row per chunk across the borders; the summaries hold at most one row per partition.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import CODEC, scratch_path, settle, swept

CHUNK, PLACE, POSITION = "_chunk", "_place", "_position"
BINS = 4096
#: Rows of one bin that may be returned whole to the driver.
FEW = 10_000
_PLACE_BITS = 33  # monotonically_increasing_id keeps the row number in its lower 33 bits


def _numbered(df: DataFrame, order: Sequence[Column | str], chunks: int | None) -> DataFrame:
    if chunks is None:
        ranged = df.orderBy(*order)
    else:
        ranged = df.repartitionByRange(chunks, *order).sortWithinPartitions(*order)
    numbered = ranged.withColumn("_id", F.monotonically_increasing_id())
    return numbered.select(
        *df.columns,
        F.shiftright("_id", _PLACE_BITS).cast("int").alias(CHUNK),
        F.col("_id").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)).alias(PLACE),
    )


def in_order(df: DataFrame, *order: Column | str, chunks: int | None = None) -> DataFrame:
    """Sort ``df`` by ``order`` (which must end in a unique key) and number chunks and places."""
    return settle(_numbered(df, order, chunks))


def in_buckets(df: DataFrame, *order: Column | str, chunks: int | None = None) -> DataFrame:
    """Like ``in_order``, as a table in the shared folder that is bucketed by chunk.

    Windows and groups by chunk then read it without any exchange, so the sort is the only one.
    There are as many buckets as the sort has partitions at most.  The catalog needs the table's
    name only until the files are listed, so it is dropped here; the files stay.
    """
    spark = df.sparkSession
    name = f"slotcast_{uuid.uuid4().hex}"
    buckets = chunks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    with swept(spark):
        writer = _numbered(df, order, chunks).write.format("parquet").option("compression", CODEC)
        writer = writer.option("path", scratch_path(spark, "ordered"))
        writer.bucketBy(buckets, CHUNK).sortBy(PLACE).saveAsTable(name)
    kept = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return kept


def _inside() -> Window:
    return Window.partitionBy(CHUNK).orderBy(PLACE)


def _across() -> Window:
    # one row per chunk: bounded by the number of partitions
    return Window.orderBy(CHUNK)


def _before() -> Window:
    return _across().rowsBetween(Window.unboundedPreceding, -1)


def with_running(
    ordered: DataFrame, sums: dict[str, str | Column], position: str | None = POSITION
) -> DataFrame:
    """Add running sums (this row and all before it) and the 0-based position in one pass."""
    values = {n: (F.col(c) if isinstance(c, str) else c) for n, c in sums.items()}
    totals = ordered.groupBy(CHUNK).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.sum(v).alias(f"_{n}_total") for n, v in values.items()],
    )
    starts = totals.select(
        CHUNK,
        F.coalesce(F.sum("_rows").over(_before()), F.lit(0)).alias("_rows"),
        *[
            F.coalesce(F.sum(f"_{n}_total").over(_before()), F.lit(0)).alias(f"_{n}_before")
            for n in values
        ],
    )
    upto = _inside().rowsBetween(Window.unboundedPreceding, 0)
    added = {
        n: F.coalesce(F.sum(v).over(upto), F.lit(0)) + F.col(f"_{n}_before")
        for n, v in values.items()
    }
    if position:
        added[position] = F.col(PLACE) + F.col("_rows")
    out = ordered.join(F.broadcast(starts), CHUNK).withColumns(added)
    return out.drop("_rows", *[f"_{n}_before" for n in values])


def with_position(ordered: DataFrame, name: str = POSITION) -> DataFrame:
    """Add the 0-based position of each row in the global order."""
    return with_running(ordered, {}, name)


def with_running_sum(ordered: DataFrame, value: str, name: str) -> DataFrame:
    """Add the sum of ``value`` over this row and all rows before it."""
    return with_running(ordered, {name: value}, None)


def with_previous(ordered: DataFrame, columns: list[str], name: str = "prev") -> DataFrame:
    """Add a struct ``name`` with ``columns`` of the row before; null on the first row."""
    row = F.struct(*columns)
    last = ordered.groupBy(CHUNK).agg(F.max_by(row, PLACE).alias("_last"))
    borders = last.select(CHUNK, F.lag("_last").over(_across()).alias("_border"))
    return (
        ordered.join(F.broadcast(borders), CHUNK)
        .withColumn(
            name,
            F.when(F.col(PLACE) == 0, F.col("_border")).otherwise(F.lag(row).over(_inside())),
        )
        .drop("_border")
    )


def with_stretches(
    ordered: DataFrame, stretch: str, sums: Mapping[str, str], place: str, position: str = POSITION,
    firsts: Mapping[str, str] | None = None,
) -> DataFrame:
    """Add sums over each stretch of rows, the row's 1-based ``place`` in it and values of its first row.

    ``stretch`` numbers the stretches, rising along the order, so only the first and the last one of
    a chunk can go on in another: these two rows per chunk are added up and broadcast.
    """
    own = Window.partitionBy(CHUNK, stretch)
    first, firsts = f"_{position}", firsts or {}
    made = {**{n: F.sum(c) for n, c in sums.items()}, **{n: F.min_by(c, position) for n, c in firsts.items()}}
    parts = ordered.groupBy(CHUNK, stretch).agg(
        *[c.alias(n) for n, c in made.items()], F.min(position).alias(first)
    )
    part = F.struct(stretch, *made, first)
    ends = parts.groupBy(CHUNK).agg(F.min_by(part, stretch).alias("_low"), F.max_by(part, stretch).alias("_high"))
    both = F.when(F.col(f"_low.{stretch}") == F.col(f"_high.{stretch}"), F.array("_low")).otherwise(F.array("_low", "_high"))
    crossing = (
        ends.select(F.inline(both)).groupBy(stretch)
        .agg(
            *[F.sum(n).alias(f"_all_{n}") for n in sums], *[F.min_by(n, first).alias(f"_all_{n}") for n in firsts],
            F.min(first).alias(first), F.count(F.lit(1)).alias("_parts"),
        )
        .where("_parts > 1").drop("_parts")
    )
    found = ordered.withColumns(
        {**{n: c.over(own) for n, c in made.items()}, "_own": F.min(position).over(own)}
    ).join(F.broadcast(crossing), stretch, "left")
    whole = {n: F.when(F.col(first).isNull(), F.col(n)).otherwise(F.col(f"_all_{n}")) for n in made}
    whole[place] = (F.col(position) - F.coalesce(first, "_own") + 1).cast("int")
    return found.withColumns(whole).drop("_own", first, *[f"_all_{n}" for n in made])


def without_order(df: DataFrame) -> DataFrame:
    return df.drop(CHUNK, PLACE)


def top_rows(df: DataFrame, order: list[Column], first: int, last: int) -> DataFrame:
    """Rows with 1-based rank ``first``..``last`` under a total order.

    Meant for small ranks (top-k reports); see ``top_positions`` for ranks in the thousands.
    """
    return df.orderBy(*order).offset(first - 1).limit(last - first + 1)


def _near_top(rows: DataFrame, score: str, n: int, bins: int = BINS, spare: int = 2) -> DataFrame:
    """Rows at or above the bin of equal width that holds the ``n``-th highest score.

    One scan takes the range of the scores, a second counts rows per bin (``bins`` numbers reach the
    driver).  If the bin holds more than ``spare`` times ``n`` rows it is divided again, until it
    holds one value.  Infinite scores count as the largest numbers, NaN as the highest of all.
    """
    far = F.lit(1.7e308)
    value = F.greatest(F.least(F.nullif(F.col(score).cast("double"), F.lit(float("nan"))), far), -far) / 4
    known = F.col(score).isNotNull()
    no_number = known & F.isnan(F.col(score).cast("double"))
    ends = rows.agg(
        F.min(value).alias("low"), F.max(value).alias("high"), F.count_if(no_number).alias("odd"), F.count(score).alias("n")
    ).first()
    left, low, high = n - ends["odd"], ends["low"], ends["high"]
    if left <= 0:
        return rows.where(no_number)
    if n > ends["n"]:
        return rows  # scores that are null are needed too
    above, inside = no_number, known & ~no_number
    while high > low:
        place = F.least(F.floor((value - low) / (high - low) * bins), F.lit(bins - 1))
        counts = {
            r.place: r.n for r in rows.where(inside).groupBy(place.alias("place")).agg(F.count(F.lit(1)).alias("n")).collect()
        }
        for at in sorted(counts, reverse=True):
            if counts[at] >= left:
                break
            left -= counts[at]
        above, inside = above | (inside & (place > at)), inside & (place == at)
        step = (high - low) / bins
        if counts[at] <= spare * n or len(counts) == 1:
            break
        low, high = low + at * step, low + (at + 1) * step
    return rows.where(above | inside)


def top_positions(df: DataFrame, score: str, keys: list[str], n: int) -> DataFrame:
    """Keys and 0-based position of the ``n`` rows with the highest score (ties by key).

    Exact counts of the scores cut off the bulk first, so only few narrow rows are sorted.
    """
    near = _near_top(df.select(*keys, score), score, n)
    placed = with_position(in_order(near, F.desc_nulls_last(score), *map(F.col, keys)))
    return placed.where(F.col(POSITION) < n).select(*keys, POSITION)


def order_statistics(
    df: DataFrame, wanted: Mapping[str, Callable[[int], Sequence[int]]], bins: int = BINS, few: int = FEW
) -> dict[str, tuple[int, dict[int, float]]]:
    """Exact values at 0-based ranks of several columns: for each column its known rows and {rank: value}.

    ``wanted`` gives a column's ranks from its number of known rows.  One scan takes the ends of all
    columns, the next ones count rows per bin of equal width for all ranks at once.  The bin that
    holds a rank is divided again until it holds one value, or at most ``few`` rows, which are
    returned whole.  What reaches the driver is bounded by ranks, ``bins`` and ``few``.  NaN ranks
    above all numbers.
    """
    columns = list(wanted)
    number = {c: F.col(c).cast("double") for c in columns}
    finite = {c: F.abs(number[c]) < F.lit(float("inf")) for c in columns}  # NaN is above infinity
    ends = df.agg(
        *[
            made.alias(f"{name}{i}")
            for i, c in enumerate(columns)
            for name, made in (
                ("n", F.count(c)), ("odd", F.count_if(F.isnan(number[c]))),
                ("less", F.count_if(number[c] == F.lit(float("-inf")))), ("some", F.count_if(finite[c])),
                ("low", F.min(F.when(finite[c], number[c]))), ("high", F.max(F.when(finite[c], number[c]))),
            )
        ]
    ).first()
    found = {c: (ends[f"n{i}"], {}) for i, c in enumerate(columns)}
    open_: list[tuple[str, float, float, int, dict[int, int]]] = []  # column, ends, rows, {rank: rank inside}
    for i, c in enumerate(columns):
        less, some, inside = ends[f"less{i}"], ends[f"some{i}"], {}
        for rank in wanted[c](ends[f"n{i}"]):
            if rank < less:
                found[c][1][rank] = float("-inf")
            elif rank < less + some:
                inside[rank] = rank - less
            else:
                found[c][1][rank] = float("inf") if rank < ends[f"n{i}"] - ends[f"odd{i}"] else float("nan")
        if inside:
            open_.append((c, ends[f"low{i}"], ends[f"high{i}"], some, inside))
    few_left = []
    while open_:
        wide = []
        for part in open_:
            c, low, high, rows, inside = part
            if low == high:
                found[c][1].update(dict.fromkeys(inside, low))
            else:
                (few_left if rows <= few else wide).append(part)
        open_ = _divided(df, wide, number, bins) if wide else []
    if few_left:
        values: dict[int, list[float]] = {}
        for row in _unfolded(df, few_left, number, lambda *_: F.lit(0)).collect():
            values.setdefault(row.part, []).append(row.value)
        for i, (c, *_, inside) in enumerate(few_left):
            values[i].sort()
            found[c][1].update({rank: values[i][place] for rank, place in inside.items()})
    return found


def _unfolded(df, parts, number, place) -> DataFrame:
    """(part, place, value) of the rows between the ends of each part."""
    cells = [
        F.when(
            number[c].between(low, high),
            F.struct(F.lit(i).alias("part"), place(number[c], low, high).alias("place"), number[c].alias("value")),
        )
        for i, (c, low, high, *_) in enumerate(parts)
    ]
    return df.select(F.inline(F.filter(F.array(*cells), lambda cell: cell.isNotNull())))


def _divided(df, parts, number, bins):
    """The bins that hold the wanted ranks of each part, as parts of their own."""

    def place(value, low, high):
        unit = 1.0 if high - low < float("inf") else 4.0  # the width of the widest range is no number
        share = (value / unit - low / unit) / (high / unit - low / unit)
        return F.least(F.floor(share * bins), F.lit(bins - 1))

    counted = (
        _unfolded(df, parts, number, place).groupBy("part", "place")
        .agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
        .collect()  # at most ``bins`` rows per part
    )
    smaller = []
    for i, (c, *_, inside) in enumerate(parts):
        before = 0
        for row in sorted((r for r in counted if r.part == i), key=lambda r: r.place):
            own = {rank: at - before for rank, at in inside.items() if before <= at < before + row.n}
            if own:
                smaller.append((c, row.low, row.high, row.n, own))
            before += row.n
    return smaller


def quantiles_of(df: DataFrame, shares: Mapping[str, Sequence[float]], stored: bool = False) -> dict[str, list]:
    """Exact, linearly interpolated quantiles of several columns; None for a column without values.

    The columns are stored once, unless ``df`` is a ``stored`` table already.
    """

    def ranks(share, n):
        rank = float(share) * (n - 1)
        return math.floor(rank), math.ceil(rank), rank - math.floor(rank)

    kept = df if stored else settle(df.select(*shares))
    wanted = {c: (lambda n, own=own: {k for s in own for k in ranks(s, n)[:2]} if n else ()) for c, own in shares.items()}
    out = {}
    for c, (n, values) in order_statistics(kept, wanted).items():
        picks = [ranks(s, n) for s in shares[c]] if n else []
        out[c] = [
            values[low] if values[low] == values[high] else values[low] + (values[high] - values[low]) * part
            for low, high, part in picks
        ] or [None] * len(shares[c])
    return out


def quantiles(df: DataFrame, column: str, shares: Sequence[float], stored: bool = False) -> DataFrame:
    """Exact, linearly interpolated quantiles: one row with columns q0, q1, … as in ``shares``."""
    found = quantiles_of(df, {column: shares}, stored)[column]
    values = [F.lit(v).cast("double").alias(f"q{i}") for i, v in enumerate(found)]
    return df.sparkSession.range(1).select(*values)
