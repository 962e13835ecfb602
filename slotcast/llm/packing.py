"""Best-fit packing into bins of several permitted lengths.

Items with equal lengths are alike, so the plan is made on the histogram of lengths, which has at
most as many entries as the longest bin has tokens.  Groups of bins with equal contents are filled
together: each step fills the bins of a group one after another with as many items of a length as
each holds, just as best fit does item by item.  The plan lists, for each length, which ranks go to
which bins; rows get their rank among rows of their length and look it up.

Lengths are placed in falling order into the fullest bins that still fit.  If none fits, a bin of
the least-cost size is opened.  Which size that is depends on all lengths, so a plan is made for
each opening rule, and the cheapest is taken after every bin was downsized to its contents.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import settle, ship

CAPACITIES = (512, 1024, 2048, 4096)
#: Cost of a bin besides its tokens.
BIN_COST = 16


@dataclass
class Plan:
    """Steps: items of ``length`` with ranks from ``rank`` go to bins from ``bin`` at ``offset``, ``per`` in each."""

    length: list[int] = field(default_factory=list)
    rank: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    offset: list[int] = field(default_factory=list)
    per: list[int] = field(default_factory=list)
    group_bin: list[int] = field(default_factory=list)  # first bin of each group of equal bins
    group_capacity: list[int] = field(default_factory=list)
    cost: int = 0


def _opened(length: int, capacities: tuple[int, ...], preferred: int | None) -> int:
    """Capacity of a new bin: the preferred one if it fits, else the one with the least waste."""
    fitting = [c for c in capacities if c >= length]
    if preferred in fitting:
        return preferred
    return min(fitting, key=lambda c: ((c + BIN_COST) / (c // length * length), c))


def _pack(histogram: dict[int, int], capacities: tuple[int, ...], preferred: int | None) -> Plan:
    plan = Plan()
    free: list[int] = []  # distinct amounts of free room, sorted
    groups: dict[int, list[tuple[int, int, int]]] = {}  # room -> (first bin, bins, tokens used)
    closed: list[tuple[int, int, int]] = []
    next_bin = 0

    def put_back(room: int, group: tuple[int, int, int]) -> None:
        if room == 0:
            closed.append(group)
        elif room in groups:
            groups[room].append(group)
        else:
            groups[room] = [group]
            insort(free, room)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(free, length)
            if at < len(free):
                room = free[at]
                first, bins, used = groups[room].pop()
                if not groups[room]:
                    del groups[room]
                    free.pop(at)
            else:
                room, used, first = _opened(length, capacities, preferred), 0, next_bin
                bins = max(1, -(-left // (room // length)))  # as many as these items fill
                next_bin += bins
            per = room // length
            taken = min(bins * per, left)
            full, some = divmod(taken, per)
            plan.length.append(length)
            plan.rank.append(rank)
            plan.bin.append(first)
            plan.offset.append(used)
            plan.per.append(per)
            rank, left = rank + taken, left - taken
            filled = 0
            for n, held in ((full, per), (min(some, 1), some), (bins - full - min(some, 1), 0)):
                if n:
                    put_back(room - held * length, (first + filled, n, used + held * length))
                    filled += n
    for group in [*closed, *(g for room in groups.values() for g in room)]:
        first, bins, used = group
        capacity = next(c for c in capacities if c >= used) if used else 0
        plan.group_bin.append(first)
        plan.group_capacity.append(capacity)
        plan.cost += bins * (capacity + BIN_COST if used else 0)
    return plan


def make_plan(histogram: dict[int, int], capacities: tuple[int, ...] = CAPACITIES) -> Plan:
    """The cheapest plan over all opening rules."""
    capacities = tuple(sorted(set(capacities)))
    plans = [_pack(histogram, capacities, p) for p in (None, *capacities)]
    return min(plans, key=lambda p: p.cost)


def word_count(text: Column) -> Column:
    """Words separated by blanks, and one for the end of the text."""
    words = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    return (words + 1).cast("long")


def pack(
    docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, id_col: str = "doc_id",
    text_col: str = "text", length: Column | None = None, rows_per_chunk: int = 4096,
) -> DataFrame:
    """Bin, place in it and final capacity of every piece of every row.

    ``length`` defaults to words + 1, so empty and null texts take one place.  Texts longer than
    the largest capacity are cut into pieces of that size.  The rows of a frequent length are spread
    over chunks by a hash, and ranks are counted chunk by chunk.
    """
    ship(docs.sparkSession)
    largest = max(capacities)
    size = word_count(F.col(text_col)) if length is None else length.cast("long")
    narrow = docs.select(F.col(id_col).alias("_id"), F.xxhash64(id_col, text_col).alias("_key"), size.alias("_size"))
    pieces = settle(
        narrow.withColumn(
            "piece", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(greatest(_size, 1) - 1) div {largest}")))
        ).select(
            "_id", "_key", "piece",
            F.least(F.greatest("_size", F.lit(1)) - F.col("piece") * largest, F.lit(largest)).alias("n_tokens"),
        )
    )
    # one row per length: at most as many as the largest capacity
    histogram = settle(pieces.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("_rows")))
    plan = make_plan({r.n_tokens: r["_rows"] for r in histogram.collect()}, capacities)
    chunks = F.ceil(F.col("_rows") / rows_per_chunk)
    chunked = pieces.join(F.broadcast(histogram), "n_tokens").withColumn(
        "_chunk", F.pmod(F.xxhash64("_key", "piece"), chunks)
    )
    counts = chunked.groupBy("n_tokens", "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("n_tokens").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("n_tokens", "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy("n_tokens", "_chunk").orderBy("_key", "piece", "_id")
    ranked = chunked.withColumn("_row", F.row_number().over(own) - 1).join(offsets, ["n_tokens", "_chunk"])
    id_type = docs.schema[id_col].dataType.simpleString()
    order = np.lexsort((plan.rank, plan.length))
    by_bin = np.argsort(plan.group_bin)
    shared = docs.sparkSession.sparkContext.broadcast(  # bounded by the number of lengths
        [np.array(x, np.int64)[o] for x, o in (
            (plan.length, order), (plan.rank, order), (plan.bin, order), (plan.offset, order), (plan.per, order),
            (plan.group_bin, by_bin), (plan.group_capacity, by_bin),
        )]
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, ranks, bins, offsets_, per, group_bin, group_capacity = shared.value
        # (length, rank) pairs as one sorted number: ranks stay below 2^50 for 2^12 tokens
        bits = np.int64(50)
        keys = (lengths << bits) + ranks
        for batch in batches:
            rank = batch.column(3).to_numpy()
            step = np.searchsorted(keys, (batch.column(2).to_numpy() << bits) + rank, "right") - 1
            more, place_ = np.divmod(rank - ranks[step], per[step])
            bin_ = bins[step] + more
            group = np.searchsorted(group_bin, bin_, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(bin_),
                 pa.array(offsets_[step] + place_ * lengths[step]), pa.array(group_capacity[group])],
                names=[id_col, "piece", "n_tokens", "bin", "start", "capacity"],
            )

    return ranked.select("_id", "piece", "n_tokens", (F.col("_before") + F.col("_row")).cast("long")).mapInArrow(
        place, f"`{id_col}` {id_type}, piece long, n_tokens long, bin long, start long, capacity long"
    )
