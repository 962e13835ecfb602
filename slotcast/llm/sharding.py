"""Histogram sort into shards of nearly equal bytes.

Rows are ordered by a 126-bit key: a hash of the text, then a hash of the id.  Equal texts are
neighbours, and a text held by very many rows can still be cut between its rows.  Splitters are
found by counting: each round sums, over all partitions, the exact bytes between equally spaced
probes, then looks closer where a target lies.  Rows move only once, after the last round.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import settle

ROW_BYTES = 16
KEY_END = 1 << 63


@dataclass
class _Range:
    """Where a splitter still may lie: low <= key < high, ``before`` bytes sort below low."""

    low: int
    high: int
    before: int
    text: int | None = None  # set if the ids of one text are looked at

    def holds(self) -> Column:
        key = "_id_key" if self.text is not None else "_text_key"
        inside = (F.col(key) >= self.low) & (F.col(key) <= self.high - 1)
        return inside if self.text is None else inside & (F.col("_text_key") == self.text)

    def step(self, probes: int) -> int:
        return max(1, -(-(self.high - self.low) // probes))

    def bin(self, probes: int) -> Column:
        key = "_id_key" if self.text is not None else "_text_key"
        return F.expr(f"({key} - {self.low}L) div {self.step(probes)}L")


def shard_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, size, checksum and sort key of each row; the texts themselves are read only here."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col),
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(text), 1).alias("_text_key"),
        F.shiftrightunsigned(F.xxhash64(F.col(id_col)), 1).alias("_id_key"),
    )


def _histogram(keys: DataFrame, ranges: list[_Range], probes: int) -> dict[int, list[tuple]]:
    """Per range: (bin, bytes, smallest key, largest key); at most ranges * probes rows."""
    which = bin_ = key = F
    for i, r in enumerate(ranges):
        held = r.holds()
        which = which.when(held, i)
        bin_ = bin_.when(held, r.bin(probes))
        key = key.when(held, F.col("_id_key" if r.text is not None else "_text_key"))
    rows = (
        keys.select(which.alias("r"), bin_.alias("b"), key.alias("k"), "size")
        .where("r IS NOT NULL")
        .groupBy("r", "b")
        .agg(F.sum("size").alias("s"), F.min("k").alias("low"), F.max("k").alias("high"))
        .collect()
    )
    out: dict[int, list[tuple]] = {i: [] for i in range(len(ranges))}
    for row in rows:
        out[row.r].append((row.b, row.s, row.low, row.high))
    return {i: sorted(x) for i, x in out.items()}


def find_splitters(
    keys: DataFrame, shards: int, tolerance: float = 0.005, probes: int = 1024
) -> list[tuple[int, int]]:
    """Keys (text part, id part) at which shards 1, 2, ... begin.

    A splitter is accepted when the bytes below it are within ``tolerance`` of a shard's size of
    the target, or when the key can't be divided further.  The driver sees only the histogram.
    """
    total = keys.agg(F.sum("size")).first()[0] or 0
    slack = total / shards * tolerance
    open_ = {k: _Range(0, KEY_END, 0) for k in range(1, shards)} if total else {}
    found: dict[int, tuple[int, int]] = {k: (KEY_END - 1, KEY_END - 1) for k in range(1, shards)}
    while open_:
        ranges = list({(r.low, r.high, r.text): r for r in open_.values()}.values())
        place = {(r.low, r.high, r.text): i for i, r in enumerate(ranges)}
        bins = _histogram(keys, ranges, probes)
        still: dict[int, _Range] = {}
        for k, r in open_.items():
            target, below = total * k / shards, r.before
            for _, size, low, high in bins[place[r.low, r.high, r.text]]:
                if below + size >= target:
                    break
                below += size
            short, over = target - below, below + size - target
            at = lambda key: (key, 0) if r.text is None else (r.text, key)
            single = low == high
            if min(short, over) <= slack or (single and r.text is not None):
                found[k] = at(low) if short <= over else at(high + 1)
            elif single:
                still[k] = _Range(0, KEY_END, below, text=low)
            else:
                still[k] = _Range(low, high + 1, below, r.text)
        open_ = still
    return [found[k] for k in range(1, shards)]


def shard_of(splitters: list[tuple[int, int]]) -> Column:
    """Number of splitters at or below the row's key."""
    out = F.lit(0)
    for text, id_ in splitters:
        after = (F.col("_text_key") > text) | (
            (F.col("_text_key") == text) & (F.col("_id_key") >= id_)
        )
        out = out + after.cast("int")
    return out


def histogram_shards(
    docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text",
    tolerance: float = 0.005, rows_per_chunk: int = 4096,
) -> DataFrame:
    """Shard and gapless slot of every row, shards nearly equal in bytes (law ``bytes``).

    A null text has size 16 and the checksum of no bytes.  Rows with the same id and text have one
    key and share a shard; so does a row larger than a shard with itself.  Slots follow chunks of
    the id's hash, so that no window holds a whole shard.
    """
    keys = settle(shard_keys(docs, id_col, text_col))
    splitters = find_splitters(keys, shards, tolerance)
    chunks = max(1, -(-keys.count() // (shards * rows_per_chunk)))
    placed = keys.withColumn("shard", shard_of(splitters)).withColumn(
        "_chunk", F.pmod(F.shiftright("_id_key", 8), F.lit(chunks))
    )
    before = Window.partitionBy("shard").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("shard", "_chunk")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("shard", "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    own = Window.partitionBy("shard", "_chunk").orderBy("_text_key", "_id_key", id_col)
    return (
        placed.withColumn("_row", F.row_number().over(own) - 1)
        .join(offsets, ["shard", "_chunk"])
        .select(
            id_col, "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("_before") + F.col("_row")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
