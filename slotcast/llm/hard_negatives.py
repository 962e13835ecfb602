"""Hard-negative mining by exact integer products, several candidates at once.

Vectors become integers first.  A chunk of candidates is packed one component at a time: the biased
components of all its rows lie in separated fields of one wide integer (Kronecker substitution).
An anchor then multiplies each of these integers once by its own biased component and adds them
up; every field of the sum holds one candidate's product, and no field can run into the next, since
its width follows from the largest components.  Subtracting what the biases added gives exact scores.

Anchors are taken in blocks of bounded size, and each block is held against all rows, whose
partitions work independently: one pass finds the positives, one the negatives, which depend on
them.  A task returns no more than its own best rows of each anchor, and these are ranked again.

Rows with a null id, a null label, or a vector that is null or holds a null, a NaN or an infinity
take no part.  Rows with one id count as one row, the smallest by label and vector.  Shorter vectors
are filled up with zeros.  Components beyond 64 bits are cut by the conversion, as are scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.ordered import POSITION, in_order, with_position
from ..session import new_path, ship

#: Candidates packed into one set of wide integers.
CHUNK = 2048
#: Components of the anchors of one block (8 bytes each).
BLOCK_VALUES = 1 << 20
_LIMIT = (1 << 63) - 1
OUT = (
    "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, "
    "negative_score long"
)


def as_integers(
    rows: DataFrame, is_anchor: Column, scale: int, id_col: str, vector_col: str, label_col: str
) -> DataFrame:
    """(id, label, v, anchor): usable rows with components floor(scale * x), one row per id."""
    x = F.col(vector_col).cast("array<double>")
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return (
        rows.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & x.isNotNull() & ~odd)
        .select(
            F.col(id_col).cast("long").alias("id"),
            F.struct(
                F.col(label_col).alias("label"), F.transform(x, lambda c: F.floor(c * scale)).alias("v"),
                F.coalesce(is_anchor, F.lit(False)).alias("anchor"),
            ).alias("r"),
        )
        .groupBy("id").agg(F.min("r").alias("r")).select("id", "r.*")
    )


class Packed:
    """Candidates as one wide integer per component."""

    def __init__(self, vectors: np.ndarray, bias: int):
        self.n, self.dims = vectors.shape
        self.bias = bias
        top = self.dims * 4 * bias * bias  # every field stays below
        self.width = next((w for w in (4, 8) if top >> (8 * w) == 0), -(-top.bit_length() // 8))
        if self.width <= 8:
            fields = np.ascontiguousarray((vectors + bias).T).astype(f"<u{self.width}")
            columns = [row.tobytes() for row in fields]
            self.sums = vectors.sum(axis=1)
        else:
            columns = [
                b"".join((int(c) + bias).to_bytes(self.width, "little") for c in column) for column in vectors.T
            ]
            self.sums = vectors.sum(axis=1, dtype=object)
        self.wide = [int.from_bytes(c, "little") for c in columns]

    def scores(self, anchor: list[int]) -> np.ndarray:
        """Inner products of one anchor with all candidates."""
        bias, width = self.bias, self.width
        total = sum(map(mul, self.wide, [c + bias for c in anchor]))
        raw = total.to_bytes(self.n * width, "little")
        added = bias * sum(anchor) + self.dims * bias * bias
        if width <= 8:
            # a score is far below 2^63, so the biases cancel out also where a product passes it
            products = np.frombuffer(raw, f"<u{width}").astype(np.uint64).view(np.int64)
            return products - (bias * self.sums + added)
        fields = (int.from_bytes(raw[i : i + width], "little") for i in range(0, len(raw), width))
        exact = [f - bias * s - added for f, s in zip(fields, self.sums)]
        return np.array([max(-_LIMIT, min(_LIMIT, e)) for e in exact], np.int64)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column, filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(column.value_lengths().to_numpy(False), np.int64)
    out = np.zeros((len(column), dims), np.int64)
    out[np.arange(dims) < sizes[:, None]] = column.flatten().to_numpy(False)
    return out


def best_first(group: np.ndarray, score: np.ndarray, name: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` highest scores of each group, ties by the smaller name."""
    order = np.lexsort((name, -score, group))
    kept = group[order]
    first = np.append(True, kept[1:] != kept[:-1])
    begins = np.flatnonzero(first)
    inner = np.arange(len(order)) - begins[np.cumsum(first) - 1]
    return order[inner < most]


def _search(rows: DataFrame, dims: int, bias: int, most: int, find) -> DataFrame:
    """Best hits of every task.  ``find`` yields (group, score, id) of a chunk sorted by id."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            for begin in range(0, batch.num_rows, CHUNK):
                part = batch.slice(begin, CHUNK)
                ids, labels = part.column(0).to_numpy(), part.column(1).to_numpy()
                order = np.argsort(ids)
                vectors = _matrix(part.column(2), dims)[order]
                hits = [best, *find(ids[order], labels[order], vectors, bias)]
                joined = [np.concatenate([h[k] for h in hits]) for k in range(3)]
                keep = best_first(*joined, most)
                best = [c[keep] for c in joined]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in best], names=["g", "score", "id"])

    return rows.select("id", "label", "v").mapInArrow(look, "g long, score long, id long")


def _positives(anchors, most: int):
    ids, labels, vectors = anchors

    def find(own_ids, own_labels, own_vectors, bias):
        for label in np.intersect1d(own_labels, labels):
            same = np.flatnonzero(own_labels == label)
            packed = Packed(own_vectors[same], bias)
            for a in np.flatnonzero(labels == label):
                score = packed.scores(vectors[a])
                other = np.flatnonzero(own_ids[same] != ids[a])
                top = other[np.argsort(-score[other], kind="stable")[:most]]
                yield np.full(len(top), a), score[top], own_ids[same][top]

    return find


def _negatives(anchors, ranges, most: int):
    """``ranges``: for each anchor a list of (group, lowest, highest score)."""
    _, labels, vectors = anchors

    def find(own_ids, own_labels, own_vectors, bias):
        packed = Packed(own_vectors, bias)
        for a, wanted in ranges.items():
            score = packed.scores(vectors[a])
            low, high = min(w[1] for w in wanted), max(w[2] for w in wanted)
            near = np.flatnonzero((own_labels != labels[a]) & (score >= low) & (score <= high))
            near = near[np.argsort(-score[near], kind="stable")]
            falling = -score[near]
            for group, least, highest in wanted:
                begin = int(np.searchsorted(falling, -highest))
                top = near[begin : min(begin + most, int(np.searchsorted(falling, -least, "right")))]
                yield np.full(len(top), group), score[top], own_ids[top]

    return find


def _ranked(hits: DataFrame, most: int) -> DataFrame:
    order = Window.partitionBy("g").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def mine_hard_negatives(
    rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10,
    least: tuple[int, int] = (30, 100), most: tuple[int, int] = (90, 100), scale: int = 256,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """For each anchor and each of its best positives the best rows of other labels in a score range.

    A negative's score is at least ``least`` and at most ``most`` (fractions) of the positive's.
    """
    spark = rows.sparkSession
    ship(spark)
    path = new_path(spark, "vectors")
    as_integers(rows, is_anchor, scale, id_col, vector_col, label_col).write.parquet(path)
    stored = spark.read.parquet(path)
    farthest = F.greatest(F.array_max("v"), -1 - F.array_min("v"))
    size = stored.agg(F.max(F.size("v")).alias("dims"), F.max(farthest).alias("high")).first()
    dims, bias = max(size["dims"] or 1, 1), (size["high"] or 0) + 1
    per_block = max(1, BLOCK_VALUES // dims)
    placed = with_position(in_order(stored.where("anchor"), "id")).select(
        "id", "label", "v", F.floor(F.col(POSITION) / per_block).alias("block")
    )
    found = new_path(spark, "negatives")
    spark.createDataFrame([], OUT).write.parquet(f"{found}/block=-1")
    last = placed.agg(F.max("block")).first()[0]
    for block in range(0 if last is None else last + 1):
        own = placed.where(F.col("block") == block).toArrow()  # at most per_block rows
        anchors = (
            own["id"].to_numpy(), own["label"].to_numpy(),
            [[int(c) for c in v] for v in _matrix(own["v"], dims)],
        )
        shared = spark.sparkContext.broadcast(anchors)
        hits = _search(
            stored, dims, bias, positives,
            lambda *chunk: _positives(shared.value, positives)(*chunk),
        )
        pairs = _ranked(hits, positives).orderBy("g", "rank").toArrow()  # at most per_block * positives rows
        of, score, name = (pairs[c].to_pylist() for c in ("g", "score", "id"))
        ranges: dict[int, list[tuple[int, int, int]]] = {}
        for group, (a, s) in enumerate(zip(of, score)):
            low, high = -(-least[0] * s // least[1]), most[0] * s // most[1]
            if low <= high:
                ranges.setdefault(a, []).append((group, low, high))
        limits = spark.sparkContext.broadcast(ranges)
        hits = _search(
            stored, dims, bias, negatives,
            lambda *chunk: _negatives(shared.value, limits.value, negatives)(*chunk),
        )
        names = spark.createDataFrame(
            pa.table({"g": range(len(of)), "anchor_id": anchors[0][of], "positive_id": name, "positive_score": score}),
            "g long, anchor_id long, positive_id long, positive_score long",
        )
        _ranked(hits, negatives).join(F.broadcast(names), "g").select(
            "anchor_id", "positive_id", F.col("rank"), F.col("id").alias("negative_id"),
            "positive_score", F.col("score").alias("negative_score"),
        ).write.parquet(f"{found}/block={block}")
    return spark.read.parquet(found).drop("block")
