"""Importance resampling: draw the documents that look most like a target set.

Every text is a bag of hashed n-grams.  How much more frequent a bucket is in the target than in the
documents gives its gain, and a document's weight is the mean gain of its features, looked up in one
array of all gains.  Noise from a hash of the id makes the highest scores a weighted draw without
replacement.

The cut is found by a distributed quickselect over the stored scores: some random keys of the open
range are pivots, one pass counts the rows below and at each of them, and the range shrinks to the
part that holds the k-th key until a pivot is that key.  Keys end in the number that a row got when it
was stored, so no two are equal and ties, however many, are narrowed down like other keys.  Only the
drawn rows are sorted for their ranks, in range partitions.

Null texts have no words.  A null id hashes like an empty one and comes last among equal scores.
Repeated rows are drawn each for itself, with the same score.
"""

from __future__ import annotations

import math
import string
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, functions as F

from ..operators.ordered import POSITION, in_order, with_position
from ..session import new_path

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Resampling:
    """Longest run of words, buckets, seed of the noise, words a drawn text must have, share drawn."""

    n_gram: int = 1
    buckets: int = 10_000
    seed: int = 2024
    min_words: int = 20
    percent: int = 10


def words(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_extract_all(lower, F.lit(WORDS), F.lit(0))


def features(words: Column, n_gram: int) -> Column:
    """All runs of 1 to ``n_gram`` consecutive words, joined by spaces."""
    def runs(n: int) -> Column:
        places = F.sequence(F.lit(1), F.size(words) - (n - 1))
        joined = F.transform(places, lambda i: F.array_join(F.slice(words, i, n), " "))
        return F.when(F.size(words) >= n, joined).otherwise(F.array().cast("array<string>"))

    return words if n_gram == 1 else F.flatten(F.array(words, *[runs(n) for n in range(2, n_gram + 1)]))


def bucket(feature: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(feature.cast("binary")), F.lit(buckets).cast("long")).cast("int")


def bucket_counts(texts: DataFrame, text_col: str, plan: Resampling, name: str) -> DataFrame:
    """Features per bucket: at most ``buckets`` rows leave each task."""
    each = texts.select(F.explode(features(words(F.col(text_col)), plan.n_gram)).alias("f"))
    return each.groupBy(bucket(F.col("f"), plan.buckets).alias("bucket")).agg(F.count(F.lit(1)).alias(name))


def gains(docs: DataFrame, target: DataFrame, text_col: str, plan: Resampling) -> list[int]:
    """Gain of every bucket (``buckets`` numbers on the driver)."""
    source, wanted = (
        {r.bucket: r.n for r in bucket_counts(df, text_col, plan, "n").collect()} for df in (docs, target)
    )
    all_source, all_wanted = (float(sum(c.values()) + plan.buckets) for c in (source, wanted))
    return [
        math.floor(1000 * math.log((wanted.get(i, 0) + 1) * all_source / ((source.get(i, 0) + 1) * all_wanted)))
        for i in range(plan.buckets)
    ]


def noise(id_: Column, seed: int) -> Column:
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def scored(
    docs: DataFrame, gain: Sequence[int], plan: Resampling, id_col: str, text_col: str
) -> DataFrame:
    """Features, weight and score of every row."""
    known = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")  # folded to a literal
    found = docs.select(id_col, words(F.col(text_col)).alias("_words")).select(
        id_col, F.size("_words").cast("long").alias("n_words"), features(F.col("_words"), plan.n_gram).alias("_f")
    )
    total = F.aggregate("_f", F.lit(0).cast("long"), lambda a, f: a + F.get(known, bucket(f, plan.buckets)))
    n = F.col("n_features")
    summed = found.select(id_col, "n_words", F.size("_f").cast("long").alias("n_features"), total.alias("_sum"))
    mean = F.when(n > 0, F.expr("(_sum - pmod(_sum, n_features)) div n_features")).otherwise(0)
    return summed.select(id_col, "n_words", "n_features", mean.cast("long").alias("weight")).withColumn(
        "score", F.col("weight") + noise(F.col(id_col), plan.seed)
    )


def kth_key(rows: DataFrame, key: Column, k: int, pivots: int = 12) -> Row:
    """The k-th smallest of the distinct struct keys, counting from 1, of a stored table.

    Every round reads the table twice, for the pivots and for the counts, and keeps a few numbers.
    """
    kind = rows.select(key.alias("key")).schema["key"].dataType
    literal = lambda row: F.struct(
        *[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, kind)]
    )
    keyed = rows.select(key.alias("key"))
    low = high = None
    round_ = 0
    while True:
        open_ = keyed
        if low is not None:
            open_ = open_.where(F.col("key") > literal(low))
        if high is not None:
            open_ = open_.where(F.col("key") < literal(high))
        draws = [F.min_by("key", F.xxhash64("key", F.lit(round_ * pivots + i))).alias(f"p{i}") for i in range(pivots)]
        picked = list({tuple(p): p for p in open_.agg(*draws).first() if p is not None}.values())
        if not picked:
            raise ValueError("k is beyond the rows")
        counts = open_.agg(
            *[F.count_if(F.col("key") < literal(p)).alias(f"b{i}") for i, p in enumerate(picked)],
            *[F.count_if(F.col("key") == literal(p)).alias(f"e{i}") for i, p in enumerate(picked)],
        ).first()
        below, at = counts[: len(picked)], counts[len(picked) :]
        passed = 0
        for i in sorted(range(len(picked)), key=lambda i: below[i]):
            if k <= below[i]:
                high = picked[i]
                break
            if k <= below[i] + at[i]:
                return picked[i]
            low, passed = picked[i], below[i] + at[i]
        k -= passed
        round_ += 1


def resample(
    docs: DataFrame, target: DataFrame, plan: Resampling = Resampling(), id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Every row's id, n_words, n_features, weight and score, and the rank of those drawn (else null).

    Texts of ``min_words`` words or more take part; ``percent`` of them, rounded down, are drawn.
    """
    spark = docs.sparkSession
    path = new_path(spark, "scores")
    docs, target = docs.select(id_col, text_col), target.select(text_col)
    gain = gains(docs, target, text_col, plan)
    own = scored(docs, gain, plan, id_col, text_col).withColumnRenamed(id_col, "id")
    own.withColumn("row", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    takes_part = F.col("n_words") >= plan.min_words
    k = plan.percent * rows.where(takes_part).count() // 100
    key = F.struct(
        (-F.col("score")).alias("s"), F.col("id").isNull().alias("no_id"), "id", "n_features", "row"
    )
    out = ["id", "n_words", "n_features", "weight", "score"]
    if not k:
        return rows.select(*out, F.lit(None).cast("long").alias("rank")).withColumnRenamed("id", id_col)
    last = kth_key(rows.where(takes_part), key, k)
    kind = rows.select(key.alias("k")).schema["k"].dataType
    cut = F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(last, kind)])
    drawn = takes_part & (key <= cut)
    ranked = with_position(in_order(rows.where(drawn), *[key[f.name] for f in kind]))
    return (
        ranked.select(*out, (F.col(POSITION) + 1).alias("rank"))
        .unionByName(rows.where(~drawn).select(*out, F.lit(None).cast("long").alias("rank")))
        .withColumnRenamed("id", id_col)
    )
