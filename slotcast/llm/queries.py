"""One registered query per operator over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (
    bpe, contamination, hard_negatives, link_trust, near_duplicates, packing, passages, repetition,
    resampling, secrets, sharding, surrogates, toxicity,
)
from .common import query, table


@query("op1_subword_toxicity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


@query("op2_suffix_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.kept_digest(passages.remove_repeats(table(spark, sf_dir, "documents")))


@query("op3_surrogates")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogates.replace_entities(docs, counts=True)


@query("op4_link_trust")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_trust.judge_urls(table(spark, sf_dir, "pages"))


@query("op5_histogram_sort")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.histogram_shards(table(spark, sf_dir, "documents"))


@query("op6_repetition_rules")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.judge_repetition(table(spark, sf_dir, "documents"))


@query("op7_suffix_automaton")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination.find_contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        contamination.items_digest("items").alias("items_sha256"), "contaminated",
    )


@query("op8_markov_secrets")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    counts = [secrets.count_kind(F.col("base"), i).alias(f"n_{k}") for i, k in enumerate(secrets.KINDS[:3])]
    return found.select(
        "doc_id", *counts, F.sha2(secrets.joined(F.col("base")), 256).alias("base_sha256"),
        secrets.joined(F.concat("base", "added")).alias("spans"),
    )


@query("op9_simhash_gray")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))


@query("op10_best_fit_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op11_byte_bpe")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coder = bpe.Coder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    decoded = coder.decode(coder.encode(docs))
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


#: Lower-cased words, their bucket (crc32 of the bytes, bit by bit over the distinct words), gains,
#: scores and the first ranks, as one statement.
OP12_SQL = """
WITH RECURSIVE
words AS (SELECT 'd' AS side, rowid AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
          FROM (SELECT row_number() OVER () AS rowid, text FROM documents)
          UNION ALL SELECT 'b', 0, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
each AS (SELECT side, r, unnest(w) AS w FROM words),
crc AS (SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, octet_length(encode(w))),
            lambda i: ('0x' || substr(hex(encode(w)), (2 * i + 1)::INT, 2))::BIGINT)),
          lambda acc, byte: list_reduce(list_prepend(xor(acc, byte), range(0, 8)),
            lambda c, _: xor(c >> 1, 3988292384 * (c & 1)))), 4294967295) % 10000 AS bucket
        FROM (SELECT DISTINCT w FROM each)),
hashed AS (SELECT side, r, bucket FROM each JOIN crc USING (w)),
counts AS (SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM hashed GROUP BY 1),
gains AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM counts) + 10000)::DOUBLE
            / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM counts) + 10000)::DOUBLE)))::BIGINT AS gain FROM counts),
weights AS (SELECT r, count(*) AS n, floor(sum(gain) / count(*))::BIGINT AS weight
            FROM hashed JOIN gains USING (bucket) WHERE side = 'd' GROUP BY 1),
scored AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
             coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE)
               / 4294967296::DOUBLE)))::BIGINT AS score
           FROM (SELECT row_number() OVER () AS r, doc_id FROM documents) LEFT JOIN weights USING (r)),
drawn AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place FROM scored)
SELECT doc_id, n_features, weight, score,
  CASE WHEN n_features >= 20 AND place <= (SELECT count(*) FROM scored WHERE n_features >= 20) * 10 // 100 THEN place END AS rank
FROM drawn
"""


@query("op12_importance_resampling", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")


OP13_SQL = """
WITH usable AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM usable a JOIN usable b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id,
  row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""


@query("op13_hard_negatives", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", moved)
    return hard_negatives.mine_hard_negatives(vectors, F.col("vec_id") % 100 == 0)
