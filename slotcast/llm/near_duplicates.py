"""SimHash near-duplicates, searched with a Gray-order hierarchical index.

Fingerprints of 64 bits are cut into four blocks.  Two of them that differ in at most two bits
agree in two blocks or more, so each distinct fingerprint goes to six buckets (a pair of blocks
and their bits).  Inside a bucket fingerprints are sorted by Gray rank; runs of neighbours share a
node that holds the bits common to all, and runs of nodes share a node again.  A search goes down
level by level, adds up differences in the bits that a level fixes, and drops whole nodes beyond
the limit.  A fingerprint has at most 2,080 others within two bits, so links stay linear.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..session import settle, ship
from .common import BLANK, Texts, numbered, slices, word_bounds

SEED = 42
SHINGLE = 3
MAX_BITS = 2
BLOCKS = 4
FAN_OUT = 8
#: Buckets with more fingerprints are cut once more by the bits they do not share.
MAX_BUCKET = 20_000
SEARCHES = 1 << 16
#: Shingles whose bits are summed together.
VOTES = 1 << 16

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def simhash(texts: Texts) -> np.ndarray:
    """64-bit fingerprints; a bit is set if more than half of the shingle hashes have it."""
    starts, ends = word_bounds(BLANK[texts.data], texts.borders)
    borders = np.searchsorted(starts, texts.borders)
    counts = np.diff(borders)
    lower = _LOWER[texts.data].tobytes()
    words = [lower[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
    digest = xxhash.xxh64_intdigest
    votes = np.zeros((texts.n, 64), np.int64)
    n_shingles = np.zeros(texts.n, np.int64)
    for doc, (begin, n) in enumerate(zip(borders.tolist(), counts.tolist())):
        own = words[begin : begin + n]
        size = min(SHINGLE, n)
        n_shingles[doc] = n - size + 1 if n else 0
        for low in range(0, int(n_shingles[doc]), VOTES):  # 64 votes per shingle: a block at a time
            some = own[low : low + VOTES + size - 1]
            hashes = [digest(b" ".join(s), SEED) for s in zip(*[some[k:] for k in range(size)])]
            bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1)
            votes[doc] += bits.sum(axis=0, dtype=np.int64)
    packed = np.packbits(2 * votes > n_shingles[:, None], axis=1)
    out = np.ascontiguousarray(packed).view("<u8").ravel().astype(np.uint64)
    return out


def fingerprints(docs: DataFrame, text_col: str = "text", keys: dict[str, Column] | None = None):
    """The key columns of every row and its ``fp`` as a signed long."""
    ship(docs.sparkSession)
    narrow = docs.select(*[c.alias(k) for k, c in (keys or {}).items()], F.col(text_col).alias("_t"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema[:-1])

    def hash_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            parts = [simhash(Texts(column.slice(a, b - a))) for a, b in slices(column)]
            fp = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(fp.view(np.int64))],
                names=[*batch.schema.names[:-1], "fp"],
            )

    return narrow.mapInArrow(hash_, f"{schema}, fp long")


def gray_rank(values: np.ndarray) -> np.ndarray:
    """Place of each value in the Gray sequence."""
    out = values.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


class GrayIndex:
    """Hierarchy over fingerprints that are sorted by (bucket, Gray rank)."""

    def __init__(self, bucket: np.ndarray, prints: np.ndarray, fan_out: int = FAN_OUT):
        self.order = np.lexsort((gray_rank(prints), bucket))
        self.prints = prints[self.order]
        group = bucket[self.order]
        low = high = self.prints  # bits set in all members, bits set in any
        self.levels = []  # from the leaves' parents upwards: mask, pattern, first child, children
        while True:
            n = len(group)
            begins = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            place = np.arange(n) - np.repeat(begins, np.diff(np.append(begins, n)))
            first = np.flatnonzero(place % fan_out == 0)
            low = np.bitwise_and.reduceat(low, first)
            high = np.bitwise_or.reduceat(high, first)
            self.levels.append((~(low ^ high), low, first, np.diff(np.append(first, n))))
            group = group[first]
            if len(np.unique(group)) == len(group):
                break
        sizes = np.diff(np.append(np.flatnonzero(np.append(True, np.diff(bucket[self.order]) != 0)), len(bucket)))
        self.root = np.repeat(np.arange(len(group)), sizes)

    def pairs(self, limit: int, at_once: int = SEARCHES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places (first < second) of fingerprints in one bucket that differ in <= limit bits."""
        for begin in range(0, len(self.prints), at_once):
            who = np.arange(begin, min(begin + at_once, len(self.prints)))
            node, so_far = self.root[who], np.zeros(len(who), np.int64)
            fixed = np.zeros(len(who), np.uint64)
            for mask, pattern, first, count in reversed(self.levels):
                new = mask[node] & ~fixed
                so_far = so_far + np.bitwise_count((self.prints[who] ^ pattern[node]) & new)
                near = so_far <= limit
                who, node, so_far = who[near], node[near], so_far[near]
                fixed = mask[node]
                n = count[node]
                inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                node, who = np.repeat(first[node], n) + inner, np.repeat(who, n)
                so_far, fixed = np.repeat(so_far, n), np.repeat(fixed, n)
            later = node > who
            who, node, so_far, fixed = who[later], node[later], so_far[later], fixed[later]
            differ = so_far + np.bitwise_count((self.prints[who] ^ self.prints[node]) & ~fixed)
            near = differ <= limit
            yield self.order[who[near]], self.order[node[near]]


def _settle_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest place reachable from each place over the pairs."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    while (label[label] != label).any():
        label = label[label]
    return label


def _block(fp: Column, i: int, blocks: int, low: int, width: int) -> Column:
    """Bits of the i-th of ``blocks`` equal parts of ``width`` bits that begin at bit ``low``."""
    begin, end = low + width * i // blocks, low + width * (i + 1) // blocks
    return F.shiftrightunsigned(fp, begin).bitwiseAND((1 << (end - begin)) - 1)


def near_links(prints: DataFrame, max_bits: int = MAX_BITS, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """Links (a > b) between distinct fingerprints ``fp`` that join all near ones.

    Every near pair is found; per bucket only a star over its linked fingerprints is returned, which
    leaves the components unchanged.
    """
    if max_bits >= BLOCKS:
        raise ValueError(f"max_bits must be below {BLOCKS}")
    ship(prints.sparkSession)
    fp, width = F.col("fp"), 64 // BLOCKS
    block = [_block(fp, i, BLOCKS, 0, 64) for i in range(BLOCKS)]
    shared = BLOCKS - max_bits
    choices = list(combinations(range(BLOCKS), shared))
    keyed = prints.select(
        "fp",
        F.posexplode(
            F.array(*[F.xxhash64(F.lit(c), *[block[i] for i in chosen]) for c, chosen in enumerate(choices)])
        ).alias("_choice", "_bucket"),
    )
    # a bucket beyond max_bucket: its members still differ in max_bits of the other bits, so one
    # of max_bits + 1 parts of every other block row agrees
    crowded = (
        keyed.groupBy("_choice", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > max_bucket).select("_choice", "_bucket", F.lit(True).alias("_crowded"))
    )
    rest = F
    for c, chosen in enumerate(choices):
        others = [i for i in range(BLOCKS) if i not in chosen]
        value = sum(
            (F.shiftleft(block[i], width * k) for k, i in enumerate(others)), F.lit(0).cast("long")
        )
        rest = rest.when(F.col("_choice") == c, value)
    bits = width * (BLOCKS - shared)
    parts = F.array(
        *[F.xxhash64(F.col("_bucket"), F.lit(p), _block(F.col("_rest"), p, max_bits + 1, 0, bits))
          for p in range(max_bits + 1)]
    )
    placed = (
        keyed.join(crowded, ["_choice", "_bucket"], "left")
        .withColumn("_rest", rest)
        .select("fp", F.explode(F.when(F.col("_crowded"), parts).otherwise(F.array("_bucket"))).alias("bucket"))
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0

        def found(fps: np.ndarray, buckets: np.ndarray) -> Iterator[pa.RecordBatch]:
            new = np.append(True, buckets[1:] != buckets[:-1])
            sizes = np.diff(np.append(np.flatnonzero(new), len(buckets)))
            several = np.repeat(sizes > 1, sizes)
            fps, group = fps[several], (np.cumsum(new) - 1)[several]
            if not len(fps):
                return
            index = GrayIndex(group, fps.view(np.uint64))
            pairs = list(index.pairs(max_bits))
            a, b = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
            label = _settle_labels(len(fps), a, b)
            linked = np.flatnonzero(label != np.arange(len(fps)))
            one, two = fps[linked], fps[label[linked]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.maximum(one, two)), pa.array(np.minimum(one, two))], names=["a", "b"]
            )

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            rows += batch.num_rows
            if rows < SEARCHES:
                continue
            fps, buckets = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            last = int(np.searchsorted(buckets, buckets[-1]))  # rows come sorted by bucket
            yield from found(fps[:last], buckets[:last]) if last else ()
            held, rows = [(fps[last:], buckets[last:])], len(fps) - last
        if rows:
            yield from found(*(np.concatenate([h[k] for h in held]) for k in (0, 1)))

    return (
        placed.repartition("bucket").sortWithinPartitions("bucket")
        .mapInArrow(search, "a long, b long").distinct()
    )


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every linked node that is not the smallest of its component.

    Large stars and small stars take turns until the links stand still; each round is stored.
    """
    edges = settle(links.select("a", "b"))
    state = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("_m"))
        edges = (
            both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("_m").alias("b"))
            .distinct()
        )
        low = edges.groupBy("a").agg(F.min("b").alias("_m"))
        smaller = edges.join(low, "a")
        edges = settle(
            smaller.where("b > _m").select(F.col("b").alias("a"), F.col("_m").alias("b"))
            .unionByName(low.select("a", F.col("_m").alias("b"))).distinct()
        )
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = tuple(now)
    raise RuntimeError(f"components still change after {max_rounds} rounds")


def _least_of(own: DataFrame, key: str, links: DataFrame) -> DataFrame:
    """(key, _least): the smallest ``_own`` in the component of each key."""
    roots = components(links)
    rooted = own.join(roots.select(F.col("node").alias(key), "root"), key, "left").withColumn(
        "root", F.coalesce("root", key)
    )
    least = rooted.groupBy("root").agg(F.min("_own").alias("_least"))
    return rooted.join(least, "root").select(key, "_least")


def component_of_prints(prints: DataFrame, smallest: str, max_bits: int = MAX_BITS) -> DataFrame:
    """(fp, _least): the smallest value of column ``smallest`` in the component of each print."""
    own = settle(prints.groupBy("fp").agg(F.min(smallest).alias("_own")))
    return _least_of(own, "fp", near_links(own.select("fp"), max_bits))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS
) -> DataFrame:
    """Fingerprint and component of every row.

    Texts without words share the fingerprint zero.  The component is named by its smallest id;
    null ids do not name one, so a component of null ids has a null name.
    """
    prints = settle(fingerprints(docs, text_col, {id_col: F.col(id_col)}))
    named = component_of_prints(prints, id_col, max_bits)
    return prints.join(named, "fp").select(
        id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("_least").alias("component_id"),
    )


def keep_one_each(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS
) -> DataFrame:
    """One row of each component, with all columns: the smallest id, null ids last.

    Components are those of ``near_duplicates``.  Rows with the same id and text count as one row,
    so one of them stays; they are reduced before the shuffle.
    """
    one, two = F.xxhash64(id_col, text_col), F.hash(text_col, id_col)
    rank = F.struct(F.col(id_col).isNull().alias("n"), F.col(id_col).alias("i"), one.alias("x"), two.alias("y"))
    prints = settle(fingerprints(docs, text_col, {"_rank": rank}))
    keep = component_of_prints(prints, "_rank", max_bits).select(
        F.col("_least.x").alias("_one"), F.col("_least.y").alias("_two")
    ).distinct()
    plain = numbered(docs)
    ids, texts = (f"c{docs.columns.index(c)}" for c in (id_col, text_col))
    return (
        plain.withColumns({"_one": F.xxhash64(ids, texts), "_two": F.hash(texts, ids)})
        .dropDuplicates(["_one", "_two"])
        .join(keep, ["_one", "_two"], "left_semi")
        .select(*plain.columns)
        .toDF(*docs.columns)
    )
