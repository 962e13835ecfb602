"""Byte-level BPE: texts to token ids and back.

A text is cut by the vocabulary's pattern.  A word that is a token gets its rank; any other starts as
single bytes, and the adjacent pair of lowest rank, the leftmost first, is merged until no pair is a
token.

``Coder.word_ids`` does this for distinct words with Spark's higher-order functions: a word is a string
with one character per piece (its Latin-1 reading at first), a fold looks up all adjacent pairs in a
literal map of ranks, split over hash buckets, and overlays the best pair with the character of the
merged token.  Merged tokens' characters are in the order of their ranks, so the least one wins.

The ids of the ``frequent`` most common distinct words are found that way and broadcast, bounded in number
and length.  They are chosen by counting a sample of rows, which decides the cost and not the result:
documents take the ids of their words from this table, and words outside it are merged in the task, in
a plain loop, or, beyond ``long_bytes``, rank by rank over arrays, where a loop would take quadratic time.

Null and empty texts have no tokens.  Rows stand for themselves, so repeated rows come back as
often; other columns pass unchanged whatever their names.  A text is held whole, with its words and ids,
by the task that encodes it, which takes some hundred bytes per byte of a word without a break and some
tens otherwise.
"""

from __future__ import annotations

import base64
import heapq
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..session import settle, ship
from .common import map_rows, slices

RANK_BUCKETS = 1 << 13
#: Words outside the table that a task remembers before it forgets all of them.
REMEMBERED = 1 << 17
_NONE = 2**31 - 1


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a file with one base64 token and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a short word by merging its pieces one pair after another."""
    rank = ranks.get
    cuts = list(range(len(word) + 1))
    pairs = [rank(word[i : i + 2], _NONE) for i in range(len(word) - 1)]
    while pairs and (low := min(pairs)) != _NONE:
        at = pairs.index(low)
        del cuts[at + 1], pairs[at]
        if at < len(pairs):
            pairs[at] = rank(word[cuts[at] : cuts[at + 2]], _NONE)
        if at:
            pairs[at - 1] = rank(word[cuts[at - 1] : cuts[at + 1]], _NONE)
    return [ranks[word[a:b]] for a, b in zip(cuts, cuts[1:])]


class Merges:
    """Merges of long words over arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = [
            (ranks[a] << 32 | ranks[b], rank) for token, rank in ranks.items() for a, b in _split_token(token, ranks)
        ]
        keys, merged = (np.array(c, np.int64) for c in zip(*pairs))
        order = np.argsort(keys)
        self.keys, self.merged = keys[order], merged[order]
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], _NONE)

    def encode(self, word: bytes) -> np.ndarray:
        """Ids of a word that is no token itself.

        Positions wait under the rank of their pair.  Those of the lowest rank merge together from
        left to right, up to the first merge that makes a pair of a lower rank, which goes first.
        """
        ids = self.bytes[np.frombuffer(word, np.uint8)]
        n = len(ids)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        rank = np.full(n, _NONE, np.int64)
        rank[: n - 1] = self.rank(ids[:-1], ids[1:])
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def wait(places: np.ndarray) -> None:
            places = places[rank[places] != _NONE]
            if not len(places):
                return
            places = places[np.argsort(rank[places], kind="stable")]
            cuts = np.flatnonzero(np.diff(rank[places])) + 1
            for some in np.split(places, cuts):
                r = int(rank[some[0]])
                if r not in waiting:
                    heapq.heappush(heap, r)
                waiting.setdefault(r, []).append(some)

        wait(np.arange(n))
        while heap:
            low = heapq.heappop(heap)
            at = np.unique(np.concatenate(waiting.pop(low)))
            at = at[rank[at] == low]
            if not len(at):
                continue
            chained = np.append(False, after[at[:-1]] == at[1:])  # shares a piece with the one before
            runs = np.arange(len(at)) - np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
            at = at[runs % 2 == 0]
            right = after[at]
            left, follow = before[at], after[right]
            left_id = np.where(left >= 0, ids[left], -1)
            left_id[1:][left[1:] == right[:-1]] = low  # merged just now
            follow_id = np.where(follow < n, ids[np.minimum(follow, n - 1)], -1)
            own = np.full(len(at), low, np.int64)
            lower = (np.where(left_id >= 0, self.rank(np.maximum(left_id, 0), own), _NONE) < low) | (
                np.where(follow_id >= 0, self.rank(own, np.maximum(follow_id, 0)), _NONE) < low
            )
            if lower.any():
                upto = int(np.argmax(lower)) + 1
                heapq.heappush(heap, low)
                waiting[low] = [at[upto:]]
                at, right, left, follow = at[:upto], right[:upto], left[:upto], follow[:upto]
            ids[at] = low
            ids[right] = -1
            rank[right] = _NONE
            after[at] = follow
            inner = follow < n
            before[follow[inner]] = at[inner]
            touched = np.unique(np.concatenate([at, left[left >= 0]]))
            touched = touched[ids[touched] >= 0]
            rank[touched] = _NONE
            paired = touched[after[touched] < n]
            rank[paired] = self.rank(ids[paired], ids[after[paired]])
            wait(paired)
        return ids[ids >= 0]


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, "<i4").tobytes()


def _split_token(token: bytes, ranks: dict[bytes, int]) -> Iterator[tuple[bytes, bytes]]:
    """Pairs of tokens that make up a token."""
    for k in range(1, len(token)):
        if token[:k] in ranks and token[k:] in ranks:
            yield token[:k], token[k:]


def _sign(token: bytes, rank: int) -> str:
    """One character per token: a byte's own, else one in the order of ranks above all bytes' ones."""
    return chr(token[0]) if len(token) == 1 else chr(0x10000 + rank)


def _rank_map(ranks: dict[bytes, int]) -> Column:
    """Literal array of maps from two pieces' characters to the merged token's one."""
    signs = {t: _sign(t, r) for t, r in ranks.items()}
    buckets: list[dict[str, str]] = [{} for _ in range(RANK_BUCKETS)]
    for token, sign in signs.items():
        for a, b in _split_token(token, ranks):
            pair = signs[a] + signs[b]
            buckets[zlib.crc32(pair.encode()) % RANK_BUCKETS][pair] = sign
    # one string that the planner folds to a literal
    return F.from_json(F.lit(json.dumps(buckets, separators=(",", ":"))), "array<map<string,string>>")


def _bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def _fold(word: Column, rank_map: Column) -> Column:
    """A word's tokens as a string of their characters."""
    two = F.lit(2)

    def merged(state: Column, i: Column) -> Column:
        pair = F.substring(state, i, two)
        return F.get(rank_map, F.crc32(pair.cast("binary")).bitwiseAND(RANK_BUCKETS - 1).cast("int"))[pair]

    def merge(state: Column, _: Column) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.length(state) - 1, F.lit(1)))
        low = lambda found: F.array_min(found)
        return _bind(
            F.transform(places, lambda i: merged(state, i)),
            lambda found: F.coalesce(
                F.overlay(state, low(found), F.array_position(found, low(found)).cast("int"), two), state
            ),
        )

    bytes_ = word.cast("binary")
    return F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.octet_length(bytes_) - 1, F.lit(1))), F.decode(bytes_, "ISO-8859-1"), merge
    )


@dataclass
class Coder:
    """Encoder and decoder of one vocabulary: its file of ranks and its pattern."""

    path: str
    pattern: str
    frequent: int = 1 << 17
    frequent_bytes: int = 32
    sample_rows: int = 1 << 14
    long_bytes: int = 128
    ranks: dict[bytes, int] = field(init=False, repr=False)

    def __post_init__(self) -> None:
        self.ranks = read_ranks(self.path)

    def word_ids(self, words: DataFrame, word_col: str = "word") -> DataFrame:
        """The words of a table, best distinct and not very long, and their ``ids``."""
        bytes_ = [self.ranks.get(bytes([b])) for b in range(256)]
        byte_ranks = F.from_json(F.lit(json.dumps(bytes_)), "array<int>")
        whole = {t.decode(): r for t, r in self.ranks.items() if t.decode(errors="ignore").encode() == t}
        buckets: list[dict[str, int]] = [{} for _ in range(RANK_BUCKETS)]
        for text, rank in whole.items():
            buckets[zlib.crc32(text.encode()) % RANK_BUCKETS][text] = rank
        tokens = F.from_json(F.lit(json.dumps(buckets, separators=(",", ":"))), "array<map<string,int>>")
        word = F.col(word_col)
        token = F.get(tokens, F.crc32(word.cast("binary")).bitwiseAND(RANK_BUCKETS - 1).cast("int"))[word]

        def rank(sign: Column) -> Column:
            code = F.ascii(sign)
            return F.when(code < 256, F.get(byte_ranks, code)).otherwise(code - 0x10000)

        signs = F.filter(F.split(_bind(_rank_map(self.ranks), lambda m: _fold(word, m)), ""), lambda c: c != "")
        ids = F.when(token.isNotNull(), F.array(token)).otherwise(F.transform(signs, rank))
        return words.select(word_col).withColumn("ids", ids)

    def common_words(self, docs: DataFrame, text_col: str) -> dict[str, bytes]:
        """At most ``frequent`` words of at most ``frequent_bytes`` bytes and their packed ids."""
        share = min(1.0, self.sample_rows / max(docs.count(), 1))
        some = docs.select(text_col).where(F.pmod(F.xxhash64(text_col), F.lit(1 << 20)) <= int(share * (1 << 20)))
        words = F.regexp_extract_all(text_col, F.lit("(?U)" + self.pattern), F.lit(0))
        counted = (
            some.select(F.explode(words).alias("word")).where(F.octet_length("word") <= self.frequent_bytes)
            .groupBy("word").agg(F.count(F.lit(1)).alias("n"))
        )
        # stored first, so that the plan with the large literals is one stage and is planned once
        top = settle(counted.orderBy(F.desc("n"), "word").limit(self.frequent).select("word").repartition(4))
        found = self.word_ids(top).toArrow()  # bounded by ``frequent`` and ``frequent_bytes``
        return {w: _packed(ids) for w, ids in zip(found["word"].to_pylist(), found["ids"].to_pylist())}

    def encode(self, docs: DataFrame, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
        """All columns and the token ids of each text."""
        spark = docs.sparkSession
        ship(spark)
        at = docs.columns.index(text_col)
        known = spark.sparkContext.broadcast((self.common_words(docs, text_col), self.ranks))
        pattern, long_bytes = self.pattern, self.long_bytes

        def encode_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            find = regex.compile(pattern).findall
            common, ranks = known.value
            other: dict[str, bytes] = {}
            merges: Merges | None = None

            def ids_of(word: str) -> bytes:
                nonlocal merges
                if word in other:
                    return other[word]
                raw = word.encode()
                if raw in ranks:
                    ids = _packed([ranks[raw]])
                elif len(raw) <= long_bytes:
                    ids = _packed(merge_word(raw, ranks))
                else:
                    merges = merges or Merges(ranks)
                    return merges.encode(raw).astype("<i4").tobytes()
                if len(other) >= REMEMBERED:
                    other.clear()
                other[word] = ids
                return ids

            for batch in batches:
                for begin, end in slices(batch.column(at)):
                    part = batch.slice(begin, end - begin)
                    rows = [
                        b"".join([common.get(w) or ids_of(w) for w in find(text or "")])
                        for text in part.column(at).to_pylist()
                    ]
                    sizes = np.cumsum([0, *[len(r) // 4 for r in rows]], dtype=np.int32)
                    flat = np.frombuffer(b"".join(rows), "<i4")
                    column = pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat))
                    yield pa.RecordBatch.from_arrays([*part.columns, column], names=[*part.schema.names, "x0"])

        return map_rows(docs, encode_, (T.StructField(ids_col, T.ArrayType(T.IntegerType())),))

    def decode(self, tokens: DataFrame, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
        """All columns and the bytes of each list of ids; a null list has none, an unknown id adds none."""
        pieces = [""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            pieces[rank] = token.hex()
        piece = F.split(F.lit(",".join(pieces)), ",")  # folded to a literal by the planner
        hexed = F.transform(F.coalesce(ids_col, F.array().cast("array<int>")), lambda i: F.get(piece, i))
        return tokens.withColumn(bytes_col, F.unhex(F.array_join(hexed, "")))
