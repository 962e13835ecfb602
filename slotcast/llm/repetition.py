"""Quality rules on repeated passages, by a suffix array over the words of each text.

Texts are handled in chunks of bounded bytes.  The words of a chunk form one sequence in which
equal words of different texts are different symbols, so one suffix array serves the whole chunk
and no repeat crosses a border.  Suffixes are sorted by prefix doubling; only those still tied
take part in the next round.  Longest common prefixes of neighbours come from the stored ranks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import ship
from .common import (
    BLANK, Spans, Texts, byte_class, covered, map_rows, mix, per_document, slices, word_bounds,
)

SYMBOLS = byte_class(b"#*$%&|<>")


@dataclass(frozen=True)
class RepetitionRules:
    """Limits of the method's verdict; lengths count words."""

    min_repeat: int = 10
    max_covered: float = 0.2
    max_longest: int = 100


def suffix_array(symbols: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sorted suffixes, and per doubling level the ranks of all suffixes by that prefix.

    ``ranks[k][i]`` is the same for two suffixes only if their first 2^k symbols are equal; the
    end of the sequence equals nothing.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    new = np.ones(n, bool)
    new[1:] = symbols[order[1:]] != symbols[order[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]  # first place of its group
    ranks, width = [rank], 1
    while True:
        ends = np.append(new[1:], True)
        tied = np.flatnonzero(~(new & ends))  # places in groups of two or more
        if not len(tied):
            return order, ranks
        at = order[tied]
        after = at + width
        next_rank = np.where(after < n, rank[np.minimum(after, n - 1)], -1 - at)
        group = rank[at]
        inner = np.lexsort((next_rank, group))
        at, group, next_rank = at[inner], group[inner], next_rank[inner]
        order[tied] = at
        split = np.ones(len(at), bool)
        split[1:] = (group[1:] != group[:-1]) | (next_rank[1:] != next_rank[:-1])
        new[tied] = split
        rank = rank.copy()
        rank[at] = tied[np.flatnonzero(split)][np.cumsum(split) - 1]
        ranks.append(rank)
        width *= 2


def neighbour_prefixes(order: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """Common prefix length of each sorted suffix with the one before it; 0 for the first."""
    n = len(order)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    place = np.flatnonzero(ranks[0][order[1:]] == ranks[0][order[:-1]]) + 1
    a, b = order[place - 1].copy(), order[place].copy()
    length = np.zeros(len(place), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        live = np.flatnonzero((a < n) & (b < n))
        same = live[ranks[k][a[live]] == ranks[k][b[live]]]
        length[same] += 1 << k
        a[same] += 1 << k
        b[same] += 1 << k
    out[place] = length
    return out


def longest_repeats(symbols: np.ndarray) -> np.ndarray:
    """For each place the length of the longest substring that starts here and also elsewhere."""
    if not len(symbols):
        return np.zeros(0, np.int64)
    order, ranks = suffix_array(symbols)
    common = neighbour_prefixes(order, ranks)
    out = np.empty(len(symbols), np.int64)
    out[order] = np.maximum(common, np.append(common[1:], 0))
    return out


def measure(texts: Texts, min_repeat: int) -> dict[str, np.ndarray]:
    """Counts per text; see the columns of ``judge_repetition``."""
    data, borders, n = texts.data, texts.borders, texts.n
    blank = BLANK[data]
    starts, ends = word_bounds(blank, borders)
    spans = Spans(data)
    word_borders = np.searchsorted(starts, borders)
    doc = np.repeat(np.arange(n), np.diff(word_borders))
    symbols = mix(spans.hash(starts, ends) ^ mix(doc.astype(np.uint64) + np.uint64(1)))
    repeat = longest_repeats(symbols)
    three = np.flatnonzero(repeat >= 3)
    long = np.flatnonzero(repeat >= min_repeat)
    size = len(starts)
    chars = (data & 0xC0) != 0x80
    # lines: a text's borders and its line feeds cut the bytes
    feeds = np.flatnonzero(data == 10)
    line_start = np.sort(np.concatenate([borders[:-1], feeds + 1]))
    line_doc = np.searchsorted(borders[:-1], line_start, "right") - 1
    order = np.lexsort((line_start, line_doc))
    line_start, line_doc = line_start[order], line_doc[order]
    feed_or_end = np.sort(np.concatenate([borders[1:], feeds]))
    line_end = feed_or_end
    solid = np.concatenate([[0], np.cumsum(~blank)])
    wordy = solid[line_end] > solid[line_start]
    line_key = spans.hash(line_start[wordy], line_end[wordy])
    line_key = mix(line_key ^ mix(line_doc[wordy].astype(np.uint64) + np.uint64(1)))
    _, first = np.unique(line_key, return_index=True)
    again = np.ones(len(line_key), bool)
    again[first] = False
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, doc, repeat)
    return {
        "n_words": np.diff(word_borders),
        "word_chars": per_document(chars & ~blank, borders),
        "n_symbols": per_document(SYMBOLS[data], borders),
        "n_dup_lines": np.bincount(line_doc[wordy][again], minlength=n)[:n],
        "n_repeat_words": per_document(
            covered(three, np.full(len(three), 3), size), word_borders
        ),
        "n_covered_words": per_document(covered(long, repeat[long], size), word_borders),
        "longest_repeat": longest,
    }


COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered_words",
    "longest_repeat",
)


def verdicts(column: pa.Array, rules: RepetitionRules) -> dict[str, np.ndarray]:
    parts = [
        measure(Texts(column.slice(a, b - a)), rules.min_repeat) for a, b in slices(column)
    ]
    out = {c: np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, int) for c in COUNTS}
    words = out["n_words"]
    out["base_failed"] = (words < 50) | (100 * out["n_repeat_words"] > 50 * words)
    repeats = (out["n_covered_words"] > rules.max_covered * words) | (
        out["longest_repeat"] > rules.max_longest
    )
    out["kept"] = ~out["base_failed"] & ~repeats
    return out


def judge_repetition(
    docs: DataFrame, rules: RepetitionRules = RepetitionRules(), id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Word, symbol, line and repeat counts of every text and whether it is kept.

    ``n_covered_words`` counts words inside any maximal repeat of ``min_repeat`` words or more,
    ``longest_repeat`` is the longest of all.  Null and empty texts have no words and fail.
    """
    ship(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = verdicts(batch.column(1), rules)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(v) for v in got.values()]], [id_col, *got]
            )

    columns = ", ".join(f"{c} long" for c in COUNTS)
    return docs.select(id_col, text_col).mapInArrow(
        judge, f"`{id_col}` {id_type}, {columns}, base_failed boolean, kept boolean"
    )


def keep_good(docs: DataFrame, rules: RepetitionRules = RepetitionRules(), text_col: str = "text"):
    """The rows whose text passes; all columns stay."""
    ship(docs.sparkSession)
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(verdicts(batch.column(at), rules)["kept"]))

    return map_rows(docs, keep)
