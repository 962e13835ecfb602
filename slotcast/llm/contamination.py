"""Benchmark decontamination with a generalised suffix automaton of the test items.

The items' words are the symbols.  Training words stream through the automaton, which always knows
the longest stretch ending here that occurs in some item; stretches of ``window`` words or more,
and whole items shorter than that, mark their words.  The automaton is built on the driver from
blocks of items of bounded bytes, and each block is broadcast by itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import ship
from .common import Spans, Texts, byte_class, map_rows, mix, slices, word_bounds

WINDOW = 13
BLOCK_BYTES = 4 << 20
KNOWN_BITS = 22

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PART_OF_WORD = byte_class(bytes([*range(48, 58), *range(97, 123), *range(128, 256)]))


def words(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, byte starts and ends, and the texts' borders counted in words."""
    data = _LOWER[texts.data]
    starts, ends = word_bounds(~_PART_OF_WORD[data], texts.borders)
    return Spans(data).hash(starts, ends), starts, ends, np.searchsorted(starts, texts.borders)


class SuffixAutomaton:
    """Minimal automaton of all substrings of several sequences."""

    def __init__(self) -> None:
        self.steps: list[dict[int, int]] = [{}]
        self.suffix = [-1]
        self.longest = [0]

    def _state(self, steps: dict[int, int], suffix: int, longest: int) -> int:
        self.steps.append(steps)
        self.suffix.append(suffix)
        self.longest.append(longest)
        return len(self.steps) - 1

    def _shorter_twin(self, at: int, symbol: int, state: int) -> int:
        """Split off the strings of ``state`` that extend those of ``at`` by one symbol."""
        twin = self._state(dict(self.steps[state]), self.suffix[state], self.longest[at] + 1)
        self.suffix[state] = twin
        while at >= 0 and self.steps[at].get(symbol) == state:
            self.steps[at][symbol] = twin
            at = self.suffix[at]
        return twin

    def _exact(self, at: int, symbol: int) -> int:
        state = self.steps[at][symbol]
        if self.longest[state] == self.longest[at] + 1:
            return state
        return self._shorter_twin(at, symbol, state)

    def add(self, sequence: list[int]) -> int:
        """Add a sequence and return the state of the whole of it."""
        last = 0
        for symbol in sequence:
            if symbol in self.steps[last]:
                last = self._exact(last, symbol)
                continue
            new = self._state({}, 0, self.longest[last] + 1)
            at = last
            while at >= 0 and symbol not in self.steps[at]:
                self.steps[at][symbol] = new
                at = self.suffix[at]
            if at >= 0:
                self.suffix[new] = self._exact(at, symbol)
            last = new
        return last

    def follow(self, sequence: list[int]) -> Iterator[tuple[int, int]]:
        """State and length of the longest known substring that ends at each place."""
        at = length = 0
        for symbol in sequence:
            while at and symbol not in self.steps[at]:
                at = self.suffix[at]
                length = self.longest[at]
            if symbol in self.steps[at]:
                at = self.steps[at][symbol]
                length += 1
            yield at, length

    def shorten(self, at: int, length: int) -> int:
        """State of the last ``length`` symbols of a string in ``at``."""
        while self.longest[self.suffix[at]] >= length:
            at = self.suffix[at]
        return at


@dataclass
class _Known:
    """One block of items, ready to be matched."""

    automaton: SuffixAutomaton
    window: int
    shortest: int
    holders: dict[int, set[str]]  # state of a window -> items with it
    shorts: dict[int, tuple[int, set[str]]]  # state of a whole short item -> its length, items
    next_short: list[int]  # nearest state with a short item, from here to the root
    symbols: np.ndarray
    pairs: np.ndarray
    symbol_bits: np.ndarray
    pair_bits: np.ndarray


def _pairs(symbols: np.ndarray) -> np.ndarray:
    return mix(symbols[:-1] * np.uint64(0x9E3779B97F4A7C15) + symbols[1:])


def _bits(values: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << KNOWN_BITS, bool)
    out[values >> np.uint64(64 - KNOWN_BITS)] = True
    return out


def _among(values: np.ndarray, known: np.ndarray, bits: np.ndarray) -> np.ndarray:
    out = bits[values >> np.uint64(64 - KNOWN_BITS)]
    maybe = np.flatnonzero(out)
    place = np.minimum(np.searchsorted(known, values[maybe]), len(known) - 1)
    out[maybe] = known[place] == values[maybe]
    return out


def learn(items: list[tuple[str, bytes]], window: int = WINDOW) -> _Known | None:
    """Automaton and lookup sets of a block of (id, text) items; None if no item has a word."""
    if not items:
        return None
    symbols, _, _, borders = words(Texts(pa.array([text for _, text in items], pa.binary())))
    if not len(symbols):
        return None
    automaton = SuffixAutomaton()
    shorts: dict[int, tuple[int, set[str]]] = {}
    sequences = [symbols[borders[i] : borders[i + 1]] for i in range(len(items))]
    # a split keeps the old number for the longer strings, so whole items are looked up at the end
    for sequence in sequences:
        automaton.add(sequence.tolist())
    holders: dict[int, set[str]] = {}
    for (name, _), sequence in zip(items, sequences):
        at = length = 0
        for at, length in automaton.follow(sequence.tolist()):
            if length >= window:
                holders.setdefault(automaton.shorten(at, window), set()).add(name)
        if 0 < len(sequence) < window:
            shorts.setdefault(at, (len(sequence), set()))[1].add(name)
    next_short = [-1] * len(automaton.steps)
    for state in sorted(range(len(automaton.steps)), key=lambda s: automaton.longest[s]):
        if state in shorts:
            next_short[state] = state
        elif state:
            next_short[state] = next_short[automaton.suffix[state]]
    pairs = [_pairs(s) for s in sequences if len(s) > 1]
    known = np.unique(symbols)
    known_pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(1, np.uint64)
    shortest = min([window, *(n for n, _ in shorts.values())])
    return _Known(
        automaton, window, shortest, holders, shorts, next_short, known, known_pairs,
        _bits(known), _bits(known_pairs),
    )


def _stretches(symbols: np.ndarray, borders: np.ndarray, known: _Known) -> np.ndarray:
    """Starts and ends of word runs that may hold a match: every word and pair is in some item."""
    n = len(symbols)
    live = _among(symbols, known.symbols, known.symbol_bits)
    joined = np.zeros(n + 1, bool)  # place i: word i goes on with word i - 1
    if n > 1:
        joined[1:n] = live[1:] & live[:-1]
        at = np.flatnonzero(joined[1:n]) + 1
        pairs = mix(symbols[at - 1] * np.uint64(0x9E3779B97F4A7C15) + symbols[at])
        joined[at] = _among(pairs, known.pairs, known.pair_bits)
    joined[borders] = False
    starts = np.flatnonzero(live & ~joined[:-1])
    ends = np.flatnonzero(live & ~joined[1:]) + 1
    long = ends - starts >= known.shortest
    return np.stack([starts[long], ends[long]], axis=1)


def _match(texts: Texts, blocks: list[_Known]) -> tuple[list[int], list[list[str]], list[list[tuple]]]:
    """Per text: number of words, items found, and byte spans of hit word runs."""
    symbols, starts, ends, borders = words(texts)
    hit = np.zeros(len(symbols), bool)
    found: dict[int, set[str]] = {}
    for known in blocks:
        stretches = _stretches(symbols, borders, known)
        docs = np.searchsorted(borders, stretches[:, 0], "right") - 1
        for (begin, end), doc in zip(stretches.tolist(), docs.tolist()):
            for i, (at, length) in enumerate(known.automaton.follow(symbols[begin:end].tolist())):
                if length >= known.window:
                    window = known.automaton.shorten(at, known.window)
                    hit[begin + i + 1 - known.window : begin + i + 1] = True
                    found.setdefault(doc, set()).update(known.holders[window])
                short = known.next_short[at]
                while short > 0:
                    size, names = known.shorts[short]
                    if size <= length:
                        hit[begin + i + 1 - size : begin + i + 1] = True
                        found.setdefault(doc, set()).update(names)
                    short = known.next_short[known.automaton.suffix[short]]
    spans: list[list[tuple]] = [[] for _ in range(texts.n)]
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    for begin, end in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
        # a run may go on over the border of two texts
        while begin < end:
            doc = int(np.searchsorted(borders, begin, "right")) - 1
            stop = min(int(end), int(borders[doc + 1]))
            offset = int(texts.borders[doc])
            spans[doc].append(
                (int(starts[begin]) - offset, int(ends[stop - 1]) - offset, stop - int(begin))
            )
            begin = stop
    items = [sorted(found.get(i, ())) for i in range(texts.n)]
    return np.diff(borders).tolist(), items, spans


class Decontaminator:
    """The test items, broadcast block by block; ``matches`` works on an Arrow text column."""

    def __init__(
        self, benchmark: DataFrame, window: int = WINDOW, id_col: str = "item_id",
        text_col: str = "text", block_bytes: int = BLOCK_BYTES,
    ):
        spark = benchmark.sparkSession
        ship(spark)
        self.blocks = []
        block: list[tuple[str, bytes]] = []
        size = 0
        rows = benchmark.select(
            F.coalesce(F.col(id_col).cast("string"), F.lit("")),
            F.coalesce(F.col(text_col), F.lit("")).cast("binary"),
        )
        for name, text in rows.toLocalIterator():
            if block and size + len(text) > block_bytes:
                self._send(spark, block, window)
                block, size = [], 0
            block.append((name, bytes(text)))
            size += len(text)
        self._send(spark, block, window)

    def _send(self, spark, block: list[tuple[str, bytes]], window: int) -> None:
        known = learn(block, window)
        if known is not None:
            self.blocks.append(spark.sparkContext.broadcast(known))

    def matches(self, column: pa.Array) -> Iterator[tuple[int, list[str], list[tuple]]]:
        blocks = [b.value for b in self.blocks]
        for a, b in slices(column):
            yield from zip(*_match(Texts(column.slice(a, b - a)), blocks))


def contaminated(n_words: int, n_hit: int) -> bool:
    return n_hit > 0 and 20 * n_hit >= n_words


SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("words", pa.int64())]))


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """Words hit, items found and byte spans of every text.

    ``contaminated``: at least a twentieth of the words are hit.  A null or empty text has no
    words; a null item id counts as the empty one; without items nothing is hit.
    """
    matcher = Decontaminator(benchmark, window)
    id_type = docs.schema[id_col].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = list(matcher.matches(batch.column(1)))
            n = [g[0] for g in got]
            hits = [sum(s[2] for s in g[2]) for g in got]
            spans = [[dict(zip(("start", "end", "words"), s)) for s in g[2]] for g in got]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(n, pa.int64()), pa.array(hits, pa.int64()),
                    pa.array([g[1] for g in got], pa.list_(pa.string())), pa.array(spans, SPAN),
                    pa.array([contaminated(a, b) for a, b in zip(n, hits)], pa.bool_()),
                ],
                names=[id_col, "n_words", "n_hit", "items", "spans", "contaminated"],
            )

    return docs.select(id_col, text_col).mapInArrow(
        find,
        f"`{id_col}` {id_type}, n_words long, n_hit long, items array<string>, "
        "spans array<struct<start:bigint,end:bigint,words:bigint>>, contaminated boolean",
    )


def items_digest(items: Column | str) -> Column:
    return F.sha2(F.array_join(items, ","), 256)


def remove_contamination(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW
) -> DataFrame:
    """Cut the hit spans out of contaminated texts; other rows and all columns stay as they are."""
    matcher = Decontaminator(benchmark, window)
    at = docs.columns.index(text_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            changed = {}
            for i, (n, _, spans) in enumerate(matcher.matches(column)):
                if contaminated(n, sum(s[2] for s in spans)):
                    text, kept, begin = column[i].as_py().encode(), [], 0
                    for start, end, _ in spans:
                        kept.append(text[begin:start])
                        begin = end
                    changed[i] = b"".join([*kept, text[begin:]]).decode()
            if changed:
                values = column.to_pylist()
                for i, text in changed.items():
                    values[i] = text
                batch = batch.set_column(at, batch.schema.field(at), pa.array(values, column.type))
            yield batch

    return map_rows(docs, clean)
