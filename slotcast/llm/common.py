"""Shared pieces: the query registry, table reading, and word splitting over Arrow buffers.

Rules that hold for every operator here:

* a null text counts as an empty one; a null id stays null in the result and sorts first;
* only the named id and text columns are read, so other columns and clashing names do no harm;
* repeated rows (same id, same text) each get a result row unless the operator says otherwise;
* an empty table gives an empty result with the same columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Bytes of text that a Python task looks at together; longer texts are taken one by one.
CHUNK_BYTES = 1 << 20


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(df: DataFrame) -> DataFrame:
    """Columns named c0, c1, ... so that neither odd nor clashing names matter."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def map_rows(df: DataFrame, function, extra: tuple[T.StructField, ...] = ()) -> DataFrame:
    """``mapInArrow`` over all columns; the result has the same ones and then ``extra``."""
    plain = numbered(df)
    fields = [T.StructField(f.name, f.dataType) for f in plain.schema]
    more = [T.StructField(f"x{i}", f.dataType) for i, f in enumerate(extra)]
    out = plain.mapInArrow(function, T.StructType([*fields, *more]))
    return out.toDF(*df.columns, *[f.name for f in extra])


class Texts:
    """The texts of an Arrow column as one byte array with document borders; null is empty."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_binary())
        ends = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
        data = column.buffers()[2]
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.n = len(column)
        self.borders = ends - ends[0]
        self.data = raw[ends[0] : ends[-1]]
        if column.null_count:  # a null may hide bytes
            sizes = np.where(column.is_valid().to_numpy(False), np.diff(self.borders), 0)
            keep = np.repeat(sizes > 0, np.diff(self.borders))
            self.data = self.data[keep]
            self.borders = np.concatenate([[0], np.cumsum(sizes)])

    def of(self, i: int) -> bytes:
        return self.data[self.borders[i] : self.borders[i + 1]].tobytes()


def slices(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a text column with at most ``limit`` bytes each, or one text."""
    sizes = column.cast(pa.large_binary())
    ends = np.frombuffer(sizes.buffers()[1], np.int64, len(sizes) + 1, sizes.offset * 8)
    begin = 0
    while begin < len(column):
        end = int(np.searchsorted(ends, ends[begin] + limit, "right")) - 1
        end = min(len(column), max(begin + 1, end))
        yield begin, end
        begin = end


def byte_class(inside: bytes) -> np.ndarray:
    """Lookup table that is true for the given bytes."""
    found = np.zeros(256, bool)
    found[list(inside)] = True
    return found


BLANK = byte_class(b" \t\n\x0b\x0c\r")

_MASK = (1 << 64) - 1


def _mix(x: int) -> int:
    x = (x + 0x9E3779B97F4A7C15) & _MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
    return x ^ (x >> 31)


#: Two primes below 2^31, so that a product of two residues and a sum of 2^32 of them fit 64 bits.
_PRIMES = (2147483647, 2147483629)
_BASES = tuple(_mix(7 + i) % (p - 2) + 2 for i, p in enumerate(_PRIMES))
_BYTES = [np.array([_mix(1000 * i + b) % (p - 1) + 1 for b in range(256)], np.uint64) for i, p in enumerate(_PRIMES)]
_POWERS: list[tuple[np.ndarray, np.ndarray]] = [(np.ones(1, np.uint64),) * 2] * 2


def _powers(i: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the i-th base and of its inverse modulo the i-th prime, at least n of them."""
    if len(_POWERS[i][0]) < n:
        prime, both = _PRIMES[i], []
        for base in (_BASES[i], pow(_BASES[i], -1, _PRIMES[i])):
            out = np.ones(1, np.uint64)
            while len(out) < max(n, CHUNK_BYTES + 1):
                step = np.uint64(pow(base, len(out), prime))
                out = np.concatenate([out, out * step % np.uint64(prime)])
            both.append(out)
        _POWERS[i] = (both[0], both[1])
    return _POWERS[i][0][:n], _POWERS[i][1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Spans:
    """Hashes of any byte spans of one array, by prefix sums of two polynomials modulo primes.

    Two different spans of n bytes are equal in both with a chance of at most (n / 2^31)^2 over the
    choice of bases, also where their bytes follow a pattern.
    """

    def __init__(self, data: np.ndarray):
        self.parts = []
        for i, prime in enumerate(_PRIMES):
            power, inverse = _powers(i, len(data) + 1)
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(_BYTES[i][data] * power[:-1] % np.uint64(prime), out=sums[1:])
            self.parts.append((sums, inverse))

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        one, two = (
            (sums[ends] - sums[starts]) % np.uint64(prime) * inverse[starts] % np.uint64(prime)
            for (sums, inverse), prime in zip(self.parts, _PRIMES)
        )
        return mix(one << np.uint64(31) ^ two)

    def sliding(self, width: int) -> np.ndarray:
        """Hashes of all spans of ``width`` bytes, by start."""
        n = max(0, len(self.parts[0][0]) - width)
        both = []
        for (sums, inverse), prime in zip(self.parts, _PRIMES):
            part = sums[width:] - sums[:n]
            part %= np.uint64(prime)  # in place: new arrays of this size cost more than the sums
            part *= inverse[:n]
            part %= np.uint64(prime)
            both.append(part)
        one, two = both
        one <<= np.uint64(31)
        one ^= two
        return mix(one)


def word_bounds(blank: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the words, given which bytes are blank."""
    n = len(blank)
    solid = ~blank
    first, last = solid.copy(), solid.copy()
    first[1:] &= blank[:-1]
    last[:-1] &= blank[1:]
    cuts = borders[(borders > 0) & (borders < n)]
    first[cuts] = solid[cuts]
    last[cuts - 1] = solid[cuts - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def per_document(values: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive borders."""
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return sums[borders[1:]] - sums[borders[:-1]]


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n places are inside any span."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + lengths, -1)
    return np.cumsum(steps[:-1]) > 0
