"""Two-stage suffix sorting of a byte array, vectorised over buckets.

Suffixes smaller than their successors are sorted directly by their first bytes.  The others follow
from one scan over the buckets of first bytes: the predecessor of a placed suffix, if it is larger,
goes to the next free place of its own bucket.
"""

from __future__ import annotations

import numpy as np

WORD = 8


def byte_words(data: np.ndarray, depth: int) -> np.ndarray:
    """The eight bytes from each place on as one number; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(depth + 2 * WORD, np.uint8)])
    view = np.ndarray((len(data) + depth + WORD,), ">u8", padded.tobytes(), strides=(1,))
    return view.astype(np.uint64)


def smaller_than_next(data: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one a byte later; the last one is not."""
    n = len(data)
    ends = np.append(np.flatnonzero(data[1:] != data[:-1]), n - 1)  # ends of runs of one byte
    rising = np.append(data[ends[:-1]] < data[ends[:-1] + 1], False)
    return np.repeat(rising, np.diff(np.append(-1, ends)))


def sort_directly(places: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """Places sorted by their first ``depth`` bytes, ties by place; only ties are looked at again."""
    key = words[places]
    inner = np.argsort(key, kind="stable")
    out, key = places[inner], key[inner]
    new = np.append(True, key[1:] != key[:-1])
    for shift in range(WORD, depth, WORD):
        tied = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(tied):
            break
        group = np.cumsum(new)[tied]
        key = words[out[tied] + shift]
        inner = np.lexsort((key, group))
        out[tied], group, key = out[tied][inner], group[inner], key[inner]
        new[tied] = np.append(True, (group[1:] != group[:-1]) | (key[1:] != key[:-1]))
    return out


def suffix_array(data: np.ndarray, depth: int) -> np.ndarray:
    """Places of all suffixes in the order of their first ``depth`` bytes (end sorts first)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64)
    words = byte_words(data, depth + WORD)
    small = smaller_than_next(data)
    direct = sort_directly(np.flatnonzero(small), words, depth)
    direct_ends = np.searchsorted(data[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[data[-1]].append(np.array([n - 1]))  # precedes the empty suffix
    out = []
    for byte in range(256):
        parts = waiting[byte]
        chain = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        placed = [chain]
        while len(chain):  # larger suffixes that begin with more of the same byte
            before = chain[chain > 0] - 1
            chain = before[data[before] == byte]
            placed.append(chain)
        bucket = np.concatenate([*placed, direct[direct_ends[byte] : direct_ends[byte + 1]]])
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[data[before] > byte]
        if len(before):
            first = data[before]
            before = before[np.argsort(first, kind="stable")]
            counts = np.bincount(first, minlength=256)
            ends = np.cumsum(counts)
            for b in np.flatnonzero(counts):
                waiting[b].append(before[ends[b] - counts[b] : ends[b]])
    return np.concatenate(out)


def common_prefixes(order: np.ndarray, data: np.ndarray, depth: int) -> np.ndarray:
    """Common bytes of each sorted suffix and the one before, up to ``depth``; 0 for the first."""
    out = np.zeros(len(order), np.int64)
    words = byte_words(data, depth + WORD)
    live = np.arange(1, len(order))
    for shift in range(0, depth, WORD):
        differ = words[order[live] + shift] ^ words[order[live - 1] + shift]
        out[live] += sum((differ < np.uint64(1 << (8 * k))).astype(np.int64) for k in range(8))
        live = live[differ == 0]
    return np.minimum(out, depth)
