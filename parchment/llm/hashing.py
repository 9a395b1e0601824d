"""Words and rolling hashes of many texts at once, with numpy over their joined bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: A 64-bit value for each byte value and an odd multiplier with its inverse modulo 2**64.
_random = np.random.default_rng(20)
VALUES = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 to base**(n-1)."""
    out = np.ones(n, np.uint64)
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * (out[done - 1 : done] * base)
        done += step
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble, so that high and low bits both depend on all."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(32))


def prefix(buffer: np.ndarray, values: np.ndarray = VALUES) -> np.ndarray:
    """Sums of values[b] * BASE**i before each place; differences give the hash of any stretch."""
    out = np.empty(len(buffer) + 1, np.uint64)
    out[0] = 0
    np.cumsum(values[buffer] * powers(BASE, len(buffer)), out=out[1:])
    return out


def stretch(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """Hashes of [start, end), whatever the place; inverse: powers of INVERSE."""
    return mixed((sums[ends] - sums[starts]) * inverse[starts])


def words(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words, runs of anything but ASCII white space."""
    inside = ~SPACE[buffer]
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = prefix(buffer)
    return starts, ends, stretch(sums, starts, ends, powers(INVERSE, len(buffer) + 1))


def groups(texts: list[bytes], most: int = 1 << 20) -> Iterator[range]:
    """Consecutive texts of about `most` bytes together."""
    start = total = 0
    for i, t in enumerate(texts):
        total += len(t) + 1
        if total >= most:
            yield range(start, i + 1)
            start, total = i + 1, 0
    if start < len(texts):
        yield range(start, len(texts))


def word_hashes(texts: list[bytes]) -> Iterator[tuple[range, np.ndarray, np.ndarray]]:
    """For each group of texts: their range, the hashes of their words in order, and for each text its first word's place
    (and at the end the number of words)."""
    for group in groups(texts):
        joined = b"\n".join(texts[i] for i in group)
        starts, _, hashes = words(np.frombuffer(joined, np.uint8))
        begins = np.cumsum([0] + [len(texts[i]) + 1 for i in group])
        yield group, hashes, np.searchsorted(starts, begins)
