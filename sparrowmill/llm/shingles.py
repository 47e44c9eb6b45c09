"""Word and shingle hashes of whole Arrow text columns with numpy."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
CHUNK = 1 << 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: stretches of up to this many bytes are hashed eight bytes at a time, longer ones by blake2b
SHORT = 64
_INSIDE = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """Each 64-bit value spread over all bits."""
    h = (h ^ (h >> np.uint64(30))) * MIX[0]
    h = (h ^ (h >> np.uint64(27))) * MIX[1]
    return h ^ (h >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each stretch of a byte array. Every eight bytes are mixed before the next ones come in, so no pattern of bytes cancels out."""
    size = ends - starts
    out = mixed(size.astype(np.uint64) + MIX[1])
    lanes = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, np.uint8)]), 8)
    rows = np.flatnonzero(size <= SHORT)
    for at in range(0, SHORT, 8):
        rows = rows[size[rows] > at]
        if not len(rows):
            break
        lane = lanes[starts[rows] + at].view("<u8")[:, 0] & _INSIDE[np.minimum(size[rows] - at, 8)]
        out[rows] = mixed((out[rows] + MIX[0]) ^ lane)
    for k in np.flatnonzero(size > SHORT):
        out[k] = int.from_bytes(blake2b(data[starts[k] : ends[k]], digest_size=8).digest(), "little")
    return out


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each stretch of true values."""
    edge = np.diff(np.r_[False, inside, False].astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each white-space separated word of a byte array, with A-Z read as a-z."""
    starts, ends = runs(~SPACE[data])
    return span_hashes(LOWER[data], starts, ends), starts


#: two primes, as a running sum modulo 2^64 would take some different sequences for the same
PRIMES = np.array([[2147483647], [2147483629]], np.uint64)
BASES = (1103515245, 1566083941)


class Sums:
    """Hashes of any stretch of a sequence of 64-bit values, from running sums of powers modulo two primes."""

    _powers = np.ones((2, 1), np.uint64), np.ones((2, 1), np.uint64)

    @classmethod
    def powers(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Both bases to the power of 0..n and the inverses; kept for later sequences."""
        up, down = cls._powers
        while up.shape[1] <= n:
            size = up.shape[1]
            step = [np.array([[pow(b, e * size, int(p))] for b, p in zip(BASES, PRIMES[:, 0], strict=True)], np.uint64) for e in (1, -1)]
            up, down = (np.concatenate([x, x * s % PRIMES], 1) for x, s in zip((up, down), step, strict=True))
        cls._powers = up, down
        return up, down

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.up, self.down = self.powers(n + 1)
        self.sums = np.zeros((2, n + 1), np.uint64)
        np.cumsum(values % PRIMES * self.up[:, :n] % PRIMES, axis=1, out=self.sums[:, 1:])

    def part(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Both remainders of the values from a up to b."""
        return (self.sums[:, b] - self.sums[:, a]) % PRIMES * self.down[:, a] % PRIMES

    def without(self, a: int, m: int) -> np.ndarray:
        """Both remainders of the m values from a on, once without each of them."""
        k = a + np.arange(m)
        head, tail = self.part(np.full(m, a), k), self.part(k + 1, np.full(m, a + m))
        return (head + tail * self.up[:, np.arange(m)]) % PRIMES


def texts(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) for runs of rows whose text is CHUNK bytes or little more."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    whole = column.buffers()[2]
    data = np.frombuffer(whole, np.uint8) if whole is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, side="right")) - 1)
        yield at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def words(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, word hashes) of every row; null texts have none."""
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    for first, data, offsets in texts(column):
        # a row's last word must not run on into the next row: rows are laid out with a blank between them
        n = len(offsets) - 1
        spaced = np.full(len(data) + n, 32, np.uint8)
        row = np.repeat(np.arange(n), np.diff(offsets))
        spaced[np.arange(len(data)) + row] = data
        hashes, starts = word_hashes(spaced)
        cuts = np.searchsorted(starts, offsets + np.arange(n + 1))
        for k in range(n):
            yield first + k, hashes[cuts[k] : cuts[k + 1]] if valid[first + k] else hashes[:0]


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each row's word shingles; of fewer words, one hash of all of them."""
    for _, h in words(column):
        n = len(h)
        if n == 0:
            yield h
            continue
        k = min(n, size)
        out = np.zeros(n - k + 1, np.uint64)
        for at in range(k):
            out = (out ^ (out >> np.uint64(29))) * MIX[1] + h[at : n - k + 1 + at]
        out = mixed(out + np.uint64(k))  # a short text never equals a part of a longer one
        out.sort()
        yield out[np.r_[True, out[1:] != out[:-1]]]
