"""Vectorised word hashing over Arrow string buffers.

The operators that look at words never build Python strings for them: a column of texts is
read as one run of UTF-8 bytes, words are found with a byte table, and each word becomes a
64-bit hash (a polynomial over a random byte table, differences of a running sum). Work goes
in blocks of a quarter megabyte cut at word boundaries, so memory doesn't follow the length of
a text. Null and empty texts have no words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
BLOCK = 1 << 18
_MULT = 0x9E3779B97F4A7C15 | 1


def _mix_int(x: int) -> int:
    x &= (1 << 64) - 1
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & ((1 << 64) - 1)
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & ((1 << 64) - 1)
    return x ^ (x >> 31)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Alphabet:
    """Which bytes separate words, and a random 64-bit value for each byte of a word."""

    def __init__(self, separators: bytes, lower: bool):
        self.sep = np.zeros(256, bool)
        self.sep[list(separators)] = True
        self.value = np.array([_mix_int(0xA5A5 + 977 * i) for i in range(256)], U64)
        if lower:
            self.value[65:91] = self.value[97:123]
            self.sep[65:91] = self.sep[97:123]


SPACE = bytes([0x20, *range(0x09, 0x0E)])
#: Everything of ASCII but digits and lower-case letters (capitals count as lower case).
NOT_ALNUM = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])

_tables: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64, n of each at least."""
    if not _tables or len(_tables[0]) < n:
        size = max(n, BLOCK + 1)
        out = []
        for m in (_MULT, pow(_MULT, -1, 1 << 64)):
            p = np.empty(size, U64)
            p[0], done, step = 1, 1, m
            while done < size:  # doubles what is there
                take = min(done, size - done)
                p[done : done + take] = p[:take] * U64(step)
                done += take
                step = step * step & ((1 << 64) - 1)
            out.append(p)
        _tables[:] = out
    return _tables[0], _tables[1]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offset of each text; nulls have no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    n = len(column)
    off = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, off


def slices(offsets: np.ndarray, limit: int = 4 * BLOCK):
    """Ranges (first, last) of texts with about ``limit`` bytes each; a longer text stands alone."""
    n, first = len(offsets) - 1, 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


class Words:
    """Words of texts ``first`` to ``last`` of a column, in order.

    hashes: a value for each word; bounds: the first word of each text, and the end;
    starts, ends: the bytes of each word (only with ``places``).
    """

    def __init__(self, raw, offsets, alphabet: Alphabet, places: bool = False, block: int = BLOCK):
        lo, hi = int(offsets[0]), int(offsets[-1])
        cuts = offsets[1:-1]
        hashes, starts, ends, at = [], [], [], lo
        while at < hi:
            to = min(at + block, hi)
            if to < hi:  # back to a separator, or on to the next one
                sep = alphabet.sep[raw[at:to]]
                if sep.any():
                    to = at + int(len(sep) - np.argmax(sep[::-1]))
                else:
                    step = to
                    while step < hi:
                        sep = alphabet.sep[raw[step : step + block]]
                        if sep.any():
                            step += int(np.argmax(sep)) + 1
                            break
                        step += len(sep)
                    to = min(step, hi)
            b = raw[at:to]
            word = ~alphabet.sep[b]
            begin = word.copy()
            begin[1:] &= ~word[:-1]
            final = word.copy()
            final[:-1] &= ~word[1:]
            inner = cuts[np.searchsorted(cuts, at) : np.searchsorted(cuts, to)] - at
            begin[inner] |= word[inner]
            before = inner[inner > 0] - 1
            final[before] |= word[before]
            s, e = np.flatnonzero(begin), np.flatnonzero(final)
            if len(s):
                up, down = _powers(len(b))
                run = np.cumsum(alphabet.value[b] * up[: len(b)])
                first = run[s] - alphabet.value[b[s]] * up[s]
                hashes.append(mix((run[e] - first) * down[s]))
                starts.append(s + at)
                if places:
                    ends.append(e + at + 1)
            at = to
        none = np.zeros(0, np.int64)
        self.hashes = np.concatenate(hashes) if hashes else np.zeros(0, U64)
        self.starts = np.concatenate(starts) if starts else none
        self.ends = np.concatenate(ends) if ends else none
        self.bounds = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.bounds)
        if not places:
            self.starts = none

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of n values, by doubling; run i starts at value i."""
    if len(hashes) < n:
        return np.zeros(0, U64)
    length, run = 1, hashes
    while length < n:
        step = min(length, n - length)
        run = joined(run[: len(run) - step], run[step:], length + step)
        length += step
    return run


def joined(left: np.ndarray, right: np.ndarray, length: int) -> np.ndarray:
    """A hash of two windows that follow or overlap, of ``length`` values together."""
    return mix(left * U64(0xD1342543DE82EF95) + (right ^ U64(length)))
