"""Statistics of texts that the classifiers share, from Arrow buffers with NumPy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from marlstone.llm.words import BLOCK, SPACE, Alphabet, Words, buffers, slices

#: Classes of bytes; a character of several bytes counts at its first byte.
LOWER, UPPER, DIGIT, SPACES, LINE, STOP, SHOUT, SYMBOL, BAR, PUNCT, OTHER, REST = range(12)
_CLASS = np.full(256, PUNCT, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = LOWER, UPPER, DIGIT
_CLASS[list(b" \t\r\x0b\x0c")], _CLASS[10] = SPACES, LINE
_CLASS[list(b".,;:?")], _CLASS[list(b"!")] = STOP, SHOUT
_CLASS[list(b"#$%&*@^~+=<>")], _CLASS[list(b"|")] = SYMBOL, BAR
_CLASS[0x80:0xC0], _CLASS[0xC0:] = REST, OTHER


def classes(b: np.ndarray) -> np.ndarray:
    """The class of each byte; accented Latin letters count as upper or lower."""
    c = _CLASS[b]
    latin = np.flatnonzero(b[:-1] == 0xC3)
    c[latin] = np.where(b[latin + 1] < 0x9F, UPPER, LOWER)
    return c


def class_counts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Characters of each class in each text."""
    n = len(offsets) - 1
    out = np.zeros((n, 12))
    for at in range(int(offsets[0]), int(offsets[-1]), BLOCK):
        cut = np.clip(offsets, at, at + BLOCK)
        text = np.repeat(np.arange(n) * 12, np.diff(cut))
        kind = classes(raw[cut[0] : cut[-1] + 1])[: cut[-1] - cut[0]]  # the last character may go on behind the block
        out += np.bincount(text + kind, minlength=12 * n).reshape(n, 12)
    return out


def _ratio(a, b):
    return a / np.maximum(b, 1)


def per_text(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of x over the ranges between bounds, each by itself, so other texts don't matter."""
    n = len(bounds) - 1
    return np.bincount(np.repeat(np.arange(n), np.diff(bounds)), x.astype(float), n)


QUALITY = 15


def quality_features(column: pa.Array) -> np.ndarray:
    """Transformed statistics (logarithms and square roots) of each text; zeros for an empty one."""
    raw, offsets = buffers(column)
    alphabet, out = Alphabet(SPACE, lower=True), [np.zeros((0, QUALITY))]
    for first, last in slices(offsets):
        off = offsets[first : last + 1]
        c = class_counts(raw, off)
        w = Words(raw, off, alphabet, places=True)
        n, owner = w.counts.astype(float), w.owner()
        chars = c[:, :REST].sum(1)
        order = np.lexsort((w.hashes, owner))
        h, o = w.hashes[order], owner[order]
        new = np.r_[True, (h[1:] != h[:-1]) | (o[1:] != o[:-1])] if len(h) else np.zeros(0, bool)
        starts = np.flatnonzero(new)
        runs = np.diff(np.r_[starts, len(h)])
        distinct = np.bincount(o[starts], minlength=len(n)).astype(float)
        top = np.zeros(len(n))
        np.maximum.at(top, o[starts], runs)
        again = np.r_[False, (w.hashes[1:] == w.hashes[:-1]) & (owner[1:] == owner[:-1])] if len(h) else np.zeros(0)
        ended = classes(raw[w.ends - 1]) if len(h) else np.zeros(0)
        length = np.bincount(owner, (w.ends - w.starts).astype(float), minlength=len(n))
        squares = np.bincount(owner, (w.ends - w.starts).astype(float) ** 2, minlength=len(n))
        mean = _ratio(length, n)
        letters = c[:, LOWER] + c[:, UPPER] + c[:, OTHER]
        out.append(
            np.stack(
                [
                    np.log1p(n),
                    np.sqrt(_ratio(c[:, UPPER], letters)),
                    np.sqrt(_ratio(c[:, SYMBOL], chars)),
                    np.sqrt(_ratio(c[:, SHOUT], chars)),
                    np.sqrt(_ratio(c[:, BAR], chars)),
                    np.sqrt(_ratio(c[:, DIGIT], chars)),
                    np.log1p(mean),
                    np.log1p(distinct) / np.maximum(np.log1p(n), 1e-9),
                    np.sqrt(_ratio(per_text(again, w.bounds), n)),
                    np.sqrt(_ratio(top, n)),
                    np.sqrt(_ratio(c[:, LINE], n)),
                    np.sqrt(_ratio(c[:, STOP], n)),
                    np.sqrt(_ratio(c[:, PUNCT], chars)),
                    np.sqrt(_ratio(per_text((ended == SYMBOL) | (ended == SHOUT), w.bounds), n)),
                    np.log1p(np.sqrt(np.maximum(_ratio(squares, n) - mean**2, 0))),
                ],
                1,
            )
            * (n > 0)[:, None]
        )
    return np.concatenate(out)
