"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

Patterns are the 8-word windows of the benchmark (an item of fewer words is one pattern).
Patterns of one length share a shift table: for each block of two words, how far the search
may move on when the block ends at the current word. Where the shift is zero, the hash of the
block selects a bucket of patterns, and the words of text and pattern are compared: first their
64-bit hashes, then, where all agree, their bytes. The search moves through many segments of a batch
at once, so each step is one NumPy call; most words are never looked at.

The tables hold a block of the benchmark of at most ``BLOCK_BYTES`` of text (or one longer item). A
larger benchmark is searched block after block over the same rows: the driver reads and builds one
block at a time, its tables are broadcast for one pass and then dropped, and the rows with what was
found go to the shared folder before the next pass. So neither memory nor the plan grows with
the benchmark, and no block adds a shuffle.

Defined cases: null and empty texts have no words; an item without words is no pattern; an
item with null id counts as the item ''; several rows with one item_id are one item; an empty
benchmark hits nothing; an empty table gives an empty result; repeated rows are judged one by one; a text
of any length is hashed in blocks, its words (8 bytes each) stand in memory together; columns other than
those read are ignored (``flag``) or kept, whatever their names (``clean``).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.session import checkpointed, map_batches, unused
from marlstone.llm.words import NOT_ALNUM, U64, Alphabet, Words, buffers, mix, slices

WINDOW = 8
BLOCK_BYTES = 4 << 20
_SEGMENT = 256
_BITS = 20

FLAGS = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * U64(0x9FB21C651E98DF25) + b)


class Patterns:
    """All patterns of one length: shift table, suffix buckets, and the items of each pattern."""

    def __init__(self, length: int, patterns: np.ndarray, spelt: list[bytes], items: list[set[str]]):
        self.m, self.b = length, min(2, length)
        ends = self._block(patterns, np.arange(length - self.b, length))
        order = np.argsort(ends, kind="stable")
        self.words, self.suffix = patterns[order], ends[order]
        self.items, self.spelt = [items[i] for i in order], [spelt[i] for i in order]
        self.shift = np.full(1 << _BITS, length - self.b + 1, np.int16)
        for at in range(length - self.b + 1):  # block that ends at at + b - 1
            key = self._slot(self._block(patterns, np.arange(at, at + self.b)))
            np.minimum.at(self.shift, key, length - self.b - at)

    def _block(self, words: np.ndarray, columns: np.ndarray) -> np.ndarray:
        return words[:, columns[0]] if self.b == 1 else _pair(words[:, columns[0]], words[:, columns[1]])

    @staticmethod
    def _slot(block: np.ndarray) -> np.ndarray:
        return (block >> U64(64 - _BITS)).astype(np.int64)

    def search(self, words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start words of occurrences, and the pattern of each."""
        lengths = np.diff(bounds) - self.m + 1
        per = np.maximum(0, -(-lengths // _SEGMENT))
        text = np.repeat(np.arange(len(per)), per)
        k = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
        at = bounds[text] + self.m - 1 + k * _SEGMENT  # the word at which a window ends
        end = np.minimum(at + _SEGMENT, bounds[text + 1])
        found = []
        while len(at):
            block = words[at] if self.b == 1 else _pair(words[at - 1], words[at])
            step = self.shift[self._slot(block)]
            zero = step == 0
            if zero.any():
                found.append((at[zero], block[zero]))
            at = at + np.maximum(step, 1)
            on = at < end
            at, end = at[on], end[on]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        ends, block = (np.concatenate(x) for x in zip(*found, strict=True))
        lo, hi = np.searchsorted(self.suffix, block, "left"), np.searchsorted(self.suffix, block, "right")
        n = hi - lo
        starts, pattern = np.repeat(ends, n) - self.m + 1, np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        same = np.ones(len(starts), bool)
        for j in range(self.m):  # direct comparison, word by word
            same[same] = words[starts[same] + j] == self.words[pattern[same], j]
        return starts[same], pattern[same]


def _spelling(raw: np.ndarray, w: Words, at: int, m: int) -> bytes:
    """m words of ``raw`` in lower case, joined by spaces."""
    return b" ".join(raw[w.starts[k] : w.ends[k]].tobytes().lower() for k in range(at, at + m))


def patterns_of(items: list[tuple[str, str]], window: int = WINDOW) -> list[Patterns]:
    """Pattern groups of (item id, text) pairs, by length."""
    raw, offsets = buffers(pa.array([t for _, t in items], pa.string()))
    w = Words(raw, offsets, Alphabet(NOT_ALNUM, lower=True), places=True)
    groups: dict[int, dict[bytes, tuple[bytes, set[str]]]] = {}
    for i, (item, _) in enumerate(items):
        first, last = w.bounds[i], w.bounds[i + 1]
        m = min(int(last - first), window)
        for at in range(first, last - m + 1 if m else first):
            spelt = _spelling(raw, w, at, m)
            groups.setdefault(m, {}).setdefault(spelt, (w.hashes[at : at + m].tobytes(), set()))[1].add(item)
    return [Patterns(m, np.frombuffer(b"".join(h for h, _ in g.values()), U64).reshape(len(g), m), list(g), [i for _, i in g.values()]) for m, g in sorted(groups.items())]


def _blocks(benchmark: DataFrame, limit: int):
    """The benchmark as lists of (item id, text), each of at most ``limit`` bytes, or one row."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))).toLocalIterator()
    block, size = [], 0
    for item, text in rows:
        n = len(text.encode())
        if block and size + n > limit:
            yield block
            block, size = [], 0
        block.append((item, text))
        size += n
    if block:
        yield block


def _occurrences(column: pa.Array, groups: list[Patterns]):
    """For each slice of a column: first, last, words, per-text spans (start, length) and items."""
    raw, offsets = buffers(column)
    alphabet = Alphabet(NOT_ALNUM, lower=True)
    for first, last in slices(offsets):
        w = Words(raw, offsets[first : last + 1], alphabet)
        spans: list[list[np.ndarray]] = [[] for _ in range(last - first)]
        items: list[set[str]] = [set() for _ in range(last - first)]
        spelt = None
        for g in groups:
            starts, pattern = g.search(w.hashes, w.bounds)
            if not len(starts):
                continue
            order = np.argsort(starts, kind="stable")
            starts, pattern = starts[order], pattern[order]
            if spelt is None:
                spelt = Words(raw, offsets[first : last + 1], alphabet, places=True)
            # an occurrence is one of bytes, not of hashes
            same = np.array([_spelling(raw, spelt, at, g.m) == g.spelt[p] for at, p in zip(starts, pattern, strict=True)], bool)
            starts, pattern = starts[same], pattern[same]
            owner = np.searchsorted(w.bounds, starts, "right") - 1
            cut = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            for a, b in zip(cut, np.r_[cut[1:], len(owner)], strict=True):
                o = owner[a]
                spans[o].append(np.stack([np.unique(starts[a:b]) - w.bounds[o], np.full(len(np.unique(starts[a:b])), g.m)], 1))
                for p in np.unique(pattern[a:b]):
                    items[o] |= g.items[p]
        yield first, last, w.counts, spans, items


def _search(docs: DataFrame, benchmark: DataFrame, window: int, limit: int) -> tuple[DataFrame, list[str]]:
    """``docs`` with four columns more, and their names: words, spans, items, whether a whole window occurs."""
    added = unused(docs, "n", "spans", "items", "full")
    kinds = ("bigint", "binary", "array<string>", "boolean")
    out = docs.select("*", *[F.lit(None).cast(k).alias(a) for a, k in zip(added, kinds, strict=True)])
    names, schema, at = out.columns, out.schema, len(docs.columns)
    text = next(i for i, c in enumerate(names) if c == "text")

    def step(df: DataFrame, tables) -> DataFrame:
        def run(batches):
            for batch in batches:
                _, old_spans, old_items, old_full = (c.to_pylist() for c in batch.columns[at:])
                n, spans, items = [np.zeros(0, np.int64)], [], []
                for _, _, counts, s, i in _occurrences(batch.column(text), tables.value):
                    n.append(counts)
                    spans += s
                    items += i
                new_spans = [(a or b"") + b"".join(x.astype(np.int64).tobytes() for x in b) if a or b else None for a, b in zip(old_spans, spans, strict=True)]
                new_items = [sorted(b.union(a or ())) if a or b else None for a, b in zip(old_items, items, strict=True)]
                full = [bool(a) or any((x[:, 1] == window).any() for x in b) for a, b in zip(old_full, spans, strict=True)]
                new = [pa.array(np.concatenate(n), pa.int64()), pa.array(new_spans, pa.binary()), pa.array(new_items, pa.list_(pa.string())), pa.array(full, pa.bool_())]
                yield pa.RecordBatch.from_arrays([*batch.columns[:at], *new], names=names)

        return df.mapInArrow(run, schema)

    tables = None
    for block in _blocks(benchmark, limit):
        if tables is not None:  # the pass over the block before ends here, and its tables with it
            out = checkpointed(step(out, tables))
            tables.destroy()
        tables = docs.sparkSession.sparkContext.broadcast(patterns_of(block, window))
    return step(out, tables if tables is not None else docs.sparkSession.sparkContext.broadcast([])), added


def _covered(spans: bytes) -> int:
    """How many words lie in any of the spans."""
    s = np.frombuffer(spans, np.int64).reshape(-1, 2)
    s = s[np.argsort(s[:, 0], kind="stable")]
    reach = np.maximum.accumulate(s[:, 0] + s[:, 1])
    before = np.r_[s[0, 0], np.maximum(reach[:-1], s[1:, 0])]
    return int(np.maximum(reach - before, 0).sum())


def flag(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_items: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of ``docs``."""

    found, added = _search(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), benchmark, window, block_bytes)

    def digest(batch):
        none = hashlib.sha256(b"").hexdigest()
        doc_id, n = batch.column(0), batch.column(1)
        spans, items = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        count = [len(i or ()) for i in items]
        sha = [hashlib.sha256(",".join(i).encode()).hexdigest() if i else none for i in items]
        yield [doc_id, n, [_covered(s) if s else 0 for s in spans], count, sha, [c >= min_items for c in count]]

    return map_batches(found.select("doc_id", *added[:3]), digest, FLAGS)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_items: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns, without those that hold a whole window, or pieces of ``min_items`` items.

    An item shorter than a window may occur by chance, so one alone doesn't condemn a document.
    """
    found, (_, _, items, full) = _search(docs, benchmark, window, block_bytes)
    keep = ~F.col(full) & (F.coalesce(F.size(items), F.lit(0)) < min_items)
    return found.filter(keep).select(*[F.col(f"`{c}`") for c in docs.columns])
