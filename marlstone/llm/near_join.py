"""N-gram Jaccard join with PartEnum signatures.

A document's set holds the hashes of its distinct word n-grams; two sets link when their Jaccard
similarity reaches a percentage. Similar sets have similar sizes, so sizes are cut in bands, and
within a band the similarity bounds the number k of elements in which two sets differ. PartEnum:
the element domain is cut in ``n1`` first-level parts, each in ``n2`` second-level parts; at least
one first-level part differs in at most ``k2`` elements, so some subset of ``n2 - k2`` of its parts
holds the same elements in both sets. A signature is the hash of a set's elements in one such
subset; all subsets are enumerated, so sets that link share a signature. A set also signs in the
next band if its partner may fall there.

An empty subset says nothing, so it gets no signature; ``n1`` has parts to spare for that. A set
with too few parts without empty subsets signs again under another seed: of two sets that might miss
each other, both do. The layout (``n2``, ``k2``) of a band is chosen by its expected signatures.

Steps:
1. Fingerprint every text; equal sets become one representative (the smallest id).
2. Sign representatives. In each batch of rows the smallest id of a signature is its pivot, and pivots
   alone travel; the smallest of them is their pivot in turn, so a signature that a third of all
   documents share sends one row for each batch to the task that compares its ids.
3. Test each member against its pivot, form components; then test members of a signature that
   lie in different components against each other. Linked sets of one component need no test.
Tests: a parity sketch of each set bounds the difference from below and rules out most pairs
exactly; the rest are verified on the sets themselves (64-bit hashes of n-grams): members of a signature
one after another against a pivot that the task holds once, then what the sketches connect in
blocks. Pairs are formed inside blocks, in tasks; a block gives at most one pair for each member, a
spanning forest of the pairs that pass, so a large group of near copies costs rows in proportion to
its members. No step gathers rows on the driver.
4. To count links (``linked``), all sets of a component meet each other in blocks, once each pair, on
   the sets themselves; only the counts leave the task. Links never lie between components.

Defined cases: null and empty texts and texts without words have an empty set and link with
nothing; a text of fewer words than n is one n-gram of all its words; rows that repeat a doc_id
are one node whose texts may differ; a row with null doc_id links with nothing and has a
null component; texts of any length are hashed in blocks, but the set of one (8 bytes an
n-gram) stands in memory whole; an empty table gives an empty result; other columns are ignored
(``join``, ``linked``) or kept (``distinct``).
"""

from __future__ import annotations

import math
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.components import components
from marlstone.llm.session import checkpointed, few, map_batches, unused
from marlstone.llm.words import SPACE, U64, Alphabet, Words, buffers, joined, mix, slices, windows

WORDS, PERCENT = 5, 80
#: Second-level parts of a first-level part, and how many of them a subset leaves out.
LAYOUTS = ((1, 0), (2, 1), (3, 1))
#: A signature should stand for so many elements.
ELEMENTS = 3
GROWTH = 1.5
SALTS = 16
GROUP = 2048
#: Members and elements of a block of sets whose links are counted.
COUNT_MEMBERS, COUNT_ELEMENTS = 1024, 1 << 20
KEYS = ["h1", "h2", "n"]
SKETCH_BITS = 4096


def differing(total: int, percent: int) -> int:
    """The most elements in which sets of ``total`` elements together may differ and still link."""
    return total - 2 * -(-percent * total // (100 + percent))


def _parts(size: int, need: int, n2: int, k2: int) -> int | None:
    """First-level parts of which ``need`` have no empty subset, in nearly all sets of ``size`` elements."""
    n1 = need
    while n1 <= 3 * need + 50:
        blank = min(1.0, math.comb(n2, k2) * math.exp(-size * (n2 - k2) / (n1 * n2)))
        if need == 1 or n1 * (1 - blank) - 2 * math.sqrt(n1 * blank * (1 - blank)) >= need:
            return n1
        n1 += max(1, n1 // 50)
    return None


@lru_cache
def bands(percent: int, up_to: int) -> tuple[tuple[int, int, int, int, int, int], ...]:
    """(smallest size, largest size, n1, parts needed, n2, k2) of each band.

    Of the layouts with enough elements in a signature, the one with the fewest signatures.
    """
    out, low = [], 1
    while low <= up_to:
        high = max(low, int(low * GROWTH))
        k = max(differing(2 * high, percent), differing(2 * high - 1, percent))
        found = []
        for n2, k2 in LAYOUTS if k else LAYOUTS[:1]:
            need = k // (k2 + 1) + 1
            n1 = _parts(-(-low * percent // 100), need, n2, k2)
            if n1 is not None:
                elements = (low + high) / 2 * (n2 - k2) / (n1 * n2)
                found.append((elements < ELEMENTS, -elements if elements < ELEMENTS else n1 * math.comb(n2, k2), n1, need, n2, k2))
        need = k + 1
        out.append((low, high, *(min(found)[2:] if found else (need, need, 1, 0))))
        low = high + 1
    return tuple(out)


class Sets:
    """Distinct n-grams of the texts of a slice: values in order of text, and bounds."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, n: int):
        w = Words(raw, offsets, Alphabet(SPACE, lower=True))
        gram, parts = windows(w.hashes, n), []
        for k, count in enumerate(w.counts):
            s = w.bounds[k]
            if count >= n:
                g = np.sort(gram[s : s + count - n + 1])
                parts.append(g[np.r_[True, g[1:] != g[:-1]]])
            elif count:
                parts.append(joined(windows(w.hashes[s : s + count], int(count)), np.zeros(1, U64), n + int(count)))
            else:
                parts.append(np.zeros(0, U64))
        self.sizes = np.array([len(p) for p in parts], np.int64)
        self.bounds = np.r_[0, np.cumsum(self.sizes)]
        self.values = np.concatenate(parts) if parts else np.zeros(0, U64)
        self.owner = np.repeat(np.arange(len(parts)), self.sizes)

    def sums(self, values: np.ndarray) -> np.ndarray:
        run = np.r_[np.zeros(1, U64), np.cumsum(values)]
        return run[self.bounds[1:]] - run[self.bounds[:-1]]

    def hashes(self) -> list[np.ndarray]:
        """Two hashes of each set."""
        return [self.sums(mix(self.values ^ seed)).view(np.int64) for seed in (U64(0), U64(0xC0FFEE))]

    def elements(self) -> list[bytes]:
        return [self.values[a:b].tobytes() for a, b in zip(self.bounds[:-1], self.bounds[1:], strict=True)]

    def sketches(self) -> list[bytes]:
        """Parities of the elements in each of 64 to ``SKETCH_BITS`` cells, about two for an element."""
        bits = 1 << np.clip(np.ceil(np.log2(2 * np.maximum(self.sizes, 1))).astype(np.int64), 6, int(math.log2(SKETCH_BITS)))
        base = np.r_[0, np.cumsum(bits)]
        cell = base[self.owner] + (mix(self.values + U64(0x5EED)) & (bits[self.owner] - 1).astype(U64)).astype(np.int64)
        packed = np.packbits((np.bincount(cell, minlength=base[-1]) & 1).astype(np.uint8))
        return [packed[a // 8 : b // 8].tobytes() for a, b in zip(base[:-1], base[1:], strict=True)]

    def signatures(self, percent: int) -> list[np.ndarray]:
        """The signatures of each set."""
        found: list[list[np.ndarray]] = [[] for _ in self.sizes]
        if not len(self.values):
            return [np.zeros(0, U64) for _ in self.sizes]
        for low, high, n1, need, n2, k2 in bands(percent, int(self.sizes.max()) * 100 // percent + 1):
            reach = self.sizes * 100 >= percent * low
            todo = np.flatnonzero((self.sizes > 0) & reach & (self.sizes <= high))
            for seed in range(16):
                if not len(todo):
                    break
                todo = self._sign(found, todo, U64(mix(np.array([high * 64 + seed], U64))[0]), n1, need, n2, k2)
            for t in todo:  # improbable: every seed left it with empty subsets
                found[t].append(mix(np.array([high], U64)))
        return [np.concatenate(f) if f else np.zeros(0, U64) for f in found]

    def _sign(self, found, todo: np.ndarray, seed: np.uint64, n1: int, need: int, n2: int, k2: int) -> np.ndarray:
        """Adds signatures of the sets ``todo``; returns those that need another seed."""
        place = np.full(len(self.sizes), -1, np.int64)
        place[todo] = np.arange(len(todo))
        mine = place[self.owner] >= 0
        x, at = self.values[mine], place[self.owner[mine]]
        cells = n1 * n2
        cell = at * cells + ((mix(x ^ seed) >> U64(32)) * U64(cells) >> U64(32)).astype(np.int64)
        total = np.zeros(len(todo) * cells, U64)
        np.add.at(total, cell, mix(x + seed))
        count = np.bincount(cell, minlength=len(total)).reshape(len(todo), n1, n2)
        total = total.reshape(len(todo), n1, n2)
        first = np.arange(n1, dtype=U64)
        blank = np.zeros((len(todo), n1), bool)
        signs, full = [], []
        for k, subset in enumerate(combinations(range(n2), n2 - k2)):
            part = list(subset)
            signs.append(mix(total[:, :, part].sum(2, dtype=U64) ^ mix(seed + first * U64(64) + U64(k))[None, :]))
            full.append(count[:, :, part].sum(2) > 0)
            blank |= ~full[-1]
        signs, full = np.concatenate(signs, 1), np.concatenate(full, 1)
        for i, t in enumerate(todo):
            found[t].append(signs[i][full[i]])
        return todo[n1 - blank.sum(1) < need]


def _each_set(column: pa.Array, n: int):
    raw, offsets = buffers(column)
    for first, last in slices(offsets):
        yield first, last, Sets(raw, offsets[first : last + 1], n)


def fingerprints(texts: DataFrame, n: int) -> DataFrame:
    def each(batch):
        for first, last, s in _each_set(batch.column("text"), n):
            yield [batch.column("doc_id").slice(first, last - first), s.sizes, *s.hashes(), s.sketches()]

    return map_batches(texts, each, "doc_id bigint, n bigint, h1 bigint, h2 bigint, sketch binary")


def signatures(texts: DataFrame, n: int, percent: int) -> DataFrame:
    """sign, doc, pivot: the smallest doc of the batch that has the signature, null for that doc itself."""

    def each(batch):
        docs, signs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        ids = batch.column("doc_id").to_numpy()
        for first, last, s in _each_set(batch.column("text"), n):
            found = s.signatures(percent)
            docs.append(np.repeat(ids[first:last], [len(f) for f in found]))
            signs += [f.view(np.int64) for f in found]
        doc, sign = np.concatenate(docs), np.concatenate(signs)
        order = np.lexsort((doc, sign))
        doc, sign = doc[order], sign[order]
        start = np.flatnonzero(np.r_[True, sign[1:] != sign[:-1]]) if len(sign) else np.zeros(0, np.int64)
        pivot = np.repeat(doc[start], np.diff(np.r_[start, len(sign)]))
        alone = np.zeros(len(sign), bool)
        alone[start] = True
        keep = alone | (doc != pivot)
        yield [sign[keep], doc[keep], pa.array(pivot[keep], mask=alone[keep])]

    return map_batches(texts, each, "sign bigint, doc bigint, pivot bigint")


def _shared(signed: DataFrame) -> DataFrame:
    """sign, doc, pivot of signatures that several documents have; pivots of batches get the pivot of all."""

    def run(batches):
        last, pivot, alone = None, None, False  # of the group that the previous batch ended in
        for batch in batches:
            member = batch.column(2).is_valid()
            if member.true_count:
                yield batch.filter(member)
            sign, doc = (c.to_numpy() for c in batch.filter(pc.invert(member)).columns[:2])
            if not len(sign):
                continue
            same = np.r_[sign[0] == last if last is not None else False, sign[1:] == sign[:-1]]
            start = np.maximum.accumulate(np.where(same, -1, np.arange(len(sign))))
            pivots = np.where(start >= 0, doc[np.maximum(start, 0)], 0 if pivot is None else pivot)
            out = same.copy()
            out[:-1] |= same[1:]
            s, d, p = sign[out], doc[out], pivots[out]
            if same[0] and alone:
                s, d, p = np.r_[last, s], np.r_[pivot, d], np.r_[pivot, p]
            alone = bool(not same[-1])
            last, pivot = sign[-1], pivots[-1]
            yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(d), pa.array(p)], names=["sign", "doc", "pivot"])

    # a signature that a batch's members share needs no further look, so they go to any task
    task = F.when(F.col("pivot").isNull(), F.col("sign")).otherwise(F.xxhash64("doc"))
    return signed.repartition(task).sortWithinPartitions("sign", "doc").mapInArrow(run, "sign bigint, doc bigint, pivot bigint")


def _words(sketch: bytes, bits: int) -> np.ndarray:
    """A sketch folded to so many bits."""
    x = np.frombuffer(sketch, U64)
    while len(x) * 64 > bits:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def _folded(sketches: bytes, size: int, to: int) -> np.ndarray:
    """Sketches of ``size`` bytes each, folded to ``to`` bytes."""
    x = np.frombuffer(sketches, U64).reshape(-1, size // 8)
    while x.shape[1] * 8 > to:
        x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
    return x


def _may_link(na, nb, differ, percent: int):
    total = na + nb
    most = total - 2 * -(-percent * total // (100 + percent))
    return (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & (differ <= most)


def _passing(pairs: DataFrame, prints: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and sketches don't rule out."""

    def each(batch):
        na, nb = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
        sa, sb = (np.array(batch.column(f"sketch_{k}").to_pylist(), object) for k in "ab")
        sizes = np.array([(len(x), len(y)) for x, y in zip(sa, sb, strict=True)], np.int64).reshape(-1, 2)
        differ = np.zeros(len(na), np.int64)
        for la, lb in np.unique(sizes, axis=0):  # powers of two, seven at most
            rows = np.flatnonzero((sizes == (la, lb)).all(1))
            x, y = (_folded(b"".join(v[rows]), n, min(la, lb)) for v, n in ((sa, la), (sb, lb)))
            differ[rows] = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
        rows = batch.filter(pa.array(_may_link(na, nb, differ, percent)))
        yield [rows.column("a"), rows.column("b")]

    side = lambda k: prints.select(F.col("doc_id").alias(f"id_{k}"), F.col("n").alias(f"n_{k}"), F.col("sketch").alias(f"sketch_{k}"))
    rows = pairs.join(side("a"), F.col("a") == F.col("id_a")).join(side("b"), F.col("b") == F.col("id_b"))
    rows = rows.filter((F.least("n_a", "n_b") * 100) >= (F.greatest("n_a", "n_b") * percent)).select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b")
    return map_batches(rows, each, "a bigint, b bigint").distinct()


def _verified(passing: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs whose sets reach the similarity: members b stream past the set of a, which has one a batch at most, and those of its own."""

    def sets(batch):
        for first, last, s in _each_set(batch.column("text"), n):
            yield [batch.column("doc_id").slice(first, last - first), s.elements()]

    def run(batches):
        held, key = [], None
        for batch in batches:
            a, b = (batch.column(k).to_numpy(zero_copy_only=False) for k in "ab")
            pivot, elements = batch.column("kind").to_numpy() == 0, batch.column("elements")
            begin = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (pivot[1:] != pivot[:-1])])
            out = []
            for i, j in zip(begin, np.r_[begin[1:], len(a)], strict=True):
                part = elements.slice(i, j - i)
                if pivot[i]:
                    new = [np.frombuffer(e, U64) for e in part.to_pylist()]
                    held, key = (held if key == a[i] else []) + new, a[i]
                    continue
                data = np.frombuffer(b"".join(part.to_pylist()), U64)
                size = (pc.binary_length(part).to_numpy() // 8).astype(np.int64)
                bounds, ok = np.r_[0, np.cumsum(size)], np.zeros(len(size), bool)
                for mine in held:
                    inside = np.r_[0, np.cumsum(np.isin(data, mine))]
                    both = inside[bounds[1:]] - inside[bounds[:-1]]
                    ok |= 100 * both >= percent * (len(mine) + size - both)
                out.append((a[i:j][ok], b[i:j][ok]))
            if out:
                x, y = (np.concatenate(v).astype(np.int64) for v in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

    chosen, _ = few(passing.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    found = checkpointed(map_batches(texts.join(chosen, F.col("doc_id") == F.col("id"), "left_semi"), sets, "doc_id bigint, elements binary"))
    heads = passing.select("a").distinct().join(found, F.col("a") == F.col("doc_id")).select("a", F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("b"), "elements")
    members = passing.join(found, F.col("b") == F.col("doc_id")).select("a", F.lit(1).alias("kind"), "b", "elements")
    rows = heads.unionByName(members).repartition("a").sortWithinPartitions("a", "kind")
    return rows.mapInArrow(run, "a bigint, b bigint").distinct()


def _forest(comp: np.ndarray, near) -> list[tuple[int, int]]:
    """Edges of a spanning forest over rows, of those that ``near(i, rest)`` finds of rows ``rest`` for row i.

    Rows of one component hang together without an edge. At most one edge for each row.
    """
    rest, out = np.arange(len(comp)), []
    while len(rest):
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            i = todo.pop()
            hit, same = near(i, rest), comp[rest] == comp[i]
            out += [(i, j) for j in rest[hit & ~same]]
            todo.extend(rest[hit | same])
            rest = rest[~(hit | same)]
    return out


def _placed(members: DataFrame, most: int, elements: int | None = None) -> DataFrame:
    """sign, group, side, doc, component of members (sign, doc, component, n) whose sign has several components.

    The component with most members is the main one; its members need not meet each other, only the
    rest. Both sides are cut in blocks of about ``most`` members (and ``elements``), and each pair of a main
    block and a block of the rest, or of two blocks of the rest, is a group of its own.
    """
    sizes = members.groupBy("sign", "component").agg(F.count("*").alias("m"))
    mixed = sizes.groupBy("sign").agg(F.count("*").alias("parts"), F.max_by("component", F.struct("m", "component")).alias("main")).filter("parts > 1")
    rows = members.join(mixed.select("sign", "main"), "sign").withColumn("in_main", F.col("component") == F.col("main"))

    def size(side):
        by = F.sum(F.when(side, 1).otherwise(0)) / F.lit(most)
        if elements is not None:
            by = F.greatest(by, F.sum(F.when(side, F.col("n")).otherwise(0)) / F.lit(elements))
        return F.ceil(by).cast("int")

    blocks = rows.groupBy("sign").agg(size(F.col("in_main")).alias("bm"), size(~F.col("in_main")).alias("bf"))
    rows = rows.join(blocks, "sign")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("doc"), F.when(F.col("in_main"), F.col("bm")).otherwise(F.col("bf"))).cast("int"))
    own, bm, bf = F.col("own"), F.col("bm"), F.col("bf")
    upto = lambda n: F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda x: x < n)
    place = lambda group, side: F.struct(group.cast("bigint").alias("group"), side.cast("int").alias("side"))
    main = F.transform(upto(bf), lambda j: place(own * bf + j, F.lit(-1)))
    other = F.transform(upto(bm), lambda i: place(i * bf + own, F.lit(-2)))
    among = F.transform(upto(bf), lambda j: place(bm * bf + F.least(own, j) * bf + F.greatest(own, j), own))
    return rows.withColumn("at", F.explode(F.when(F.col("in_main"), main).otherwise(F.concat(other, among)))).select("sign", "at.group", "at.side", "doc", "component")


def _by_group(rows: DataFrame, edges) -> DataFrame:
    """Runs ``edges(side, doc, comp, data...)`` on each group (sign, group, then these columns) of ``rows``; it returns pairs of row numbers."""

    def run(batches):
        held, key = [], None

        def flush():
            side, doc, comp, *data = zip(*held, strict=True) if len(held) > 1 else ((), (), ())
            if len(set(comp)) > 1:
                doc = np.array(doc, np.int64)
                pairs = np.array(edges(np.array(side), np.array(comp), *data), np.int64).reshape(-1, 2)
                if len(pairs):
                    yield pa.RecordBatch.from_arrays([pa.array(doc[pairs].min(1)), pa.array(doc[pairs].max(1))], names=["a", "b"])

        for batch in batches:
            for sign, group, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (sign, group) != key:
                    yield from flush()
                    held, key = [], (sign, group)
                held.append(row)
        yield from flush()

    rows = rows.repartition("sign", "group").sortWithinPartitions("sign", "group")
    return rows.mapInArrow(run, "a bigint, b bigint").filter("a < b").distinct()


def _across(members: DataFrame, prints: DataFrame, percent: int) -> DataFrame:
    """Pairs that connect all members (sign, doc, component) of a signature, in different components, that sizes and sketches let link.

    Of the pairs that pass, a block gives a spanning forest only, so rows grow with the members.
    """

    def edges(side, comp, n, sketch):
        bits = 8 * min(len(s) for s in sketch)
        words, n = np.stack([_words(s, bits) for s in sketch]), np.array(n)
        cross = side.min() != side.max()

        def near(i, rest):
            ok = _may_link(n[i], n[rest], np.bitwise_count(words[rest] ^ words[i]).sum(-1, dtype=np.int64), percent)
            return ok & (side[rest] != side[i]) if cross else ok

        if len(n) > 64:
            return _forest(comp, near)
        differ = np.bitwise_count(words[:, None] ^ words[None]).sum(2, dtype=np.int64)
        ok = _may_link(n[:, None], n[None], differ, percent) & (comp[:, None] != comp[None])
        if cross:
            ok &= side[:, None] != side[None]
        return _forest(comp, lambda i, rest: ok[i, rest]) if ok.any() else []

    rows = _placed(members.withColumn("n", F.lit(1)), GROUP)
    rows = rows.join(prints.select(F.col("doc_id").alias("id"), "n", "sketch"), F.col("doc") == F.col("id"))
    return _by_group(rows.select("sign", "group", "side", "doc", "component", "n", "sketch"), edges)


def _joining(near: DataFrame, links: DataFrame, parts: DataFrame, prints: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links, verified on the sets, that join components; ``near`` connects all documents of which two may link.

    What ``near`` and ``links`` connect meets in blocks; a block gives a spanning forest of its links.
    """

    def edges(side, comp, elements):
        ok = _alike(elements, percent)
        if side.min() != side.max():
            ok &= side[:, None] != side[None]
        return _forest(comp, lambda i, rest: ok[i, rest])

    def sets(batch):
        for first, last, s in _each_set(batch.column("text"), words):
            yield [batch.column("doc_id").slice(first, last - first), s.elements()]

    wide = components(near.unionByName(links)).select(F.col("node").alias("doc"), F.col("component").alias("sign"))
    rows = wide.join(parts, F.col("doc") == F.col("node"), "left").select("sign", "doc", F.coalesce("component", "doc").alias("component"))
    size = prints.groupBy(F.col("doc_id").alias("id")).agg(F.sum("n").alias("n"))
    rows = checkpointed(rows.join(size, F.col("doc") == F.col("id")).drop("id"))
    rows = checkpointed(_placed(rows, COUNT_MEMBERS, COUNT_ELEMENTS))
    chosen, _ = few(rows.select(F.col("doc").alias("id")).distinct())
    found = map_batches(texts.join(chosen, F.col("doc_id") == F.col("id"), "left_semi"), sets, "doc_id bigint, elements binary")
    rows = rows.join(found, F.col("doc") == F.col("doc_id"))
    return _by_group(rows.select("sign", "group", "side", "doc", "component", "elements"), edges)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")


def _salts(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _found(texts: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, n, h1, h2, salt, component_id for every row of ``texts``."""
    prints = checkpointed(fingerprints(texts, words))
    known = prints.filter("n > 0 and doc_id is not null")
    copies = checkpointed(known.groupBy(*KEYS).agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("top")).filter("rep < top").drop("top"))
    salted = prints.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    one = F.struct(*KEYS)
    # ids with several sets sign them all: of a copy's id only the copied set could be left to the representative
    several, _ = few(known.groupBy(F.col("doc_id").alias("node")).agg((F.min(one) != F.max(one)).alias("several")).filter("several").select("node"))
    extra = salted.join(_salts(copies), [*KEYS, "salt"]).filter("doc_id != rep").select(F.col("doc_id").alias("id"))
    extra, _ = few(extra.join(several, F.col("id") == F.col("node"), "left_anti"))
    signed = signatures(texts.filter("doc_id is not null").join(extra, F.col("doc_id") == F.col("id"), "left_anti"), words, percent)
    members = checkpointed(_shared(signed))
    stars = members.filter("doc != pivot").select(F.col("pivot").alias("a"), F.col("doc").alias("b")).distinct()
    links = checkpointed(_verified(checkpointed(_passing(stars, known, percent)), texts, words, percent))
    parts = checkpointed(components(links))
    named = members.join(parts, F.col("doc") == F.col("node"), "left").withColumn("component", F.coalesce("component", "doc"))
    more = checkpointed(_across(named.select("sign", "doc", "component"), known, percent))
    if not more.isEmpty():
        further = checkpointed(_joining(more, links, parts, known, texts, words, percent))
        if not further.isEmpty():
            parts = checkpointed(components(links.unionByName(further)))
    by_rep = copies.join(parts, F.col("rep") == F.col("node"), "left").select(*KEYS, F.coalesce("component", "rep").alias("of_copy"))
    out = salted.join(_salts(by_rep), [*KEYS, "salt"], "left").join(parts, F.col("doc_id") == F.col("node"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("of_copy", "component", "doc_id"))
    return out.select("doc_id", *KEYS, "salt", component.alias("component_id"))


def join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``."""
    return _found(_texts(docs), words, percent).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def _alike(elements: list[bytes], percent: int) -> np.ndarray:
    """Which sets of a group reach the similarity with which."""
    n = np.array([len(e) // 8 for e in elements], np.int64)
    m, owner = len(n), np.repeat(np.arange(len(n)), n)
    _, which, times = np.unique(np.frombuffer(b"".join(elements), U64), return_inverse=True, return_counts=True)
    both = np.zeros((m, m), np.int64)
    # elements that few sets hold: each pair of their holders
    few = times[which] <= m // 8
    order = np.flatnonzero(few)[np.argsort(which[few], kind="stable")]
    held, by = which[order], owner[order]
    for step in range(1, int(times[held].max(initial=1))):
        same = np.flatnonzero(held[step:] == held[:-step])
        np.add.at(both, (by[same], by[same + step]), 1)
    both += both.T
    # the others: products of incidence matrices
    many = (times > max(1, m // 8)) & (times < m)
    column = np.where(many, np.cumsum(many) - 1, -1)[which]
    for low in range(0, int(many.sum()), 4096):
        here = (column >= low) & (column < low + 4096)
        part = np.zeros((m, min(4096, int(many.sum()) - low)), np.float32)
        part[owner[here], column[here] - low] = 1
        both += (part @ part.T).astype(np.int64)
    both += int((times == m).sum())
    return 100 * both >= percent * (n[:, None] + n[None, :] - both)


def _links(side: np.ndarray, cross: bool, weight: np.ndarray, elements: list[bytes], percent: int) -> np.ndarray:
    """For each set of a group the weights of the others, of the other side if ``cross``, that link with it."""
    ok = _alike(elements, percent)
    ok &= side[:, None] != side[None, :] if cross else ~np.eye(len(side), dtype=bool)
    return ok @ weight


def _counted(classes: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """h1, h2, n, others (rows of other sets that link) of the sets in components of several sets.

    A component is cut in blocks; each block, and each pair of blocks, is a group of its own.
    """
    blocks = F.ceil(F.greatest(F.count("*") / F.lit(COUNT_MEMBERS), F.sum("n") / F.lit(COUNT_ELEMENTS))).cast("int")
    several = _salts(classes.groupBy("component").agg(F.count("*").alias("m"), blocks.alias("blocks")).filter("m > 1").drop("m"))
    members = checkpointed(classes.withColumn("salt", F.pmod(F.xxhash64(*KEYS), F.lit(SALTS)).cast("int")).join(several, ["component", "salt"]).drop("salt"))

    def sets(batch):
        for _, _, s in _each_set(batch.column("text"), words):
            yield [*s.hashes(), s.sizes, s.elements()]

    def run(batches):
        held, key = [], None

        def flush():
            if held:
                distinct = list({row[2:5]: row for row in held}.values())  # rows that repeat a doc_id
                side, cross, h1, h2, n, weight, elements = zip(*distinct, strict=True)
                counts = _links(np.array(side), cross[0], np.array(weight, np.int64), list(elements), percent)
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (h1, h2, n, counts)], names=["h1", "h2", "n", "others"])

        for batch in batches:
            for component, group, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (component, group) != key:
                    yield from flush()
                    held, key = [], (component, group)
                held.append(tuple(row))
        yield from flush()

    chosen, _ = few(members.select(F.col("rep").alias("id")).distinct())
    found = map_batches(texts.join(chosen, F.col("doc_id") == F.col("id"), "left_semi"), sets, "h1 bigint, h2 bigint, n bigint, elements binary")
    own = F.pmod(F.xxhash64(F.lit(1), *KEYS), F.col("blocks")).cast("int")
    group = F.least("side", "other").cast("bigint") * F.col("blocks") + F.greatest("side", "other")
    rows = members.withColumn("side", own).join(found, KEYS).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("component", group.alias("group"), "side", (F.col("side") != F.col("other")).alias("cross"), *KEYS, "weight", "elements").repartition("component", "group").sortWithinPartitions("component", "group")
    return rows.mapInArrow(run, "h1 bigint, h2 bigint, n bigint, others bigint").groupBy(*KEYS).agg(F.sum("others").alias("others"))


def linked(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links for every row of ``docs``.

    n_links counts the other rows with a doc_id whose sets reach the similarity, equal sets included.
    """
    texts = _texts(docs)
    found = checkpointed(_found(texts, words, percent))
    known = found.filter("n > 0 and doc_id is not null")
    classes = checkpointed(known.groupBy(*KEYS).agg(F.min("doc_id").alias("rep"), F.count("*").alias("weight"), F.min("component_id").alias("component")))
    others = _counted(classes, texts, words, percent)
    n_links = F.col("weight") - 1 + F.coalesce("others", F.lit(0))
    counts = checkpointed(classes.join(others, KEYS, "left").select(*KEYS, n_links.alias("n_links")).filter("n_links > 0"))
    out = found.join(_salts(counts), [*KEYS, "salt"], "left")
    n_links = F.when(F.col("doc_id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(0)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", n_links.alias("n_links"))



def distinct(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, all columns, without those that link to a smaller id; the longest of rows that repeat a doc_id.

    Rows without doc_id all stay.
    """
    node, row = unused(docs, "node", "row")
    found = checkpointed(join(docs, words, percent))
    gone, _ = few(found.filter("doc_id != component_id").select(F.col("doc_id").alias(node)).distinct())
    again, repeated = few(found.filter("doc_id is not null").groupBy(F.col("doc_id").alias(node)).count().filter("count > 1").select(node))
    doc_id = F.col("doc_id").cast("bigint")
    kept = docs.join(gone, doc_id == F.col(node), "left_anti")
    if not repeated:
        return kept
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    once = kept.join(again, doc_id == F.col(node), "left_semi").groupBy(doc_id.alias(node)).agg(F.max_by(whole, F.struct(F.length("text"), F.col("text"))).alias(row))
    return kept.join(again, doc_id == F.col(node), "left_anti").unionByName(once.select(f"{row}.*"))
