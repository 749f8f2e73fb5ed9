"""Substring deduplication by level-wise doubling of word windows.

A window of ``window`` words that starts at two places makes every word it covers repeated. Windows
are found level by level (9, 18 and 35 words): only where windows of one length repeat are they
extended to twice that length, until ``window`` is reached or no candidate survives.

Level 0 need not look at every short window. Of the short windows inside a long one, the one with
the smallest hash is the same in every copy of the long one; only these anchors, about a tenth of all
positions, are counted. The window of the next level reaches beyond its anchor on both sides by as
much as a copy of the long window is sure to hold, so every level but the last has one window for each
anchor. These levels use 64-bit hashes, where a collision costs a vain extension; the last level takes every
window whose anchor survived and decides on 128 bits.

Counting. A window repeats if it has two places; places in texts that are equal throughout count as one.
The windows of an anchor hold one another, so equal ones of level 1 lie where their level 0 was sent: one
exchange, by the shortest window, serves both. Of a short window that a task meets often, in ever other
surroundings, it sends ``OFTEN`` rows there and spreads the others; all rows of such a window are sent once
more, by their window of level 1. A task remembers the windows it has
met: it sends one row of a window when it meets it first and one when it meets it again, and settles all
further ones itself, so a passage that a third of all documents hold makes a few rows for each task.
What is settled travels as runs of places and takes no part in counts.
Documents whose words are equal throughout are settled by a fingerprint: every word of them is
repeated, and one of them takes part in the last level for the others.

Rows are told apart by a 128-bit hash of id and text. Texts are shuffled once, by that key, and the
last level and the result share the exchange; the levels before read them where they lie.

Defined cases: a null text has no words; texts of fewer words than a window keep all; equal rows are
copies of each other; rows that repeat a doc_id, or have none, are documents of their own; a text of any
length is hashed in blocks, but its words (8 bytes each) stand in memory together; windows that tie are all
removed; an empty table gives an empty result; other columns are ignored.

``cut`` returns the texts that stay and the spans of words that go; ``digest`` makes counts and hashes of them.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.session import checkpointed, map_batches
from marlstone.llm.words import SPACE, U64, Alphabet, Words, buffers, mix, slices, windows

WINDOW = 35
#: The shortest windows have at most so many words; shorter ones repeat by chance in any large corpus.
BASE = 9
SALTS = 16
#: Rows of one shortest window that a task sends to one place.
OFTEN = 32
#: Bytes of texts that are counted together before the shuffle.
SLICE = 4 << 20
_ALPHABET = Alphabet(SPACE, lower=False)
KEY = ["k1", "k2"]
CUT = "doc_id bigint, n_words bigint, removed array<struct<start:int,stop:int>>, kept string"


def ladder(window: int) -> list[int]:
    """Window lengths of the levels, each at most twice the one before."""
    out = [window]
    while out[0] > BASE:
        out.insert(0, -(-out[0] // 2))
    return out


def reach(lengths: list[int]) -> list[int]:
    """How many words before its anchor the window of each level but the last begins."""
    out = [0] if len(lengths) > 1 else []
    for a, b in zip(lengths, lengths[1:-1], strict=False):
        out.append(out[-1] + (b - a) // 2)
    return out


def _sliding(x: np.ndarray, n: int, op) -> np.ndarray:
    """op over each run of n values."""
    if len(x) < n:
        return x[:0]
    done = 1
    while done < n:
        step = min(done, n - done)
        x = op(x[: len(x) - step], x[step:])
        done += step
    return x


def _second(hashes: np.ndarray, n: int) -> np.ndarray:
    return windows(mix(hashes ^ U64(0xABCDEF0123456789)), n)


def _inside(owner: np.ndarray, n: int) -> np.ndarray:
    """Whether a window of n words that starts at each word ends in the same text."""
    return owner[: len(owner) - n + 1] == owner[n - 1 :] if len(owner) >= n else np.zeros(0, bool)


def _least(hashes: np.ndarray, owner: np.ndarray, lengths: list[int]) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes of the shortest windows, the least of those that may be anchors of the long window at each word (0: none), and how many these are."""
    left, span = reach(lengths)[-1], lengths[-1] - lengths[-2] + 1
    short, inside = windows(hashes, lengths[0]), _inside(owner, lengths[-1])
    return short, np.where(inside, _sliding(short[left:], span, np.minimum)[: len(inside)], U64(0)), span


def _anchors(hashes: np.ndarray, owner: np.ndarray, lengths: list[int]) -> np.ndarray:
    """The words at which anchors start."""
    short, least, span = _least(hashes, owner, lengths)
    left, pad = reach(lengths)[-1], np.zeros(span - 1, U64)
    top = _sliding(np.r_[pad, least, pad], span, np.maximum) if len(least) else least  # over all long windows that hold a word
    n = min(len(top), len(short) - left)
    return np.flatnonzero((top[:n] == short[left : left + n]) & (top[:n] > 0)) + left if n > 0 else np.zeros(0, np.int64)


class Seen:
    """The windows a task has met, as two hashes, and whether it has sent two rows of them; forgets all beyond ``LIMIT``."""

    LIMIT = 1 << 22

    def __init__(self):
        self.one, self.two, self.twice = np.zeros(0, U64), np.zeros(0, U64), np.zeros(0, bool)

    def before(self, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where windows stand, and how often they were sent (0, 1, 2)."""
        if not len(self.one):
            return np.zeros(len(one), np.int64), np.zeros(len(one), np.int64)
        at = np.minimum(np.searchsorted(self.one, one), len(self.one) - 1)
        return at, np.where((self.one[at] == one) & (self.two[at] == two), 1 + self.twice[at], 0)

    def add(self, one: np.ndarray, two: np.ndarray, twice: np.ndarray) -> None:
        if len(self.one) + len(one) > self.LIMIT:
            self.__init__()
        one, two, twice = np.r_[self.one, one], np.r_[self.two, two], np.r_[self.twice, twice]
        order = np.argsort(one, kind="stable")
        self.one, self.two, self.twice = one[order], two[order], twice[order]


class Tally:
    """How often a task has met each key; forgets all beyond ``Seen.LIMIT`` keys."""

    def __init__(self):
        self.keys, self.counts = np.zeros(0, U64), np.zeros(0, np.int64)

    def before(self, keys: np.ndarray) -> np.ndarray:
        """How many equal keys came before each of these, which count from now on."""
        if not len(keys):
            return np.zeros(0, np.int64)
        order = np.argsort(keys, kind="stable")
        start = np.flatnonzero(_heads(keys[order]))
        here, first = np.diff(np.r_[start, len(keys)]), keys[order][start]
        at = np.searchsorted(self.keys, first)
        known = np.flatnonzero(at < len(self.keys))
        known = known[self.keys[at[known]] == first[known]]
        met = np.zeros(len(first), np.int64)
        met[known] = self.counts[at[known]]
        out = np.empty(len(keys), np.int64)
        out[order] = np.arange(len(keys)) + np.repeat(met - start, here)
        self.counts[at[known]] += here[known]
        new = np.ones(len(first), bool)
        new[known] = False
        if len(self.keys) + new.sum() > Seen.LIMIT:
            self.__init__()
            at = np.zeros(len(first), np.int64)
        self.keys, self.counts = np.insert(self.keys, at[new], first[new]), np.insert(self.counts, at[new], here[new])
        return out


def _heads(*keys: np.ndarray) -> np.ndarray:
    """Which rows of sorted keys begin a group."""
    out = np.ones(len(keys[0]), bool)
    out[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return out


def _sent(one: np.ndarray, two: np.ndarray, seen: Seen) -> tuple[np.ndarray, np.ndarray]:
    """How many rows each of these windows (one of each place) counts for: 0 is settled, without a row to count.

    Also whether a row is known to repeat.
    """
    order = np.lexsort((two, one))
    head = _heads(one[order], two[order])
    group = np.cumsum(head) - 1
    here = np.bincount(group) if len(order) else np.zeros(0, np.int64)
    first = order[head]
    at, sent = seen.before(one[first], two[first])
    weight = np.zeros(len(one), np.int64)
    weight[first] = np.where(sent == 0, np.minimum(here, 2), np.where(sent == 1, 1, 0))
    again = np.zeros(len(one), bool)
    again[order] = (here + sent > 1)[group]
    seen.twice[at[sent == 1]] = True
    new = sent == 0
    seen.add(one[first][new], two[first][new], here[new] > 1)
    return weight, again


def _runs(text: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """text, first place and length of the runs of places."""
    order = np.lexsort((place, text))
    text, place = text[order], place[order]
    start = np.flatnonzero(_heads(text, place - np.arange(len(place))))
    return text[start], place[start], np.diff(np.r_[start, len(text)])


def _listed(batch: pa.RecordBatch, first: int, last: int, w: Words) -> np.ndarray:
    """Positions in the slice that column ``places`` lists."""
    lists = batch.column("places").slice(first, last - first)
    return (lists.flatten().to_numpy() + np.repeat(w.bounds[:-1], lists.value_lengths().fill_null(0).to_numpy())).astype(np.int64)


def _print(w: Words, place: np.ndarray) -> list[np.ndarray]:
    """A fingerprint of the words of each text, in two numbers."""
    out = []
    for seed in (U64(11), U64(22)):
        run = np.r_[np.zeros(1, U64), np.cumsum(mix(w.hashes ^ mix(place.astype(U64) + seed)))]
        out.append((run[w.bounds[1:]] - run[w.bounds[:-1]]).view(np.int64))
    return out


def prints(rows: DataFrame) -> DataFrame:
    """k1, k2, n (words), f1, f2 (fingerprint) of every row."""

    def each(batch):
        raw, offsets = buffers(batch.column("text"))
        for first, last in slices(offsets, SLICE):
            w = Words(raw, offsets[first : last + 1], _ALPHABET)
            owner = w.owner()
            part = batch.slice(first, last - first)
            yield [part.column("k1"), part.column("k2"), w.counts, *_print(w, np.arange(len(owner)) - w.bounds[owner])]

    return map_batches(rows.select(*KEY, "text"), each, "k1 bigint, k2 bigint, n bigint, f1 bigint, f2 bigint")


def anchors(rows: DataFrame, lengths: list[int]) -> DataFrame:
    """f1, place, a hash for each level but the last, settled (the task knows that the window repeats) and often.

    often: the task has met the shortest window ``OFTEN`` times; rows beyond these have a key of their own in its place.
    """
    left = reach(lengths)

    def each(batches):
        seen, firsts, tally = Seen(), Seen(), Tally()
        for batch in batches:
            raw, offsets = buffers(batch.column("text"))
            for first, last in slices(offsets, SLICE):
                w = Words(raw, offsets[first : last + 1], _ALPHABET)
                owner = w.owner()
                place = np.arange(len(owner)) - w.bounds[owner]
                at = _anchors(w.hashes, owner, lengths)
                f1 = _print(w, place)[0][owner[at]]
                hashes = [windows(w.hashes, n)[at - b] for n, b in zip(lengths, left, strict=False)]
                # equal places of equal texts are one place
                longest, where = hashes[-1], mix(f1.view(U64) ^ mix(place[at].astype(U64)))
                order = np.lexsort((where, longest))
                keep = order[_heads(longest[order], where[order])]
                longest, where, f1, at = longest[keep], where[keep], f1[keep], place[at[keep]]
                fresh = firsts.before(longest, where)[1] == 0
                longest, where, f1, at, keep = longest[fresh], where[fresh], f1[fresh], at[fresh], keep[fresh]
                new = _heads(longest) & (seen.before(longest, none := np.zeros(len(keep), U64))[1] == 0)
                firsts.add(longest[new], where[new], new[new])
                weight, settled = _sent(longest, none, seen)
                own = mix(longest ^ where)  # a key of its own where the task has sent the window's
                met = np.zeros(len(keep), np.int64)
                met[weight > 0] = tally.before(hashes[0][keep][weight > 0]) + 1
                apart = [(weight == 0) | (met > OFTEN), *[weight == 0] * (len(left) - 1)]
                yield pa.RecordBatch.from_arrays([pa.array(f1), pa.array(at.astype(np.int32)), *(pa.array(np.where(a, own, h[keep]).view(np.int64)) for a, h in zip(apart, hashes, strict=True)), pa.array(settled), pa.array(met >= OFTEN)], names=names)

    names = ["f1", "place", *(f"h{i}" for i in range(len(left))), "settled", "often"]
    kinds = ["bigint", "int", *["bigint"] * len(left), "boolean", "boolean"]
    return rows.select("text").mapInArrow(each, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))


def _repeated(live: DataFrame, *keys: str) -> DataFrame:
    """The rows whose window, equal in these columns, is known to repeat or has two places."""
    group, place = Window.partitionBy(*keys), F.xxhash64("f1", "place")
    return live.select("*", F.min(place).over(group).alias("least"), F.max(place).over(group).alias("most")).filter("settled or least < most").drop("least", "most")


def candidates(rows: DataFrame, lengths: list[int]) -> DataFrame | None:
    """f1, places of the anchors whose windows repeat on every level but the last; None if there are none."""
    levels = len(lengths) - 1
    live = anchors(rows, lengths).repartition("h0").sortWithinPartitions(*(f"h{i}" for i in range(min(levels, 2))))
    group, place = Window.partitionBy("h0"), F.xxhash64("f1", "place")
    live = live.select("f1", "place", *(f"h{i}" for i in range(levels)), "settled", F.max("often").over(group).alias("often"), F.min(place).over(group).alias("least"), F.max(place).over(group).alias("most"))
    live = live.filter("settled or often or least < most").drop("least", "most")
    if levels > 1:
        # equal windows of level 1 are all in one branch: the second has every row of a shortest window that any task met often
        live = _repeated(live.filter("not often"), "h0", "h1").unionByName(_repeated(live.filter("often"), "h1"))
    live = checkpointed(live.drop("often", "h0", "h1"))
    for i in range(2, levels):
        if live.isEmpty():
            return None
        live = checkpointed(_repeated(live, f"h{i}").drop(f"h{i}"))
    if live.isEmpty():
        return None
    return checkpointed(live.groupBy("f1").agg(F.collect_set("place").alias("places")))


def _last(rows: DataFrame, lengths: list[int]) -> DataFrame:
    """k1, k2, spans (first place and number of places) of the long windows that repeat, of rows with the places of anchors (without these: of all)."""
    window, anchored = lengths[-1], len(lengths) > 1
    names = ["key1", "key2", *KEY, "place", "run", "weight"]

    def each(batches):
        seen = Seen()
        for batch in batches:
            raw, offsets = buffers(batch.column("text"))
            for first, last in slices(offsets, SLICE):
                w = Words(raw, offsets[first : last + 1], _ALPHABET)
                owner = w.owner()
                ok = _inside(owner, window)
                if anchored:
                    places = _listed(batch, first, last, w)
                    short, least, _ = _least(w.hashes, owner, lengths)
                    ok &= np.isin(mix(least ^ mix(owner[: len(least)].astype(U64))), mix(short[places] ^ mix(owner[places].astype(U64))))
                at = np.flatnonzero(ok)
                one, two, text, place = windows(w.hashes, window)[at], _second(w.hashes, window)[at], owner[at], at - w.bounds[owner[at]]
                weight, again = _sent(one, two, seen)
                count, settled = weight > 0, again & (weight == 0)
                t, p, run = _runs(text[settled], place[settled])
                fill = mix(p.astype(U64) ^ mix(t.astype(U64) ^ w.hashes[0])) if len(p) else np.zeros(0, U64)
                pick = pa.array(np.r_[text[count], t] + first)
                columns = [np.r_[one[count], fill].view(np.int64), np.r_[two[count], mix(fill)].view(np.int64)]
                numbers = [np.r_[place[count], p], np.r_[np.ones(count.sum(), np.int64), run], np.r_[weight[count], np.full(len(p), 2)]]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), *(batch.column(k).take(pick) for k in KEY), *(pa.array(x.astype(np.int32)) for x in numbers)], names=names)

    sent = rows.mapInArrow(each, "key1 bigint, key2 bigint, k1 bigint, k2 bigint, place int, run int, weight int")
    sent = sent.withColumn("total", F.sum("weight").over(Window.partitionBy("key1", "key2"))).filter("total > 1")
    return sent.groupBy(*KEY).agg(F.collect_list(F.struct("place", "run")).alias("spans"))


def _covered(batch: pa.RecordBatch, first: int, last: int, bounds: np.ndarray, window: int) -> np.ndarray:
    """Which words of the slice lie in the windows that column ``spans`` lists."""
    lists = batch.column("spans").slice(first, last - first)
    flat = lists.flatten()
    begin = flat.field("place").to_numpy() + np.repeat(bounds[:-1], lists.value_lengths().fill_null(0).to_numpy())
    change = np.zeros(bounds[-1] + 1, np.int64)
    np.add.at(change, begin, 1)
    np.add.at(change, begin + flat.field("run").to_numpy() - 1 + window, -1)
    return np.cumsum(change)[:-1] > 0


def _spans(gone: np.ndarray, bounds: np.ndarray) -> pa.ListArray:
    """The runs of removed words of each text, as places of the first word and of the one after the last."""
    head = np.zeros(len(gone) + 1, bool)
    head[bounds] = True
    start = np.flatnonzero(gone & (head[:-1] | ~np.r_[False, gone[:-1]]))
    stop = np.flatnonzero(gone & (head[1:] | ~np.r_[gone[1:], False])) + 1
    text = np.searchsorted(bounds, start, "right") - 1
    counts = np.r_[0, np.cumsum(np.bincount(text, minlength=len(bounds) - 1))].astype(np.int32)
    places = [pa.array((x - bounds[text]).astype(np.int32)) for x in (start, stop)]
    return pa.ListArray.from_arrays(pa.array(counts), pa.StructArray.from_arrays(places, ["start", "stop"]))


def digest(rows: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row of ``cut``."""
    n_removed = F.aggregate("removed", F.lit(0).cast("bigint"), lambda n, x: n + x["stop"] - x["start"])
    return rows.select("doc_id", "n_words", n_removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row of ``docs``."""
    return digest(cut(docs, window))


def row_keys(doc_id, text) -> list:
    """A 128-bit hash of id and text, in two columns."""
    return [F.xxhash64(F.lit(i), doc_id.isNull(), doc_id, text).alias(k) for i, k in enumerate(KEY)]


def cut(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, removed (spans of words), kept (the other words, joined by spaces) for every row of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select(*row_keys(F.col("doc_id"), F.col("text")), "doc_id", "text")
    lengths = ladder(window)

    table = checkpointed(prints(rows).filter(F.col("n") >= window))
    same = ["f1", "f2", "n"]
    groups = table.groupBy(*same).agg(F.count("*").alias("c"), F.min("k1").alias("rep")).filter("c > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = table.withColumn("salt", F.pmod("k1", F.lit(SALTS)).cast("int"))
    copies = checkpointed(salted.join(groups, [*same, "salt"]).select(*KEY, (F.col("k1") == F.col("rep")).alias("lead")).distinct())
    found = candidates(rows, lengths) if len(lengths) > 1 else None

    by_doc = rows.repartition(*KEY)
    if found is None and len(lengths) > 1:  # no candidate is left
        marked = rows.join(copies.select(*KEY, F.lit(True).alias("copy")), KEY, "left").withColumn("spans", F.lit(None).cast("array<struct<place:int,run:int>>"))
    else:
        # not an anti join: Spark would move that below the exchange, which then could not be shared
        taking = by_doc.join(copies, KEY, "left").filter("lead is null or lead").select(*KEY, "doc_id", "text")
        if found is not None:
            fits = F.filter("places", lambda p: p.cast("bigint") + lengths[0] <= F.col("n"))
            taking = taking.join(table.join(found, "f1").select(*KEY, fits.alias("places")).dropDuplicates(KEY), KEY)
        marked = by_doc.join(copies.select(*KEY, F.lit(True).alias("copy")), KEY, "left").join(_last(taking, lengths), KEY, "left")

    def finish(batch):
        raw, offsets = buffers(batch.column("text"))
        copy = batch.column("copy").fill_null(False).to_numpy(zero_copy_only=False)
        for first, last in slices(offsets, SLICE):
            texts = [raw[offsets[t] : offsets[t + 1]].tobytes().split() for t in range(first, last)]
            counts = np.array([len(t) for t in texts], np.int64)
            bounds = np.r_[0, np.cumsum(counts)]
            gone = _covered(batch, first, last, bounds, window) | np.repeat(copy[first:last], counts)
            kept = []
            for t, words in enumerate(texts):
                part = gone[bounds[t] : bounds[t + 1]]
                kept.append(b" ".join(compress(words, ~part) if part.any() else words))
            yield [batch.column("doc_id").slice(first, last - first), counts, _spans(gone, bounds).to_pylist(), pa.array(kept, pa.binary()).view(pa.string())]

    return map_batches(marked.select("doc_id", "text", "copy", "spans"), finish, CUT)
