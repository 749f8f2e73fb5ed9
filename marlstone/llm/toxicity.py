"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is a short list of insults and what distinguishes toxic texts among the labelled
rows: whole words and word beginnings of 4, 5 and 6 bytes, with their log-odds. The dense features
of a text are its lexicon densities and peaks, the lexicon in spelling with digits and signs for
letters, how near second-person words stand to lexicon words, and rates of capitals, punctuation
and obfuscation. So that no row teaches the lexicon by which the trees see it, the labelled rows
are halved by a hash of doc_id, and each half is described with the lexicon of the other. New texts
get the lexicon of all rows. Calibration is cross-fitted: each of ``FOLDS`` parts of the rows gets margins
from trees that the other parts taught, and the isotonic fit of all labels on these margins
calibrates the trees of all rows.

The sample to learn from is bounded by ``SAMPLE`` labelled ids (of more, those with the smallest
hashes), so its ids are broadcast; of more than twice as many rows, as when documents repeat an id, those with
the smallest hashes of text are taken, so its features may be gathered on the driver. What is
scored is every row; a score needs one pass and no shuffle.

Defined cases: a null text counts as empty and is scored; null labels and labels of unknown
documents are ignored; with one class or none in the sample, the score is its share (0.5 without
rows); repeated rows, and texts that tie, get equal scores; a text of any length is described in blocks; an
empty table gives an empty result; other columns are ignored by ``classify`` and kept by ``clean``; rows
with a null doc_id are scored and never learnt from.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import boost
from marlstone.llm.profile import BAR, DIGIT, LINE, LOWER, OTHER, PUNCT, REST, SHOUT, STOP, SYMBOL, UPPER, class_counts, per_text
from marlstone.llm.quality import SCORES, in_fold
from marlstone.llm.quality import sample as sampled
from marlstone.llm.session import checkpointed, map_batches
from marlstone.llm.words import NOT_ALNUM, U64, Alphabet, Words, buffers, mix, slices

SAMPLE = 40_000
FOLDS = 3
LEXICON = 4096
MIN_DOCS = 3
MIN_ODDS = 1.5
MIN_GAIN = 12.0
THRESHOLD = 0.7
PREFIXES = (4, 5, 6)

# Second-person words of English, German, French and Spanish.
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos tú ti contigo usted ustedes vosotros"
# Common insults.
INSULTS = "idiot moron stupid dumb loser trash scum pathetic worthless disgusting clown imbecile garbage filth vermin idiota estupido estúpido imbécil basura dummkopf abschaum arschloch connard ordure débile"
# Signs read as letters in obfuscated spelling.
SPELLING = dict(zip("0134578@$", "oieastbas", strict=True))

_ALNUM = Alphabet(NOT_ALNUM, lower=True)
_LEET = Alphabet(bytes(b for b in range(128) if not (chr(b).isalnum() or chr(b) in "@$*_-")), lower=True)
_LEET.value = _LEET.value.copy()
for _from, _to in SPELLING.items():
    _LEET.value[ord(_from)] = _ALNUM.value[ord(_to)]


def _hashes(words: str) -> np.ndarray:
    raw, offsets = buffers(pa.array([words]))
    return np.sort(Words(raw, offsets, _ALNUM).hashes)


def _within(values: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which values are in the sorted table, and where."""
    if not len(table):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    bits = np.zeros(1 << 16, bool)
    bits[(table >> U64(48)).astype(np.int64)] = True
    maybe = np.flatnonzero(bits[(values >> U64(48)).astype(np.int64)])
    at = np.minimum(np.searchsorted(table, values[maybe]), len(table) - 1)
    hit, where = np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    same = table[at] == values[maybe]
    hit[maybe[same]], where[maybe[same]] = True, at[same]
    return hit, where


def _beginnings(raw: np.ndarray, w: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Words longer than ``length`` bytes, and a hash of their first ``length`` bytes."""
    long = np.flatnonzero(w.ends - w.starts > length)
    acc = np.full(len(long), length, U64)
    for k in range(length):
        acc = acc * U64(0x100000001B3) + _ALNUM.value[raw[w.starts[long] + k]]
    return long, mix(acc)


def _terms(column: pa.Array):
    """For each slice of a column: text numbers and terms (words and beginnings), distinct by text."""
    raw, offsets = buffers(column)
    for first, last in slices(offsets):
        w = Words(raw, offsets[first : last + 1], _ALNUM, places=True)
        owner = w.owner()
        texts, terms = [owner], [w.hashes]
        for length in PREFIXES:
            long, h = _beginnings(raw, w, length)
            texts.append(owner[long])
            terms.append(h)
        t, h = np.concatenate(texts), np.concatenate(terms)
        order = np.lexsort((h, t))
        t, h = t[order], h[order]
        new = np.r_[True, (h[1:] != h[:-1]) | (t[1:] != t[:-1])] if len(h) else np.zeros(0, bool)
        yield t[new] + first, h[new]


@dataclass
class Lexicon:
    terms: np.ndarray  # sorted hashes
    odds: np.ndarray


FEATURES = 16


def features(column: pa.Array, lexicon: Lexicon) -> np.ndarray:
    raw, offsets = buffers(column)
    second, out = _hashes(SECOND_PERSON), [np.zeros((0, FEATURES))]
    for first, last in slices(offsets):
        off = offsets[first : last + 1]
        c = class_counts(raw, off)
        w = Words(raw, off, _ALNUM, places=True)
        n = np.maximum(w.counts, 1).astype(float)
        size = len(w.hashes)
        chars = np.maximum(c[:, :REST].sum(1), 1)
        odds = np.zeros(size)
        word_hit, at = _within(w.hashes, lexicon.terms)
        odds[word_hit] = lexicon.odds[at[word_hit]]
        begin = np.zeros(size)
        for length in PREFIXES:
            long, h = _beginnings(raw, w, length)
            hit, at = _within(h, lexicon.terms)
            begin[long[hit]] = np.maximum(begin[long[hit]], lexicon.odds[at[hit]])
        best = np.maximum(odds, begin)
        any_hit = best > 0
        owner = w.owner()
        peak = np.zeros(len(n))
        np.maximum.at(peak, owner, best)
        # distance in words from lexicon words to the nearest second-person word of the text
        you = np.flatnonzero(_within(w.hashes, second)[0])
        hits = np.flatnonzero(any_hit)
        near = np.zeros(len(n))
        if len(you) and len(hits):
            k = np.searchsorted(you, hits)
            for side in (np.maximum(k - 1, 0), np.minimum(k, len(you) - 1)):
                same = owner[you[side]] == owner[hits]
                np.maximum.at(near, owner[hits[same]], 1 / (1 + np.abs(you[side] - hits)[same]))
        # obfuscated spelling
        leet = Words(raw, off, _LEET, places=True)
        spelt = _within(leet.hashes, lexicon.terms)[0]
        signs = np.zeros(256, np.int64)
        signs[list(b"0123456789@$*_")] = 1
        marks = np.r_[0, np.cumsum(signs[raw[off[0] : off[-1]]])]
        inside = marks[leet.ends - off[0]] - marks[leet.starts - off[0]]
        mixed = (inside > 0) & (inside < leet.ends - leet.starts)
        shouted = per_text((c_upper(raw, w)).astype(float), w.bounds)
        letters = np.maximum(c[:, LOWER] + c[:, UPPER] + c[:, OTHER], 1)
        out.append(
            np.stack(
                [
                    np.log1p(per_text(odds > 0, w.bounds)),
                    np.log1p(per_text(begin > 0, w.bounds)),
                    np.log1p(per_text(any_hit, w.bounds)),
                    per_text(any_hit, w.bounds) / n,
                    per_text(best, w.bounds) / n,
                    np.log1p(per_text(best, w.bounds)),
                    peak,
                    near,
                    np.log1p(per_text(spelt & mixed, leet.bounds)),
                    per_text(mixed, leet.bounds) / n,
                    c[:, UPPER] / letters,
                    shouted / n,
                    c[:, SHOUT] / chars,
                    (c[:, SYMBOL] + c[:, BAR]) / chars,
                    (c[:, STOP] + c[:, PUNCT]) / chars,
                    np.log1p(w.counts),
                ],
                1,
            )
        )
    return np.concatenate(out)


def c_upper(raw: np.ndarray, w: Words) -> np.ndarray:
    """Words that start and end with capital ASCII letters."""
    a, b = raw[w.starts], raw[np.maximum(w.ends - 1, w.starts)]
    return (a >= 65) & (a <= 90) & (b >= 65) & (b <= 90) & (w.ends - w.starts > 1)


@dataclass
class Model:
    lexicon: Lexicon
    trees: boost.Boosted | None
    knots: tuple[np.ndarray, np.ndarray]

    def score(self, column: pa.Array) -> np.ndarray:
        x = features(column, self.lexicon)
        if self.trees is None:
            return np.full(len(x), self.knots[1][0])
        return np.interp(self.trees.margin(x), *self.knots)


def _term_counts(rows: DataFrame) -> DataFrame:
    """Texts that hold each term, by half of the sample and label; term 0 counts the texts themselves."""

    def each(batch):
        group = 2 * batch.column("half").to_numpy() + batch.column("y").to_numpy()
        for texts, terms in _terms(batch.column("text")):
            order = np.argsort(terms, kind="stable")
            terms, g = terms[order], group[texts][order]
            starts = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1]]) if len(terms) else np.zeros(0, np.int64)
            if len(starts):
                yield [terms[starts].view(np.int64), *(np.add.reduceat((g == k).astype(np.int64), starts) for k in range(4))]
        yield [[0], *([int((group == k).sum())] for k in range(4))]

    counts = map_batches(rows, each, "term bigint, n0 bigint, p0 bigint, n1 bigint, p1 bigint")
    return counts.groupBy("term").agg(*[F.sum(c).alias(c) for c in ("n0", "p0", "n1", "p1")])


def learn_lexicons(rows: DataFrame) -> list[Lexicon]:
    """Lexicons of half 0, of half 1, and of both, each of at most ``LEXICON`` terms."""
    counts = checkpointed(_term_counts(rows).filter(f"term = 0 or p0 + p1 >= {MIN_DOCS}"))
    total = counts.filter("term = 0").collect()
    if not total:
        return [_seeded([])] * 3
    total, out = total[0], []
    for halves in ("0", "1", "01"):
        pos, neg = (sum((F.col(k + h) for h in halves), F.lit(0)) for k in "pn")
        p, n = (float(sum(total[k + h] for h in halves)) for k in "pn")
        share = p / max(p + n, 1)
        odds = F.log((pos + 0.5) / (p + 1)) - F.log((neg + 0.5) / (n + 1))
        side = lambda x, s: F.when(x > 0, x * F.log(x / ((pos + neg) * max(s, 1e-9)))).otherwise(0.0)  # noqa: E731, B023
        gain = 2 * (side(pos, share) + side(neg, 1 - share))
        kept = counts.filter((F.col("term") != 0) & (pos >= MIN_DOCS)).select("term", odds.alias("odds"), gain.alias("gain")).filter(f"odds >= {MIN_ODDS} and gain >= {MIN_GAIN}")
        out.append(_seeded(kept.orderBy(F.desc("gain"), "term").limit(LEXICON).collect()))
    return out


def _seeded(rows) -> Lexicon:
    known = {int(h): 3.0 for h in _hashes(INSULTS)} | {r["term"] % (1 << 64): r["odds"] for r in rows}
    terms = np.array(sorted(known), U64)
    return Lexicon(terms, np.array([known[int(t)] for t in terms]))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> Model:
    """The model of rows of ``docs`` that ``labels`` marks; the caller chooses the rows."""
    h = F.xxhash64(F.lit(78), F.col("doc_id"))
    found = docs.join(sampled(labels, label, sample), F.col("doc_id") == F.col("id"))
    rows = checkpointed(found.select("doc_id", "y", F.pmod(h, F.lit(2)).cast("int").alias("half"), F.pmod(F.shiftrightunsigned(h, 8), F.lit(FOLDS)).cast("int").alias("part"), "text"))
    n = rows.count()
    if n > 2 * sample:
        rows = rows.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int((1 << 30) * 2 * sample / n))
    lexicons = learn_lexicons(rows.select("y", "half", "text"))

    def each(batch):
        half = batch.column("half")
        for k in (0, 1):  # each half by the lexicon of the other
            part = batch.filter(pc.equal(half, k))
            yield [part.column("doc_id"), part.column("y"), part.column("part"), [v.tobytes() for v in features(part.column("text"), lexicons[1 - k])]]

    got = map_batches(rows, each, "doc_id bigint, y int, part int, x binary").collect()
    got.sort(key=lambda r: (r["doc_id"], r["y"], r["x"]))
    x = np.frombuffer(b"".join(r["x"] for r in got), float).reshape(-1, FEATURES)
    y, part = np.array([r["y"] for r in got], float), np.array([r["part"] for r in got])
    if not len(y) or y.min() == y.max():
        return Model(lexicons[2], None, (np.zeros(1), np.array([float(y.mean()) if len(y) else 0.5])))
    return Model(lexicons[2], boost.fit(x, y), boost.isotonic(cross_fitted(x, y, part), y))


def cross_fitted(x: np.ndarray, y: np.ndarray, part: np.ndarray) -> np.ndarray:
    """The margin of each row by trees of the rows of other parts."""
    margin = np.zeros(len(y))
    for k in np.unique(part):
        mine = part == k
        rest = ~mine if not mine.all() else mine
        margin[mine] = boost.fit(x[rest], y[rest]).margin(x[mine])
    return margin


def _training(docs: DataFrame, folds: int | None, fold: int | None) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows if folds is None else rows.filter(~in_fold(F.col("doc_id"), folds, fold))


def classify(docs: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; rows of the fold are never learnt from."""
    model = train(_training(docs, folds, fold), _outside(labels, folds, fold))

    def each(batch):
        p = model.score(batch.column("text"))
        yield [batch.column("doc_id"), batch.column("held_out"), p, (p >= threshold).astype(np.int32)]

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", in_fold(F.col("doc_id"), folds, fold).alias("held_out"))
    return map_batches(rows, each, SCORES)


def _outside(labels: DataFrame, folds: int, fold: int) -> DataFrame:
    return labels.filter(~in_fold(F.col("doc_id"), folds, fold))


def clean(docs: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, that score below the threshold."""
    model = train(_training(docs, folds, fold), _outside(labels, folds, fold))
    names = docs.columns
    at = names.index("text")

    def run(batches):
        for batch in batches:
            p = model.score(batch.column(at))
            yield batch.filter(pa.array(p < threshold))

    return docs.mapInArrow(run, docs.schema)
