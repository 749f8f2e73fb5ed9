"""Mixing sources to target weights by entropy balancing.

Targets: sources in order of code points (null last) weigh 1, 2, 3, repeating, and share all
words; a target stops at ``cap`` times its source's size and the excess is shared again by
weight. Rates: among all rates r between 0 and ``cap`` whose words meet the targets, the ones
nearest to 1 in relative entropy are r = min(cap, exp(t * size)), one multiplier t for each
source. Newton's method solves the convex dual for t: each iteration is one distributed
aggregate over the exact table (source, size, documents), at the Newton step and at some points of the
bracket, which is halved where a Newton step leaves it. Sums are integers in units of 2**-30, so their order doesn't matter and
reruns agree.

Rounding: within a source, rows stand in order of size, then of a bucket, then of doc_id and of a hash of
the row, and row i gets the whole numbers between the running sums of rates before and after it.
Neighbours differ little in size, so a source's words miss its target by about one document; of
``PHASES`` starting points of the running sum, the one that misses least is taken. Running sums start
from the table of cells (source, size, bucket), so no task sorts a whole source; a cell of one source and
size has a bucket for each ``BUCKET_ROWS`` of its rows, by a hash of the row.

Only the table of sources is gathered on the driver (one row each; more than ``MAX_SOURCES`` is
an error, nothing is dropped).

Defined cases: null texts have size 0 and are never taken; a null source is a source of its own;
a source without words has target 0; an empty table gives an empty result; rows that repeat a
doc_id, or have none, are separate documents; rows that are equal in all columns may change places;
a text of any length is counted in blocks; if Newton's method doesn't reach the targets, that is an error; ``mix``
ignores other columns, ``apply`` keeps them.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.session import checkpointed, few, map_batches, unused
from marlstone.llm.words import SPACE, Alphabet, Words, buffers, slices

CAP = 3
MAX_SOURCES = 100_000
BUCKET_ROWS = 500
PHASES = 16
_UNIT = 1 << 30
_ROUNDS = 200


def row_keys(docs: DataFrame) -> list:
    """A 128-bit hash of all columns of a row, in two columns."""
    plain = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    nulls = F.concat(*[F.when(c.isNull(), "1").otherwise("0") for c in plain])
    return [F.xxhash64(F.lit(i), nulls, *plain) for i in range(2)]


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, r1, r2 (hash of the row), size: words of every text."""

    def count(batch):
        raw, offsets = buffers(batch.column("text"))
        alphabet = Alphabet(SPACE, lower=False)
        for first, last in slices(offsets):
            part = batch.slice(first, last - first)
            yield [*(part.column(k) for k in names), Words(raw, offsets[first : last + 1], alphabet).counts]

    names = ["doc_id", "source", "r1", "r2"]
    r1, r2 = row_keys(docs)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), r1.alias("r1"), r2.alias("r2"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, count, "doc_id bigint, source string, r1 bigint, r2 bigint, size bigint")


def targets(size_of: dict[str | None, int], weights=(1, 2, 3), cap: int = CAP) -> dict[str | None, float]:
    """Words to take from each source."""
    order = sorted(size_of, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_ = float(sum(size_of.values())), list(order)
    target = dict.fromkeys(order, 0.0)
    while open_ and left > 0:
        share = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * share > cap * size_of[s]]
        if not full:
            target |= {s: weight[s] * share for s in open_}
            break
        for s in full:
            target[s] = float(cap * size_of[s])
        left -= sum(target[s] for s in full)
        open_ = [s for s in open_ if s not in set(full)]
    return target


def _rate(t, size, scale):
    """min(cap, exp(t * size / scale)) in whole units."""
    return F.floor(F.least(F.lit(float(CAP)), F.exp(F.least(t * size / scale, F.lit(2.0)))) * F.lit(float(_UNIT)) + F.lit(0.5)).cast("bigint")


def _table(spark, rows: dict, schema: str) -> DataFrame:
    """Values for each source; at most MAX_SOURCES rows, so it may be broadcast."""
    return F.broadcast(spark.createDataFrame([(s, *v) for s, v in rows.items()], schema))


def _points(t: float, low: float, high: float) -> list[float]:
    """Where to evaluate the dual at once: the Newton step, and points around it or in the bracket."""
    if math.isfinite(low + high):
        more = [low + (high - low) * k / 4 for k in (1, 2, 3)]
    else:
        more = [t + d * (1 + abs(t)) for d in (-4.0, -1.0, -0.25, 0.25, 1.0, 4.0)]
    return sorted({t, *(x for x in more if low < x < high)})


def tilts(cells: DataFrame, size_of: dict, target: dict) -> dict[str | None, tuple[float, float]]:
    """For each source (t, scale): the root of the dual's gradient."""
    spark = cells.sparkSession
    state = {}  # source: [t, low, high], of sources whose rates aren't fixed
    for s, n in size_of.items():
        if n and target[s] < CAP * n:
            state[s] = [0.0, -math.inf, math.inf]
    done: dict = {s: (math.inf if n and target[s] > 0 else 0.0, 1.0) for s, n in size_of.items() if s not in state}
    words = F.col("size") * F.col("docs")
    mean = F.sum(F.col("size") * words) / F.greatest(F.sum(words), F.lit(1))  # size of a word's document
    scale = {r["source"]: max(1.0, float(r["s"])) for r in cells.groupBy("source").agg(mean.alias("s")).collect()}
    for _ in range(_ROUNDS):
        if not state:
            break
        now = {s: _points(*v) for s, v in state.items()}
        table = F.broadcast(spark.createDataFrame([(s, t, scale[s]) for s, ts in now.items() for t in ts], "s string, t double, scale double"))
        rate = _rate(F.col("t"), F.col("size"), F.col("scale"))
        words = (F.col("size") * F.col("docs")).cast("decimal(38,0)")
        slope = F.when(rate < CAP * _UNIT, F.floor(rate * F.col("size") / F.col("scale"))).otherwise(0).cast("decimal(38,0)")
        got = cells.join(table, F.col("source").eqNullSafe(F.col("s"))).groupBy("s", "t").agg(F.sum(words * rate).cast("decimal(38,0)").alias("f"), F.sum(words * slope).cast("decimal(38,0)").alias("g")).collect()
        best: dict = {}  # source: (miss, t, slope) of the point nearest to the target
        for r in got:
            s, t, f, g = r["s"], r["t"], float(r["f"]) / _UNIT, float(r["g"]) / _UNIT
            miss = target[s] - f
            if miss > 0:
                state[s][1] = max(state[s][1], t)
            else:
                state[s][2] = min(state[s][2], t)
            if s not in best or (abs(miss), t) < (abs(best[s][0]), best[s][1]):
                best[s] = (miss, t, g)
        for s, (miss, t, g) in best.items():
            _, low, high = state[s]
            if abs(miss) <= 1e-7 * target[s] or (high - low) <= 1e-13 * max(1.0, abs(t)):
                done[s] = (t, scale[s])
                del state[s]
                continue
            step = t + miss / g if g > 0 else math.nan
            if not low < step < high:
                step = (low + high) / 2 if math.isfinite(low + high) else (t * 2 + 1 if miss > 0 else t * 2 - 1)
            state[s][0] = step
    if state:
        raise ArithmeticError(f"no rates meet the targets of {sorted(map(str, state))[:5]}")
    return done


def mix(docs: DataFrame, weights=(1, 2, 3)) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of ``docs``."""
    return _taken(docs, weights).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("bigint").alias("taken"))


def _taken(docs: DataFrame, weights) -> DataFrame:
    """doc_id, r1, r2, size, source_size, target, copies for every row of ``docs``."""
    rows = checkpointed(sizes(docs))
    by_size = checkpointed(rows.groupBy("source", "size").agg(F.count("*").alias("docs")))
    totals = by_size.groupBy("source").agg(F.sum(F.col("size") * F.col("docs")).alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    size_of = {r["source"]: int(r["n"]) for r in totals}
    target = targets(size_of, weights)
    tilt = tilts(by_size, size_of, target)
    large, _ = few(by_size.filter(F.col("docs") > BUCKET_ROWS).select(F.col("source").alias("s"), F.col("size").alias("z"), F.ceil(F.col("docs") / BUCKET_ROWS).alias("buckets")))
    bucket = F.pmod(F.xxhash64("doc_id", "r1"), F.coalesce("buckets", F.lit(1))).cast("int")
    rows = rows.join(large, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")), "left").select("doc_id", "source", "r1", "r2", "size", bucket.alias("bucket"))
    per_source = _table(docs.sparkSession, {s: (float("inf") if math.isinf(tilt[s][0]) else tilt[s][0], tilt[s][1], size_of[s], target[s], target[s] >= CAP * size_of[s]) for s in size_of}, "s string, t double, scale double, source_size bigint, target double, full boolean")
    rate = F.when(F.col("target") == 0, F.lit(0)).when(F.col("full"), F.lit(CAP * _UNIT)).otherwise(_rate(F.col("t"), F.col("size"), F.col("scale"))).cast("bigint")
    # running sums of rates: over sizes within a source, over buckets within a cell, then over rows
    sized = by_size.join(per_source, F.col("source").eqNullSafe(F.col("s"))).select("source", "size", "docs", rate.alias("rate"), "source_size", "target")
    before_size = F.coalesce(F.sum((F.col("docs") * F.col("rate")).cast("decimal(38,0)")).over(Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sized = sized.select(F.col("source").alias("s"), F.col("size").alias("z"), "rate", "source_size", "target", before_size.cast("decimal(38,0)").alias("before_size"))
    before_bucket = F.coalesce(F.sum("docs").over(Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = rows.groupBy("source", "size", "bucket").agg(F.count("*").alias("docs"))
    starts = (
        cells.select("source", "size", "bucket", before_bucket.alias("ahead"))
        .join(sized, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")))
        .select("s", "z", F.col("bucket").alias("b"), "ahead", "rate", "before_size", "source_size", "target")
    )
    rank = F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy("doc_id", "r1", "r2"))
    ranked = rows.withColumn("rank", rank.cast("bigint"))
    placed = ranked.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("bucket") == F.col("b")))
    # all that matters of the running sum before a row is its part below one copy
    at = F.expr(f"cast((before_size + cast((ahead + rank - 1) * rate as decimal(38,0))) % {_UNIT}BD as bigint)")
    placed = checkpointed(placed.select("doc_id", "r1", "r2", "source", "size", "source_size", "target", "rate", at.alias("at")))
    best = _phases(placed, target)
    out = placed.join(_table(docs.sparkSession, {s: (u,) for s, u in best.items()}, "s string, phase bigint"), F.col("source").eqNullSafe(F.col("s")))
    return out.select("doc_id", "r1", "r2", "size", "source_size", "target", _copies(F.col("phase")).alias("copies"))


def apply(docs: DataFrame, weights=(1, 2, 3)) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as ``mix`` takes it.

    Rows without words are never taken. Rows that are equal in all columns share their copies.
    """
    r1, r2, times, copy, q1, q2 = unused(docs, "r1", "r2", "times", "copy", "q1", "q2")
    taken = _taken(docs, weights).filter("size > 0").groupBy(F.col("r1").alias(q1), F.col("r2").alias(q2))
    taken = checkpointed(taken.agg(F.sum("copies").cast("int").alias(times), F.count("*").alias(copy)).filter(F.col(times) > 0))
    keys = row_keys(docs)
    rows = docs.withColumns({r1: keys[0], r2: keys[1]})
    one = rows.join(taken.filter(F.col(copy) == 1).drop(copy), (F.col(r1) == F.col(q1)) & (F.col(r2) == F.col(q2))).drop(q1, q2)
    again, n = few(taken.filter(F.col(copy) > 1).drop(copy))
    if n:  # equal rows become one, which is combined before the shuffle, and stands for all their copies
        whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        equal = rows.join(again, (F.col(r1) == F.col(q1)) & (F.col(r2) == F.col(q2))).groupBy(r1, r2, times).agg(F.first(whole).alias(copy))
        one = one.unionByName(equal.select(r1, r2, times, f"{copy}.*"))
    return one.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*[F.col(f"`{c}`") for c in docs.columns])


def _copies(phase):
    """Whole numbers between the running sums before and after a document, both moved by ``phase``."""
    below = (F.col("at") + phase) % F.lit(_UNIT) + F.col("rate") % F.lit(_UNIT)
    return F.shiftright("rate", 30) + F.when(below >= _UNIT, 1).otherwise(0)


def _phases(placed: DataFrame, target: dict) -> dict:
    """For each source the phase, of ``PHASES`` evenly spaced ones, whose words are nearest to the target."""
    phases = [_UNIT * k // PHASES for k in range(PHASES)]
    sums = placed.groupBy("source").agg(*[F.sum(F.col("size") * _copies(F.lit(u))).alias(f"w{k}") for k, u in enumerate(phases)]).collect()
    return {r["source"]: min(phases, key=lambda u, r=r: abs(r[f"w{u * PHASES // _UNIT}"] - target[r["source"]])) for r in sums}
