"""Connected components of a table of links: of few links, counted first, in one task; else by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import session
from marlstone.llm.session import checkpointed


def _at_once(batches):
    """node, component of all links of the batches: the smaller label of either end, then the label's label, until nothing changes."""
    parts = [[c.to_numpy() for c in batch.columns] for batch in batches]
    if not parts:
        return
    a, b = (np.concatenate(v) for v in zip(*parts, strict=True))
    node, at = np.unique(np.r_[a, b], return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label, seen = np.arange(len(node)), None
    while seen is None or (label != seen).any():
        seen = label.copy()
        least = np.minimum(label[a], label[b])
        for end in (seen[a], seen[b]):
            np.minimum.at(label, end, least)
        label = label[label]
    for i in range(0, len(node), 10_000):
        yield pa.RecordBatch.from_arrays([pa.array(node[i : i + 10_000]), pa.array(node[label[i : i + 10_000]])], names=["node", "component"])


def _large(e: DataFrame) -> DataFrame:
    """Every larger neighbour of a node links to the smallest of node and neighbours."""
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(e: DataFrame) -> DataFrame:
    """A node and its smaller neighbours link to the smallest of them."""
    least = e.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
    near = e.join(least, F.col("a") == F.col("u")).filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return near.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) for every node of links (a, b); links are many-to-many.

    At most ``session.FEW`` links, two numbers each, go to one task. Else each step is two aggregates and two
    joins over the links; hot nodes shrink at once, since a node's neighbours link to its minimum. Stops
    when a round changes nothing.
    """
    e = checkpointed(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct())
    if e.count() <= session.FEW:
        return e.coalesce(1).mapInArrow(_at_once, "node bigint, component bigint")
    seen = None
    while True:
        e = checkpointed(_small(checkpointed(_large(e).distinct())).distinct())
        state = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    pairs = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return pairs.unionByName(roots)
