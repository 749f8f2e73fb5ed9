"""Dense row numbers without gathering all rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one bucket of the ordering holds, about.
ROWS = 1_000_000


def ordinal(df: DataFrame, key: str, out: str = "rn", rows: int = ROWS) -> DataFrame:
    """``df`` with the number (from 0) of each row in order of ``key``, a number with few ties.

    Quantiles of the key cut the rows in buckets; buckets are numbered in parallel, and the sizes of
    the buckets before it (one row each) move each bucket to its place.
    """
    n = df.count()
    pieces = -(-n // rows) if n else 1
    bounds = df.approxQuantile(key, [i / pieces for i in range(1, pieces)], 0.1 / pieces) if pieces > 1 else []
    bounds = sorted(set(bounds))
    bucket = F.coalesce(sum((F.when(F.col(key) > b, 1).otherwise(0) for b in bounds), F.lit(0)), F.lit(0)) if len(bounds) < 64 else F.size(F.filter(F.lit(bounds), lambda b: b < F.col(key)))
    placed = df.withColumn("__bucket", bucket)
    inside = F.row_number().over(Window.partitionBy("__bucket").orderBy(key)) - 1
    if not bounds:
        return placed.withColumn(out, inside.cast("bigint")).drop("__bucket")
    sizes = sorted((r["__bucket"], r["count"]) for r in placed.groupBy("__bucket").count().collect())
    ahead, start = [], 0
    for b, size in sizes:
        ahead += [F.lit(b), F.lit(start).cast("bigint")]
        start += size
    return placed.withColumn(out, inside.cast("bigint") + F.create_map(*ahead)[F.col("__bucket")]).drop("__bucket")


def batched(df: DataFrame, key: str, size: int, rn: str = "rn", out: str = "batch") -> DataFrame:
    """Row numbers, and the number of the batch of ``size`` rows that each row falls in."""
    return ordinal(df, key, rn).withColumn(out, F.floor(F.col(rn) / size).cast("bigint"))
