"""Whether two tables hold the same rows, and how rows fall into batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions import chars
from marlstone.functions.order import batched
from marlstone.types import quoted, split


def differences(left: DataFrame, right: DataFrame, order: str) -> DataFrame:
    """column_name, rows, differing: rows of both tables matched by ``order``, compared column by column."""
    if sorted(left.columns) != sorted(right.columns):
        raise ValueError("the tables have other columns")
    values = [c for c in left.columns if c != order]
    a = left.select(F.col(quoted(order)).alias("__k"), *[F.col(quoted(c)).alias(f"a{i}") for i, c in enumerate(values)])
    b = right.select(F.col(quoted(order)).alias("__q"), *[F.col(quoted(c)).alias(f"b{i}") for i, c in enumerate(values)])
    both = a.join(b, F.col("__k").eqNullSafe(F.col("__q")), "full")
    differ = {c: ~F.col(f"a{i}").eqNullSafe(F.col(f"b{i}")) for i, c in enumerate(values)} | {order: ~F.col("__k").eqNullSafe(F.col("__q"))}
    flat = both.agg(F.count("*").alias("rows"), *[F.coalesce(F.sum(e.cast("bigint")), F.lit(0).cast("bigint")).alias(f"d{i}") for i, e in enumerate(differ.values())])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col("rows"), F.col(f"d{i}").alias("differing")) for i, c in enumerate(differ)])
    return flat.select(F.explode(rows).alias("r")).select("r.*")


def batch_meta(df: DataFrame, order: str, size: int) -> DataFrame:
    """column_name, batch, start_row, row_count, uncompressed_size: 8 bytes a number; bytes and 4 a text."""
    ints, texts = split(df)
    sizes = [F.struct(F.lit(c).alias("column_name"), F.lit(8).cast("bigint").alias("bytes")) for c in ints]
    sizes += [F.struct(F.lit(c).alias("column_name"), (chars.size(quoted(c)) + 4).alias("bytes")) for c in texts]
    sums = [F.sum(s["bytes"]).alias(f"s{i}") for i, s in enumerate(sizes)]
    per = batched(df, order, size).groupBy("batch").agg(F.min("rn").alias("start_row"), F.count("*").alias("row_count"), *sums)
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"s{i}").alias("uncompressed_size")) for i, c in enumerate([*ints, *texts])])
    return per.select("batch", "start_row", "row_count", F.explode(rows).alias("r")).select("r.column_name", "batch", "start_row", "row_count", "r.uncompressed_size")
