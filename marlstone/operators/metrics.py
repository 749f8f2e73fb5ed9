"""Whole-table metrics: each is one aggregate over the table, whatever the number of columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import chars, codec
from marlstone.types import INT64, VARCHAR, quoted, split


#: Bytes counted at once: NumPy widens each to eight.
PIECE = 1 << 18


def exact_sum(name: str) -> Column:
    return F.sum(F.col(quoted(name)).cast("decimal(38,0)"))


def _unpivot(df: DataFrame, per_column: dict[str, dict[str, Column]]) -> DataFrame:
    """column_name and values: aggregates all expressions at once, then a row for each column."""
    if not per_column:
        raise ValueError("no column to describe")
    names = list(next(iter(per_column.values())))
    flat = [e.alias(f"v{i}_{k}") for i, v in enumerate(per_column.values()) for k, e in enumerate(v.values())]
    one = df.agg(*flat)
    rows = [F.struct(F.lit(c).alias("column_name"), *[F.col(f"v{i}_{k}").alias(n) for k, n in enumerate(names)]) for i, c in enumerate(per_column)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def int_averages(df: DataFrame) -> DataFrame:
    """column_name, avg_value of INT64 columns; a column without values is left out."""
    ints, _ = split(df)
    each = {c: {"avg_value": exact_sum(c).cast("double") / F.count(quoted(c))} for c in ints}
    return _unpivot(df, {c: {"avg_value": F.when(F.count(quoted(c)) > 0, e["avg_value"])} for c, e in each.items()}).filter("avg_value is not null")


def byte_counts(df: DataFrame) -> DataFrame:
    """column_name, byte, n of VARCHAR columns: how often each byte value occurs.

    The histogram is taken over the bytes of whole Arrow buffers; the built-in way makes a row for
    every character and takes many times as long (figures in the README).
    """
    _, texts = split(df)

    def count(batches):
        total = np.zeros((len(texts), 256), np.int64)
        for batch in batches:
            for i, column in enumerate(batch.columns):
                column = column.drop_null()
                _, offsets, data = column.buffers()
                if data is not None and len(column):
                    off = np.frombuffer(offsets, np.int32 if pa.types.is_string(column.type) else np.int64, len(column) + 1, column.offset * (4 if pa.types.is_string(column.type) else 8))
                    for at in range(off[0], off[-1], PIECE):
                        total[i] += np.bincount(np.frombuffer(data, np.uint8)[at : min(at + PIECE, off[-1])], minlength=256)
        i, c = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(c, pa.int32()), pa.array(total[i, c], pa.int64())], names=["i", "byte", "n"])

    counts = df.select(*[quoted(c) for c in texts]).mapInArrow(count, "i int, byte int, n bigint")
    name = F.element_at(F.array(*[F.lit(c) for c in texts]), F.col("i") + 1)
    return counts.groupBy(name.alias("column_name"), "byte").agg(F.sum("n").alias("n"))


def ascii_char_counts(df: DataFrame) -> DataFrame:
    """column_name, ch, n of VARCHAR columns."""
    return byte_counts(df).filter("byte < 128").select("column_name", F.char("byte").alias("ch"), "n")


def total_ascii(df: DataFrame) -> DataFrame:
    """column_name, total_ascii of VARCHAR columns."""
    _, texts = split(df)
    return _unpivot(df, {c: {"total_ascii": chars.ascii_total(quoted(c))} for c in texts})


def total_ascii_of(df: DataFrame, name: str) -> int | None:
    """The total of one column; None if it is absent or no VARCHAR."""
    if name not in split(df)[1]:
        return None
    return df.agg(chars.ascii_total(quoted(name))).first()[0]


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("row_count"), F.lit(len(df.columns)).cast("bigint").alias("column_count"))


def column_details(df: DataFrame) -> DataFrame:
    """column_name, column_type, row_count of every column."""
    ints, _ = split(df)
    return _unpivot(df, {c: {"column_type": F.lit(INT64 if c in ints else VARCHAR), "row_count": F.count(F.lit(1))} for c in df.columns})


def table_metrics(df: DataFrame) -> DataFrame:
    """For every column: type, rows, average of numbers, ASCII characters of texts."""
    ints, _ = split(df)
    none_d, none_l = F.lit(None).cast("double"), F.lit(None).cast("bigint")
    per = {}
    for c in df.columns:
        number = c in ints
        per[c] = {
            "column_type": F.lit(INT64 if number else VARCHAR),
            "row_count": F.count(F.lit(1)),
            "avg_value": F.when(F.count(quoted(c)) > 0, exact_sum(c).cast("double") / F.count(quoted(c))) if number else none_d,
            "total_ascii": none_l if number else chars.ascii_total(quoted(c)),
        }
    return _unpivot(df, per)


def report(df: DataFrame) -> str:
    """The table's metrics as lines of text."""
    rows = table_metrics(df).collect()
    out = [f"rows: {rows[0]['row_count']}", f"columns: {len(rows)}"]
    for r in sorted(rows, key=lambda r: r["column_name"]):
        what = f"average {r['avg_value']:.2f}" if r["avg_value"] is not None else f"ASCII characters {r['total_ascii']}" if r["column_type"] == VARCHAR else "no values"
        out.append(f"{r['column_name']} ({r['column_type']}): {what}")
    return "\n".join(out)


def table_sums(df: DataFrame) -> DataFrame:
    """column_name, total: sums of numbers, bytes of texts."""
    ints, texts = split(df)
    per = {c: {"total": codec.wrap(F.coalesce(exact_sum(c), F.lit(0).cast("decimal(38,0)")))} for c in ints}
    return _unpivot(df, per | {c: {"total": F.coalesce(F.sum(chars.size(quoted(c))), F.lit(0).cast("bigint"))} for c in texts})


def checksums(df: DataFrame) -> DataFrame:
    """column_name, checksum of every column: independent of row order, as unsigned text."""
    ints, texts = split(df)
    numbers = _unpivot(df, {c: {"checksum": F.coalesce(codec.checksum_int(quoted(c)), F.lit("0"))} for c in ints}) if ints else None
    if not texts:
        return numbers
    names = df.sparkSession.createDataFrame([(c,) for c in texts], "name string")
    sums = names.join(byte_counts(df), F.col("name") == F.col("column_name"), "left").groupBy(F.col("name").alias("column_name")).agg(codec.checksum_bytes("byte", "n").alias("checksum"))
    return sums if numbers is None else numbers.unionByName(sums)
