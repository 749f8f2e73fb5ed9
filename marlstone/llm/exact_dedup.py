"""Exact deduplication, by DataFrame functions alone.

Texts are equal when they are identical without white space. Rows are grouped by a 128-bit
content hash together with the text itself: the hash does the partitioning, the aggregate
compares bytes, so a collision of hashes stays two groups. Copies are combined before the
shuffle. Only groups of two and more travel back to the rows, under a salt, so a text that a
third of all rows share is spread over many tasks.

Defined cases: a null text counts as empty; empty texts are copies of each other; a null
doc_id sorts after every other; of rows that repeat doc_id and text, one stays; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The characters [\x20\x09-\x0D].
SPACES = [" ", "\t", "\n", "\x0b", "\x0c", "\r"]
SALTS = 16
_TOP = 9223372036854775807
_STEP = "36893488147419103232"  # 2**65: above every value of the id's part


def normalised(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for c in SPACES:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def _hashes(norm: Column) -> list[Column]:
    return [F.xxhash64(norm).alias("h1"), F.xxhash64(F.lit(20260117), norm).alias("h2")]


def _rank(length: Column, doc_id: Column) -> Column:
    """A number that is largest for the row that stays: most code points, then the smallest id."""
    id_part = F.coalesce(F.lit(_TOP).cast("decimal(20,0)") - doc_id.cast("decimal(20,0)") + F.lit(1).cast("decimal(1,0)"), F.lit(0).cast("decimal(22,0)"))
    return (length.cast("decimal(11,0)") * F.lit(_STEP).cast("decimal(20,0)") + id_part).cast("decimal(38,0)")


def groups(docs: DataFrame) -> DataFrame:
    """A row for each text that several rows share: h1, h2, text_sha256, keep_id, keep_chars, group_size."""
    rows = docs.select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("chars"), normalised(F.col("text")).alias("norm"))
    best = (
        rows.groupBy(*_hashes(F.col("norm")), "norm")
        .agg(F.count("*").alias("group_size"), F.max(_rank(F.col("chars"), F.col("doc_id"))).alias("best"))
        .filter("group_size > 1")
    )
    id_part = F.expr(f"best % {_STEP}BD")
    keep = F.when(id_part == 0, F.lit(None)).otherwise((F.lit(_TOP).cast("decimal(20,0)") + F.lit(1).cast("decimal(1,0)") - id_part).cast("bigint"))
    chars = F.expr(f"cast(best div {_STEP}BD as bigint)")
    return best.select("h1", "h2", F.sha2("norm", 256).alias("text_sha256"), keep.alias("keep_id"), chars.alias("keep_chars"), "group_size")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row."""
    rows = (
        docs.select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("bigint").alias("chars"), normalised(F.col("text")).alias("norm"))
        .select("doc_id", "chars", *_hashes(F.col("norm")), F.sha2("norm", 256).alias("text_sha256"))
        .withColumn("salt", F.pmod(F.xxhash64("doc_id", "chars"), F.lit(SALTS)).cast("int"))
    )
    shared = groups(docs).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = rows.join(shared, ["h1", "h2", "text_sha256", "salt"], "left")
    again = F.row_number().over(Window.partitionBy("doc_id", "h1", "h2", "chars").orderBy("text_sha256"))
    single = F.col("group_size").isNull()
    return out.select(
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
        (single | (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("chars") == F.col("keep_chars")) & (again == 1))).alias("kept"),
        "text_sha256",
    )
