"""Column profiles: distributions of numbers, lengths and values of texts, frequencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import chars, codec
from marlstone.operators.metrics import _unpivot, ascii_char_counts, byte_counts, exact_sum
from marlstone.types import quoted, split

#: Up to so many distinct values a text column is shown by frequencies, else by sample values.
CATEGORIES = 8


def int_profile(df: DataFrame) -> DataFrame:
    """column_name, n, min, max, sum, range, average, population variance and deviation."""
    ints, _ = split(df)
    per = {}
    for name in ints:
        c = F.col(quoted(name))
        wide = lambda x: x.cast("decimal(20,0)")
        per[name] = {
            "n": F.count(c),
            "min_value": F.min(c).cast("bigint"),
            "max_value": F.max(c).cast("bigint"),
            "sum_value": codec.wrap(exact_sum(name)),
            "range_value": codec.wrap(wide(F.max(c)) - wide(F.min(c))),
            "avg_value": F.when(F.count(c) > 0, exact_sum(name).cast("double") / F.count(c)),
            "var_pop": F.var_pop(c),
            "stddev_pop": F.stddev_pop(c),
        }
    return _unpivot(df, per)


def varchar_profile(df: DataFrame) -> DataFrame:
    """column_name, n, distinct_values, mean, least, most and total length in bytes."""
    _, texts = split(df)
    per = {}
    for name in texts:
        size = chars.size(quoted(name))
        per[name] = {
            "n": F.count(quoted(name)),
            # of a 128-bit hash, so no text is shuffled
            "distinct_values": F.count_distinct(F.when(F.col(quoted(name)).isNotNull(), F.struct(F.xxhash64(quoted(name)), F.xxhash64(F.lit(1), quoted(name))))),
            "mean_bytes": F.when(F.count(quoted(name)) > 0, F.sum(size).cast("double") / F.count(quoted(name))),
            "min_bytes": F.min(size),
            "max_bytes": F.max(size),
            "total_bytes": F.coalesce(F.sum(size), F.lit(0).cast("bigint")),
        }
    return _unpivot(df, per)


def value_frequency(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(quoted(column)).alias("value")).agg(F.count("*").alias("n"))


def categorical_frequency(df: DataFrame, columns: list[str] | None = None, limit: int = CATEGORIES, samples: int = 3) -> DataFrame:
    """column_name, rank, value, n: all frequencies of columns with few values, else the first values.

    Ranks go by falling frequency, then by value; sample values are the smallest, without n.
    """
    names = columns or split(df)[1]
    counts = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(quoted(c)).alias("value")) for c in names])).alias("r")).select("r.*")
    counts = counts.groupBy("column_name", "value").agg(F.count("*").alias("n"))
    few = counts.groupBy("column_name").agg(F.count("*").alias("distinct_values")).filter(F.col("distinct_values") <= limit).select("column_name")
    by_column = Window.partitionBy("column_name")
    shown = counts.join(F.broadcast(few), "column_name").withColumn("rank", F.row_number().over(by_column.orderBy(F.desc("n"), "value")).cast("bigint"))
    firsts = None
    for c in names:  # the smallest values of a column: a top-k, not a sort
        top = counts.filter(F.col("column_name") == c).orderBy("value").limit(samples)
        firsts = top if firsts is None else firsts.unionByName(top)
    sampled = firsts.join(F.broadcast(few), "column_name", "left_anti").withColumn("rank", F.row_number().over(by_column.orderBy("value")).cast("bigint")).withColumn("n", F.lit(None).cast("bigint"))
    return shown.select("column_name", "rank", "value", "n").unionByName(sampled.select("column_name", "rank", "value", "n"))


def char_classes(df: DataFrame) -> DataFrame:
    """column_name, letters, digits, spaces, punctuation: ASCII characters of each class, from the histogram of bytes."""
    names = df.sparkSession.createDataFrame([(c,) for c in split(df)[1]], "name string")
    counts = names.join(byte_counts(df), F.col("name") == F.col("column_name"), "left")
    sums = [F.coalesce(F.sum(F.when(chars.in_class(F.col("byte"), k), F.col("n"))), F.lit(0).cast("bigint")).alias(k) for k in chars.CLASSES]
    return counts.groupBy(F.col("name").alias("column_name")).agg(*sums)


def topk_chars(df: DataFrame, k: int = 5) -> DataFrame:
    """column_name, rank, ch, n: the most frequent ASCII characters; a space is shown as SPACE."""
    rank = F.row_number().over(Window.partitionBy("column_name").orderBy(F.desc("n"), "ch"))
    top = ascii_char_counts(df).withColumn("rank", rank.cast("bigint")).filter(F.col("rank") <= k)
    return top.select("column_name", "rank", F.when(F.col("ch") == " ", "SPACE").otherwise(F.col("ch")).alias("ch"), "n")


def detailed_stats(df: DataFrame) -> DataFrame:
    """column_name, total, least, most, n: of numbers, or of lengths in bytes."""
    ints, texts = split(df)
    per = {c: {"total": codec.wrap(exact_sum(c)), "min_value": F.min(quoted(c)).cast("bigint"), "max_value": F.max(quoted(c)).cast("bigint"), "n": F.count(quoted(c))} for c in ints}
    for c in texts:
        size = chars.size(quoted(c))
        per[c] = {"total": F.sum(size), "min_value": F.min(size), "max_value": F.max(size), "n": F.count(quoted(c))}
    return _unpivot(df, per)


def comprehensive_metrics(df: DataFrame) -> DataFrame:
    """column_name, mean, variance (population), least, most and total as doubles."""
    ints, texts = split(df)
    per = {}
    for c in [*ints, *texts]:
        v = F.col(quoted(c)).cast("bigint") if c in ints else chars.size(quoted(c))
        total = F.sum(v.cast("decimal(38,0)"))
        per[c] = {"mean": total.cast("double") / F.count(v), "variance": F.var_pop(v), "min_value": F.min(v).cast("double"), "max_value": F.max(v).cast("double"), "total": total.cast("double")}
    return _unpivot(df, per)
