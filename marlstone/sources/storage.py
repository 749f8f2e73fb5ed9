"""Column files: Parquet with delta encodings, Zstandard, and row groups of a batch each."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.sources.fs import Files
from marlstone.types import ROW

BATCH, BATCH_MIN, BATCH_MAX = 100_000, 1_000, 1_000_000


def batch_size(n: int) -> int:
    """Rows of a batch, kept between 1 000 and 1 000 000."""
    kept = min(max(n, BATCH_MIN), BATCH_MAX)
    if kept != n:
        logging.getLogger(__name__).warning("batch size %d is outside %d..%d; using %d", n, BATCH_MIN, BATCH_MAX, kept)
    return kept


def write(df: DataFrame, path: str, batch: int = BATCH, mode: str = "overwrite") -> None:
    """Integers become delta-packed, texts delta byte arrays; both compressed."""
    (
        df.write.mode(mode)
        .option("compression", "zstd")
        .option("parquet.writer.version", "v2")
        .option("parquet.enable.dictionary", "false")
        .option("parquet.block.row.count.limit", str(batch_size(batch)))
        .parquet(path)
    )


def with_rows(df: DataFrame) -> DataFrame:
    """``df`` with its order of rows as a column; numbers grow but have gaps between partitions."""
    return df.withColumn(ROW, F.monotonically_increasing_id())


def read(spark: SparkSession, *paths: str, schema=None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(*paths)


def row_groups(spark: SparkSession, path: str) -> DataFrame:
    """file, column_name, batch, start_row, row_count, compressed_size, uncompressed_size of every written batch.

    Read from the footers alone, by the driver, file after file; ``batch`` and ``start_row`` count from 0 in each file.
    """
    jvm, conf, rows = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), []
    hadoop = jvm.org.apache.parquet.hadoop
    for name in Files(spark).names(path):
        if name.startswith(("_", ".")):
            continue
        reader = hadoop.ParquetFileReader.open(hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(f"{path}/{name}"), conf))
        try:
            start = 0
            for batch, block in enumerate(reader.getFooter().getBlocks()):
                for c in block.getColumns():
                    rows.append((name, c.getPath().toDotString(), batch, start, block.getRowCount(), c.getTotalSize(), c.getTotalUncompressedSize()))
                start += block.getRowCount()
        finally:
            reader.close()
    return spark.createDataFrame(rows, "file string, column_name string, batch bigint, start_row bigint, row_count bigint, compressed_size bigint, uncompressed_size bigint")
