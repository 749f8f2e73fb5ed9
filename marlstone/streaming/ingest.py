"""Tables fed by a folder of column files, through Structured Streaming.

Each micro-batch becomes one data folder of the table. The stream's checkpoint remembers which files
were taken; a batch that is run again after a crash finds its number in the folder's name and is
skipped, so rows arrive once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from marlstone.sources import storage
from marlstone.sources.catalog import Catalog
from marlstone.sources.fs import Files
from marlstone.types import schema


def follow(spark: SparkSession, catalog: Catalog, table_id: str, folder: str, checkpoint: str, stream: str = "stream", once: bool = True) -> StreamingQuery:
    """Starts loading Parquet files that appear in ``folder``; with ``once``, what is there now."""
    table = catalog.get(table_id)

    def take(batch: DataFrame, number: int) -> None:
        path = f"{catalog.root}/tables/{table_id}/{stream}-{number:010d}.parquet"
        if path in catalog.get(table_id).data_files:
            return
        try:
            storage.write(storage.with_rows(batch), path)
            catalog.add_data(table_id, path)
        except BaseException:
            Files(spark).delete(path)
            raise

    rows = spark.readStream.schema(schema(table.columns)).parquet(folder)
    writer = rows.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()
