"""Loading tables and scanning them in order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from marlstone.sources import csv, storage
from marlstone.sources.catalog import Catalog, Snapshot
from marlstone.sources.fs import Files
from marlstone.types import FILE, INT64, ROW, SPARK, Column, columns_of, quoted, schema


class PlanError(ValueError):
    pass


def target_columns(columns: list[Column], names: list[str] | None) -> list[Column]:
    """The columns that fields of a file go to, in the order given."""
    if names is None:
        return list(columns)
    if not names:
        raise PlanError("destination columns are empty")
    known = {c.name: c for c in columns}
    for n in names:
        if n not in known:
            raise PlanError(f"Column '{n}' not found in table")
    if len(set(names)) < len(names):
        raise PlanError("destination columns repeat a name")
    return [known[n] for n in names]


def _commit(catalog: Catalog, table_id: str, rows: DataFrame, batch: int) -> None:
    path = catalog.new_data_path(table_id)
    try:
        storage.write(rows, path, batch)
        catalog.add_data(table_id, path)
    except BaseException:
        Files(rows.sparkSession).delete(path)
        raise


def copy_csv(spark: SparkSession, catalog: Catalog, table_id: str, path: str, names: list[str] | None = None, header: bool = False, batch: int = storage.BATCH, nulls: bool = False) -> None:
    """Appends a CSV file to a table: all rows or none. ``nulls``: an empty field without quotes is a null."""
    columns = target_columns(catalog.get(table_id).columns, names)
    _commit(catalog, table_id, csv.read(spark, path, columns, header, nulls), batch)


def append(catalog: Catalog, table_id: str, df: DataFrame, batch: int = storage.BATCH) -> None:
    """Appends a DataFrame of the table's columns, in its order of rows."""
    table = catalog.get(table_id)
    if [(c.name, c.type) for c in columns_of(df)] != [(c.name, c.type) for c in table.columns]:
        raise PlanError("columns differ from the table's")
    cast = df.select(*[F.col(quoted(c.name)).cast(SPARK[c.type]).alias(c.name) for c in table.columns])
    _commit(catalog, table_id, storage.with_rows(cast), batch)


def register(catalog: Catalog, name: str, df: DataFrame) -> str:
    """A new table with the rows of ``df``."""
    table_id = catalog.create(name, columns_of(df))
    append(catalog, table_id, df)
    return table_id


def scan(spark: SparkSession, snapshot: Snapshot, ordered: bool = False, limit: int | None = None) -> DataFrame:
    """All rows of a snapshot. ``ordered`` and ``limit`` follow the order of loads and of rows in them.

    Columns that a load left out are null. A listed folder that is missing is an error.
    """
    if limit is not None and limit < 0:
        raise PlanError("row limit is negative")
    stored = StructType([*schema(list(snapshot.columns)).fields, StructField(ROW, LongType())])
    names = [F.col(quoted(c.name)) for c in snapshot.columns]
    if not snapshot.data_files:
        return spark.createDataFrame([], schema(list(snapshot.columns)))
    if not ordered and limit is None:
        return spark.read.schema(stored).parquet(*snapshot.data_files).select(*names)
    if len(snapshot.data_files) <= 32:
        parts = [spark.read.schema(stored).parquet(p).withColumn(FILE, F.lit(i)) for i, p in enumerate(snapshot.data_files)]
        rows = reduce(DataFrame.unionByName, parts)
    else:  # one scan; the folder of a row's file tells its place in the list
        folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
        place = F.create_map(*[x for i, p in enumerate(snapshot.data_files) for x in (F.lit(p.rsplit("/", 1)[1]), F.lit(i))])
        rows = spark.read.schema(stored).parquet(*snapshot.data_files).withColumn(FILE, place[folder])
    rows = rows.orderBy(FILE, ROW)
    return (rows if limit is None else rows.limit(limit)).select(*names)


def from_columns(spark: SparkSession, columns: dict[str, list], types: dict[str, str] | None = None) -> DataFrame:
    """A DataFrame from equally long lists, column by column."""
    lengths = {len(v) for v in columns.values()}
    if len(lengths) > 1:
        raise ValueError("Column length mismatch")
    kinds = [Column(n, (types or {}).get(n) or (INT64 if v and isinstance(v[0], int) else "VARCHAR")) for n, v in columns.items()]
    if not kinds:
        return spark.createDataFrame([], StructType([]))
    return spark.createDataFrame(list(zip(*columns.values(), strict=True)), schema(kinds))


def get_column(df: DataFrame, name: str) -> DataFrame | None:
    return df.select(quoted(name)) if name in df.columns else None
