"""What the operators share: reading tables, cutting lineage, running NumPy over Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Limits of an Arrow batch, in rows and bytes: it lies in the executor and in its Python worker, with copies.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}
#: Rows of a few numbers that may be broadcast, after they were counted.
FEW = 500_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of an application of the operators (their queries, the pipeline), whose session gets the limits of ``BATCH``.

    Operators leave a session as it is. A limit that the user has set stays.
    """
    for key, value in BATCH.items():
        if (spark.conf.get(key, "1"), spark.conf.get(key, "2")) == ("1", "2"):
            spark.conf.set(key, value)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset and all runs on one machine (tests), a folder of our own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="marlstone-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, so lost executors cost no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, of which later steps read some columns only."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few(df: DataFrame) -> tuple[DataFrame, int]:
    """``df`` computed once, marked for a broadcast if it has at most ``FEW`` rows, and how many it has."""
    df = checkpointed(df)
    n = df.count()
    return (F.broadcast(df) if n <= FEW else df), n


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of ``df`` has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def map_batches(df: DataFrame, each: Callable[[pa.RecordBatch], Iterator[list]], schema: str) -> DataFrame:
    """Applies ``each`` to every Arrow batch; it yields lists of columns (arrays or lists) in schema order."""
    parsed = _parse_datatype_string(schema)
    assert isinstance(parsed, StructType)
    arrow = to_arrow_schema(parsed)

    def run(batches):
        for batch in batches:
            for columns in each(batch):
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) and c.type == f.type else pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, parsed)
