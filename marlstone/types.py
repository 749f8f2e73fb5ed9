"""The two logical types and their Spark types."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DataType, IntegerType, LongType, ShortType, StringType, StructField, StructType

INT64, VARCHAR = "INT64", "VARCHAR"
SPARK: dict[str, DataType] = {INT64: LongType(), VARCHAR: StringType()}
#: Order of rows inside a data file, and of data files inside a table; never part of a result.
ROW, FILE = "__row_idx", "__file_seq"


@dataclass(frozen=True)
class Column:
    name: str
    type: str


def logical(t: DataType) -> str | None:
    """The logical type that holds values of ``t`` without loss, or None."""
    if isinstance(t, (LongType, IntegerType, ShortType, ByteType)):
        return INT64
    return VARCHAR if isinstance(t, StringType) else None


def schema(columns: list[Column]) -> StructType:
    return StructType([StructField(c.name, SPARK[c.type]) for c in columns])


def columns_of(df: DataFrame) -> list[Column]:
    """Columns of ``df``; a type without counterpart is an error."""
    out = []
    for f in df.schema.fields:
        kind = logical(f.dataType)
        if kind is None:
            raise TypeError(f"column '{f.name}': {f.dataType.simpleString()} is neither INT64 nor VARCHAR")
        out.append(Column(f.name, kind))
    return out


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def project_supported(df: DataFrame) -> DataFrame:
    """Columns with a counterpart, integers widened; other columns are left out, never turned into text."""
    return df.select(*[F.col(quoted(f.name)).cast(SPARK[k]).alias(f.name) for f in df.schema.fields if (k := logical(f.dataType))])


def split(df: DataFrame) -> tuple[list[str], list[str]]:
    """Names of INT64 and of VARCHAR columns."""
    kinds = [(f.name, logical(f.dataType)) for f in df.schema.fields]
    return [n for n, k in kinds if k == INT64], [n for n, k in kinds if k == VARCHAR]
