"""Integer encodings as Column expressions: wrapping arithmetic, delta, zigzag, variable length.

Everything is built-in arithmetic: 64-bit wrap-around goes through exact decimals, so results don't
depend on ANSI settings, and runs inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_HALF, _FULL = "9223372036854775808BD", "18446744073709551616BD"


def wrap(value: Column) -> Column:
    """An exact integer (decimal) as a signed 64-bit one, modulo 2**64."""
    return (F.pmod(value + F.expr(_HALF), F.expr(_FULL)) - F.expr(_HALF)).cast("bigint")


def delta_encode(df: DataFrame, value: str, batch: str, order: str, out: str = "delta") -> DataFrame:
    """The difference to the row before, starting anew in each batch."""
    before = F.coalesce(F.lag(value).over(Window.partitionBy(batch).orderBy(order)), F.lit(0).cast("bigint"))
    return df.withColumn(out, wrap(F.col(value).cast("decimal(20,0)") - before.cast("decimal(20,0)")))


def delta_decode(df: DataFrame, delta: str, batch: str, order: str, out: str = "value") -> DataFrame:
    """Running sums of differences within each batch."""
    run = Window.partitionBy(batch).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(out, wrap(F.sum(F.col(delta).cast("decimal(38,0)")).over(run).cast("decimal(38,0)")))


def zigzag(v: Column) -> Column:
    """0, -1, 1, -2 ... to 0, 1, 2, 3 ..."""
    return F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 63))


def unzigzag(z: Column) -> Column:
    return F.shiftrightunsigned(z, 1).bitwiseXOR(-z.bitwiseAND(F.lit(1).cast("bigint")))


def vle_size(z: Column) -> Column:
    """Bytes that 7-bit groups of an unsigned 64-bit value take: 1 to 10."""
    size = F.when(z < 0, 10)
    for n in range(1, 9):
        size = size.when(z < (1 << 7 * n), n)
    return size.otherwise(9).cast("bigint")


def vle_bytes(z: Column) -> Column:
    """The groups themselves, least significant first, the high bit set on all but the last."""
    n = vle_size(z).cast("int")

    def group(i: Column) -> Column:
        low = F.call_function("shiftrightunsigned", z, i * 7).bitwiseAND(F.lit(127).cast("bigint"))
        return low + F.when(i < n - 1, 128).otherwise(0)

    return F.transform(F.sequence(F.lit(0), n - 1), group)


def vle_value(groups: Column) -> Column:
    """The value of bytes of ``vle_bytes``."""
    indexed = F.transform(groups, lambda b, i: F.call_function("shiftleft", b.bitwiseAND(F.lit(127).cast("bigint")), i * 7))
    return F.aggregate(indexed, F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b))


def checksum_int(column: str) -> Column:
    """Aggregate: sum of values times 31 modulo 2**64, values taken as unsigned; as text."""
    u = F.pmod(F.col(column).cast("decimal(20,0)"), F.expr(_FULL)).cast("decimal(20,0)")
    return F.pmod(F.sum((u * F.lit(31).cast("decimal(3,0)")).cast("decimal(38,0)")), F.expr(_FULL)).cast("decimal(20,0)").cast("string")


def checksum_bytes(byte: str, n: str) -> Column:
    """Aggregate: of texts whose bytes a histogram gives, (sum of bytes times 37) times 31 modulo 2**64; as text."""
    each = (F.col(byte) * F.col(n)).cast("decimal(28,0)") * F.lit(37 * 31).cast("decimal(5,0)")
    return F.pmod(F.coalesce(F.sum(each.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")), F.expr(_FULL)).cast("decimal(20,0)").cast("string")
