"""Sample tables, small ones as literals and large ones as rules over row numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.sources.tables import from_columns

I64 = (1 << 63) - 1

# Rows of the small sample tables.
EMPLOYEE = {
    "employee_id": [1001, 1002, 1003, 1004, 1005, 1006, 1007, 1008],
    "salary": [65000, 72000, 58000, 85000, 91000, 67000, 73000, 79000],
    "name": ["John Smith", "Sarah Johnson", "Michael Brown", "Emily Davis", "David Wilson", "Lisa Anderson", "Robert Taylor", "Jennifer Martinez"],
    "department": ["Engineering", "Marketing", "Sales", "Engineering", "Management", "Sales", "Marketing", "Engineering"],
}
SALES = {
    "transaction_id": list(range(2001, 2021)),
    "amount": [150, 275, 89, 450, 320, 125, 680, 95, 380, 220, 540, 175, 295, 410, 85, 625, 190, 355, 480, 165],
    "product": ["Laptop", "Mouse", "Keyboard", "Monitor", "Tablet", "Headphones", "Smartphone", "Cable", "Laptop", "Mouse", "Webcam", "Speaker", "Tablet", "Monitor", "Cable", "Smartphone", "Keyboard", "Laptop", "Webcam", "Headphones"],
}
STUDENT_GRADES = {
    "student_id": list(range(3001, 3013)),
    "math_score": [88, 92, 76, 94, 85, 91, 78, 89, 96, 82, 87, 93],
    "english_score": [91, 87, 89, 88, 92, 85, 94, 86, 90, 95, 83, 89],
    "science_score": [85, 90, 82, 91, 88, 87, 92, 89, 93, 86, 91, 94],
    "student_name": ["Alex Chen", "Maria Garcia", "James Wilson", "Emma Thompson", "Oliver Brown", "Sophia Martinez", "Lucas Anderson", "Ava Johnson", "Noah Davis", "Isabella Miller", "William Taylor", "Mia Moore"],
}


def simple(spark: SparkSession) -> DataFrame:
    return from_columns(spark, {"id": [1, 2, 3, 4, 5], "name": ["Alice", "Bob", "Charlie", "Diana", "Eve"]})


def extremes(spark: SparkSession) -> DataFrame:
    """The ends of the number range, and texts with empty, wide, quoted and control characters."""
    numbers = [-I64 - 1, -I64, -1_000_000, -1, 0, 1, 1_000_000, I64 - 1, I64]
    texts = ["", "naïve \U0001f600", "two\nlines", "a\ttab", 'say "hi"', "x" * 1000, "MiXeD", "0123456789", "!@#\x00$%"]
    return from_columns(spark, {"extreme_ints": numbers, "special_strings": texts})


def large(spark: SparkSession, n: int = 10_000_000) -> DataFrame:
    """id from 1, a value with period 1000, ten categories, and a long description."""
    i = F.col("id")
    return spark.range(n).select(
        (i + 1).alias("id"),
        F.pmod(i * 17 + 42, F.lit(1000)).alias("value"),
        F.concat(F.lit("Category_"), F.pmod(i, F.lit(10)) + 1).alias("category"),
        F.concat(F.lit("Description for item "), i + 1, F.lit(" with details and additional information")).alias("description"),
    )


def batches(spark: SparkSession, n: int = 10_000_000) -> DataFrame:
    i = F.col("id")
    letter = F.element_at(F.array(*[F.lit(c) for c in "ABCDE"]), (F.pmod(i, F.lit(5)) + 1).cast("int"))
    return spark.range(n).select(i.alias("id_numbers"), F.concat(F.lit("category_"), letter, F.lit("_"), F.floor(i / 1000).cast("string")).alias("categories"))


def write_all(spark: SparkSession, folder: str, rows: int = 10_000_000) -> list[str]:
    """Writes every sample as column files below ``folder``, and beside each a text of its metrics and size."""
    from marlstone.operators import metrics
    from marlstone.sources import storage
    from marlstone.sources.fs import Files

    small = {"employee": EMPLOYEE, "sales": SALES, "student_grades": STUDENT_GRADES}
    samples = {"simple": simple(spark), "extremes": extremes(spark), "large": large(spark, rows), "batches": batches(spark, rows)}
    samples |= {name: from_columns(spark, values) for name, values in small.items()}
    files = Files(spark)
    for name, df in samples.items():
        path = f"{folder}/{name}"
        storage.write(storage.with_rows(df), path)
        files.replace(f"{path}.txt", f"{metrics.report(df)}\nfile size: {files.size(path)} bytes\n".encode())
    return list(samples)
