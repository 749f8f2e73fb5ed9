"""CSV files into typed rows, with exact errors.

The first record fixes how many fields every record has; fields map to columns by position, fields
beyond the columns are ignored. A file is read in parallel splits. Where quotes hide line ends, a first
pass finds the records that the borders of splits cut. Row numbers follow the file either way.
"""

from __future__ import annotations

import codecs
import csv
import re
import sys
import uuid
from collections.abc import Iterable, Iterator

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from marlstone.sources.fs import Files
from marlstone.types import INT64, ROW, Column, quoted


class CsvError(ValueError):
    pass


#: Bytes that one task reads of a file with line ends in quotes.
SPLIT = 32 << 20
#: Longer than any text can be.
ENDLESS = 1 << 31
_LINE_ENDS = re.compile(r"(?<=\n)|(?<=\r)(?!\n)")
_OPENS = re.compile(r'(?:^|[,\r])"')


def _lines(files: Files, path: str) -> Iterator[str]:
    decoder, rest = codecs.getincrementaldecoder("utf-8-sig")("replace"), ""
    for chunk in files.chunks(path):
        text = rest + decoder.decode(chunk)
        held = text.endswith("\r")  # a line feed may follow in the next chunk
        *whole, rest = _LINE_ENDS.split(text[:-1] if held else text)
        rest += "\r" * held
        yield from whole
    yield from _LINE_ENDS.split(rest + decoder.decode(b"", True))


def width(files: Files, path: str) -> int | None:
    """Fields of the first record that isn't blank; None for an empty file."""
    csv.field_size_limit(sys.maxsize)
    return next((len(r) for r in csv.reader(_lines(files, path)) if r), None)


def _by_lines(spark: SparkSession, path: str) -> bool:
    """Whether each line is a record for sure: fields have no quotes, or they end with the quote after the first, pairs of quotes aside."""
    value = F.col("value")
    bare = F.regexp_replace(F.replace(value, F.lit('""'), F.lit("")), r'(^|,)"[^"]*"(?=,|\r?\z)', "$1")
    return spark.read.text(path, lineSep="\n").filter(value.contains('"') & (bare.contains('"') | value.rlike(r"\r[\s\S]"))).isEmpty()


def _inside(line: str, inside: bool) -> bool:
    """Whether the end of a line is inside of quotes, by whether its start is. Quotes inside a field without quotes are text."""
    at = 0
    while True:
        if not inside:
            opening = _OPENS.search(line, at)
            if not opening:
                return False
            at = opening.end()
        while True:
            at = line.find('"', at) + 1
            if not at:
                return True
            if not line.startswith('"', at):
                break
            at += 1
        inside = False


def _records(lines: Iterable[tuple[int, str]], nulls: bool) -> Iterator[tuple[int, int, list]]:
    """Offset of the first line, place and fields of each record of ``lines``; places grow."""
    csv.field_size_limit(sys.maxsize)
    begin = None

    def pieces():
        nonlocal begin
        for offset, line in lines:
            place = offset
            for piece in _LINE_ENDS.split(line + "\n") if "\r" in line else [line + "\n"]:
                if piece:
                    begin = begin or (offset, place)
                    yield piece
                place += len(piece)

    for record in csv.reader(pieces(), quoting=csv.QUOTE_NOTNULL if nulls else csv.QUOTE_MINIMAL):
        if record:
            yield *begin, record
        begin = None


def _survey(i: int, lines: Iterable[tuple[int, str]]) -> Iterator[tuple]:
    """Of a split: its first line that isn't blank and, in case it starts outside and inside of quotes, the first line that starts
    outside, whether the end is inside, and the line of the record that the end cuts."""
    filled, first, inside, cut, none = None, [None, None], [False, True], [None, None], True
    for offset, line in lines:
        none = False
        if filled is None and line.strip("\r"):
            filled = offset
        for case in (0, 1):
            if not inside[case]:
                first[case] = offset if first[case] is None else first[case]
                cut[case] = offset
            if '"' in line:
                inside[case] = _inside(line, inside[case])
    if not none:
        yield i, filled, [(first[c], inside[c], cut[c]) for c in (0, 1)]


def _in_splits(spark: SparkSession, path: str, k: int, columns: int, header: bool, nulls: bool) -> DataFrame:
    """The first ``columns`` fields of each record and ROW, by splits that Hadoop cuts at the same bytes each time.

    The driver gets a few numbers for each split, and the texts of records that lie in several.
    """
    conf = {
        "mapreduce.input.fileinputformat.inputdir": path.replace("\\", "\\\\").replace(",", "\\,"),
        "mapreduce.input.fileinputformat.split.minsize": str(SPLIT),
        "mapreduce.input.fileinputformat.split.maxsize": str(SPLIT),
        "textinputformat.record.delimiter": "\n",
    }
    lines = spark.sparkContext.newAPIHadoopRDD("org.apache.hadoop.mapreduce.lib.input.TextInputFormat", "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.Text", conf=conf)
    found = sorted(_reading(lines.mapPartitionsWithIndex(_survey).collect))
    files, inside, begun, own, ranges = Files(spark), False, None, {}, []
    for i, _, cases in found:
        first, end, cut = cases[inside]
        if begun is not None and first is not None:
            ranges.append((begun, first))
            begun = None
        if end and first is not None:
            begun = cut
        own[i] = (first, cut if end else None)
        inside = end
    if begun is not None:
        ranges.append((begun, files.size(path)))
    if any(end - start >= ENDLESS for start, end in ranges):
        raise CsvError("Failed to read CSV record")
    skipped = next((filled for _, filled, _ in found if filled is not None), None) if header else None

    def parsed(lines):
        skip = skipped
        for offset, place, record in _records(lines, nulls):
            if offset == skip:
                skip = None
                continue
            if len(record) != k:
                raise ValueError(f"MALFORMED record of {len(record)} fields instead of {k}")
            yield *record[:columns], place

    def whole(i, lines):
        first, stop = own.get(i, (None, None))
        return parsed((n, line) for n, line in lines if first is not None and n >= first and (stop is None or n < stop))

    def cut_lines(span):
        place, text = span
        for line in text.removesuffix("\n").split("\n"):
            yield place, line
            place += len(line) + 1

    rows = lines.mapPartitionsWithIndex(whole)
    if ranges:
        texts = [(start, files.part(path, start, end).decode("utf-8-sig" if start == 0 else "utf-8", "replace")) for start, end in ranges]
        rows = rows.union(spark.sparkContext.parallelize(texts, -(-len(texts) // 64)).flatMap(lambda span: parsed(cut_lines(span))))
    kinds = [StructField(f"_c{i}", StringType()) for i in range(columns)]
    return spark.createDataFrame(rows, StructType([*kinds, StructField(ROW, LongType())]), verifySchema=False)


def _in_lines(spark: SparkSession, path: str, k: int, header: bool, nulls: bool) -> DataFrame:
    """The fields of each line and ROW."""
    fields = StructType([StructField(f"_c{i}", StringType()) for i in range(k)])
    reader = spark.read.options(escape='"', mode="FAILFAST", nullValue=uuid.uuid4().hex if nulls else "", header=header, enforceSchema=True)
    return reader.schema(fields).csv(path).withColumn(ROW, F.monotonically_increasing_id())


def read(spark: SparkSession, path: str, columns: list[Column], header: bool = False, nulls: bool = False) -> DataFrame:
    """Rows of the file as ``columns`` and ROW; raises CsvError for the first bad cell or record.

    An empty field is an empty text and no number; with ``nulls`` one without quotes is a null.
    """
    k = width(Files(spark), path)
    kinds = StructType([StructField(c.name, StringType()) for c in columns])
    if k is None:
        return _typed(spark.createDataFrame([], kinds).withColumn(ROW, F.lit(0).cast("bigint")), columns)
    raw = _in_lines(spark, path, k, header, nulls) if _by_lines(spark, path) else _in_splits(spark, path, k, min(k, len(columns)), header, nulls)
    if k < len(columns):
        if not _reading(raw.isEmpty):
            raise CsvError(f"Row {2 if header else 1}: expected {len(columns)} columns, but found {k} columns")
        return _typed(spark.createDataFrame([], kinds).withColumn(ROW, F.lit(0).cast("bigint")), columns)
    rows = raw.select(*[F.col(f"_c{i}").alias(c.name) for i, c in enumerate(columns)], ROW)
    _check(rows, columns, header, nulls)
    return _typed(rows, columns, nulls)


def _reading(action):
    try:
        return action()
    except (PySparkException, Py4JJavaError) as e:
        if "FAILED_READ_FILE" in str(e) or "MALFORMED" in str(e):
            raise CsvError("Failed to read CSV record") from e
        raise


def _number(name: str):
    return F.expr(f"try_cast(trim({quoted(name)}) as bigint)")


def _check(rows: DataFrame, columns: list[Column], header: bool, nulls: bool) -> None:
    """One aggregate over all cells: the first that isn't a number where one is due."""
    bad = [
        F.when(_number(c.name).isNull() & (F.col(quoted(c.name)).isNotNull() if nulls else F.lit(True)), F.struct(F.col(ROW).alias("row"), F.lit(i).alias("col"), F.coalesce(F.col(quoted(c.name)), F.lit("")).alias("value")))
        for i, c in enumerate(columns)
        if c.type == INT64
    ]
    if not bad:
        _reading(lambda: rows.agg(F.count("*")).first())
        return
    first = F.coalesce(*bad)
    worst = _reading(lambda: rows.agg(F.min(first).alias("b")).first()["b"])
    if worst is None:
        return
    line = rows.filter(F.col(ROW) < worst["row"]).count() + (2 if header else 1)
    name = columns[worst["col"]].name
    if not worst["value"].strip(" "):
        raise CsvError(f"Row {line}, column '{name}': empty value cannot be parsed as INT64")
    raise CsvError(f"Row {line}, column '{name}': failed to parse '{worst['value']}' as INT64")


def _typed(rows: DataFrame, columns: list[Column], nulls: bool = False) -> DataFrame:
    """Numbers parsed; an empty text is a text, not a null."""
    out = [(_number(c.name) if c.type == INT64 else F.col(quoted(c.name)) if nulls else F.coalesce(F.col(quoted(c.name)), F.lit(""))).alias(c.name) for c in columns]
    return rows.select(*out, ROW)
