"""The registered queries of the library, each over whole test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import codec
from marlstone.functions.order import batched
from marlstone.operators import integrity, metrics, profile
from marlstone.plans.definitions import Select
from marlstone.plans.engine import Engine
from marlstone.sources import storage, tables
from marlstone.sources.catalog import Catalog
from marlstone.sources.fs import Files, scratch
from marlstone.types import INT64, ROW, VARCHAR, Column, project_supported, quoted

Query = Callable[[SparkSession, str], DataFrame]
BATCH = storage.BATCH
#: Limits of an Arrow batch, in rows and bytes, where the user has set none: a Python worker holds two batches at a time.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    for key, value in ARROW.items():
        if (spark.conf.get(key, "1"), spark.conf.get(key, "2")) == ("1", "2"):
            spark.conf.set(key, value)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The INT64 and VARCHAR columns of a test table."""
    return project_supported(_read(spark, sf_dir, name))


def _stored(spark: SparkSession, sf_dir: str, name: str) -> tuple[Catalog, str]:
    catalog = Catalog(spark, scratch(spark))
    return catalog, tables.register(catalog, name, _table(spark, sf_dir, name))


def _csv(spark: SparkSession, df: DataFrame, header: bool = False) -> str:
    """``df`` as one CSV file: values in quotes, as they are; a null is an empty field without quotes.

    Lines are made here, since Spark's writer trims texts. Tasks write parts; the driver joins their bytes.
    """
    folder, files = scratch(spark), Files(spark)
    fields = [F.coalesce(F.concat(F.lit('"'), F.replace(F.col(quoted(c)).cast("string"), F.lit('"'), F.lit('""')), F.lit('"')), F.lit("")) for c in df.columns]
    df.select(F.concat_ws(",", *fields).alias("value")).write.text(f"{folder}/parts")
    names = sorted((n for n in files.names(f"{folder}/parts") if n.startswith("part-")), key=lambda n: (len(n), n))
    head = ",".join('"' + c.replace('"', '""') + '"' for c in df.columns) + "\n" if header else ""
    files.join(f"{folder}/table.csv", [f"{folder}/parts/{n}" for n in names], head.encode())
    files.delete(f"{folder}/parts")
    return f"{folder}/table.csv"


ORDERS = [Column("o_orderkey", INT64), Column("o_custkey", INT64), Column("o_orderstatus", VARCHAR), Column("o_orderpriority", VARCHAR)]


def scan_select_all(spark, sf_dir):
    """S1, K1: a table written as column files and scanned whole."""
    catalog, table = _stored(spark, sf_dir, "lineitem")
    return tables.scan(spark, catalog.snapshot(table))


def select_all_events(spark, sf_dir):
    """S3, L1-L6: the asynchronous SELECT, in order."""
    catalog, _ = _stored(spark, sf_dir, "events")
    engine = Engine(spark, catalog)
    query = engine.submit(Select("events"))
    engine.wait(query)
    return engine.result_frame(query)


def copy_csv_roundtrip(spark, sf_dir):
    """S2, K2: texts with line ends and quotes through CSV."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    catalog = Catalog(spark, scratch(spark))
    table = catalog.create("documents", [Column("doc_id", INT64), Column("text", VARCHAR), Column("lang", VARCHAR)])
    tables.copy_csv(spark, catalog, table, _csv(spark, docs, header=True), header=True, nulls=True)
    return tables.scan(spark, catalog.snapshot(table))


def multi_copy_append(spark, sf_dir):
    """K2, U1: the same file twice; rows of the second load come after those of the first."""
    path = _csv(spark, _table(spark, sf_dir, "orders"))
    catalog = Catalog(spark, scratch(spark))
    table = catalog.create("orders", ORDERS)
    for _ in range(2):
        tables.copy_csv(spark, catalog, table, path, nulls=True)
    return tables.scan(spark, catalog.snapshot(table), ordered=True)


def copy_column_subset(spark, sf_dir):
    """K3: two columns by position, the others null."""
    path = _csv(spark, _table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderkey"))
    catalog = Catalog(spark, scratch(spark))
    table = catalog.create("orders", ORDERS)
    tables.copy_csv(spark, catalog, table, path, ["o_orderstatus", "o_orderkey"], nulls=True)
    return tables.scan(spark, catalog.snapshot(table))


def copy_extra_fields(spark, sf_dir):
    """P2: fields beyond the table's columns are ignored."""
    path = _csv(spark, _table(spark, sf_dir, "orders"))
    catalog = Catalog(spark, scratch(spark))
    table = catalog.create("orders", ORDERS[:2])
    tables.copy_csv(spark, catalog, table, path, nulls=True)
    return tables.scan(spark, catalog.snapshot(table))


def row_limit(spark, sf_dir):
    """P3: the first rows in stored order."""
    catalog = Catalog(spark, scratch(spark))
    table = tables.register(catalog, "orders", _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").sort("o_orderkey"))
    return tables.scan(spark, catalog.snapshot(table), limit=100)


def table_from_columns(spark, sf_dir):
    """S4: a table from lists, as many rows as there are regions."""
    return tables.from_columns(spark, {"n": [1, 2, 3, 4, 5], "square": [1, 4, 9, 16, 25], "word": ["one", "two", "three", "four", "five"]})


def get_column(spark, sf_dir):
    """S5: one column, pruned at the scan."""
    catalog, table = _stored(spark, sf_dir, "customer")
    return tables.get_column(tables.scan(spark, catalog.snapshot(table)), "c_mktsegment")


def storage_roundtrip(spark, sf_dir):
    """K1, C5, C6: documents written with small batches and read again."""
    path = scratch(spark)
    storage.write(storage.with_rows(_table(spark, sf_dir, "documents")), path, batch=10_000)
    return storage.read(spark, path).drop(ROW)


def roundtrip_equal(spark, sf_dir):
    """E8: what was written against what is read, column by column."""
    df, path = _table(spark, sf_dir, "orders"), scratch(spark)
    storage.write(storage.with_rows(df), path)
    return integrity.differences(df, storage.read(spark, path).drop(ROW), "o_orderkey")


def _on(function, name, *args):
    return lambda spark, sf_dir: function(_table(spark, sf_dir, name), *args)


def _rounded(df, **places):
    """Variances differ in their last digits with the order of rows."""
    return df.withColumns({c: F.round(c, n) for c, n in places.items()})


def _events_delta(spark, sf_dir):
    rows = batched(_table(spark, sf_dir, "events").select("event_id", "user_id"), "event_id", BATCH)
    return codec.delta_encode(rows, "user_id", "batch", "rn", "d")


def delta_encode(spark, sf_dir):
    return _events_delta(spark, sf_dir).select("event_id", "user_id", "d")


def delta_decode(spark, sf_dir):
    return codec.delta_decode(_events_delta(spark, sf_dir), "d", "batch", "rn", "decoded").select("event_id", F.col("decoded").alias("user_id"))


def zigzag(spark, sf_dir):
    z = codec.zigzag(F.col("d"))
    return _events_delta(spark, sf_dir).select("event_id", "d", z.alias("z"), codec.unzigzag(z).alias("back"))


def vle_bytes(spark, sf_dir):
    z = codec.zigzag(F.col("d"))
    return _events_delta(spark, sf_dir).select("event_id", codec.vle_size(z).alias("n_bytes"), codec.unzigzag(codec.vle_value(codec.vle_bytes(z))).alias("back"))


def checksum_int(spark, sf_dir):
    df = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return metrics.checksums(df)


def checksum_str(spark, sf_dir):
    return metrics.checksums(_table(spark, sf_dir, "documents").select("text", "lang", "source"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (scan_select_all, select_all_events, copy_csv_roundtrip, multi_copy_append, copy_column_subset, copy_extra_fields, row_limit, table_from_columns, get_column, storage_roundtrip, roundtrip_equal, delta_encode, delta_decode, zigzag, vle_bytes, checksum_int, checksum_str)
} | {
    "int_averages": _on(metrics.int_averages, "orders"),
    "ascii_char_counts": _on(metrics.ascii_char_counts, "documents"),
    "total_ascii": _on(metrics.total_ascii, "documents"),
    "table_metrics": _on(metrics.table_metrics, "documents"),
    "row_count": _on(metrics.row_count, "lineitem"),
    "column_details": _on(metrics.column_details, "orders"),
    "table_sums": _on(metrics.table_sums, "documents"),
    "int_profile": lambda spark, sf_dir: _rounded(profile.int_profile(_table(spark, sf_dir, "orders")), var_pop=3, stddev_pop=6),
    "varchar_profile": _on(profile.varchar_profile, "documents"),
    "value_frequency": _on(profile.value_frequency, "events", "event_type"),
    "categorical_frequency": _on(profile.categorical_frequency, "customer"),
    "char_classes": _on(profile.char_classes, "documents"),
    "topk_chars": _on(profile.topk_chars, "documents"),
    "detailed_stats": _on(profile.detailed_stats, "documents"),
    "comprehensive_metrics": lambda spark, sf_dir: _rounded(profile.comprehensive_metrics(_table(spark, sf_dir, "documents")), variance=3),
    "batch_meta": _on(integrity.batch_meta, "events", "event_id", 1000),
}


def _each(columns, expression: str, table: str, tail: str = "") -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS column_name, {expression.format(c=c)} FROM {table}{tail.format(c=c)}" for c in columns)


_ORDER_INTS, _ORDER_TEXTS = ["o_orderkey", "o_custkey"], ["o_orderstatus", "o_orderpriority"]
_DOC_INTS, _DOC_TEXTS = ["doc_id", "n_chars"], ["text", "lang", "source"]
_CUSTOMER_TEXTS = ["c_name", "c_mktsegment"]
_EVENT_INTS, _EVENT_TEXTS = ["event_id", "user_id"], ["event_type", "props"]
_ASCII = r"coalesce(CAST(sum(length(regexp_replace({c}, '[^\x00-\x7F]', '', 'g'))) AS BIGINT), 0)"
_DELTA = f"""SELECT event_id, user_id, user_id - coalesce(lag(user_id) OVER (PARTITION BY b ORDER BY rn), 0) AS d
FROM (SELECT event_id, user_id, rn, rn // {BATCH} AS b FROM (SELECT event_id, user_id, row_number() OVER (ORDER BY event_id) - 1 AS rn FROM events))"""
_Z = "CASE WHEN d >= 0 THEN 2 * d ELSE -2 * d - 1 END"
_CHARS = " UNION ALL ".join(f"SELECT '{c}' AS column_name, ch, count(*) AS n FROM (SELECT unnest(string_split({c}, '')) AS ch FROM documents) WHERE regexp_full_match(ch, '(?s)[\\x00-\\x7F]') GROUP BY ch" for c in _DOC_TEXTS)
_U64 = "18446744073709551616::hugeint"
_STATS = "CAST({v} AS BIGINT) AS total, min({m}) AS min_value, max({m}) AS max_value, count({c}) AS n"

ORACLE_SQL: dict[str, str] = {
    "scan_select_all": "SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_returnflag, l_linestatus FROM lineitem",
    "select_all_events": "SELECT event_id, user_id, event_type, props FROM events",
    "copy_csv_roundtrip": "SELECT doc_id, text, lang FROM documents",
    "multi_copy_append": "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders",
    "copy_column_subset": "SELECT o_orderkey, CAST(NULL AS BIGINT) AS o_custkey, o_orderstatus, CAST(NULL AS VARCHAR) AS o_orderpriority FROM orders",
    "copy_extra_fields": "SELECT o_orderkey, o_custkey FROM orders",
    "row_limit": "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 100",
    "table_from_columns": "SELECT * FROM (VALUES (1::BIGINT, 1::BIGINT, 'one'), (2, 4, 'two'), (3, 9, 'three'), (4, 16, 'four'), (5, 25, 'five')) AS t(n, square, word)",
    "get_column": "SELECT c_mktsegment FROM customer",
    "storage_roundtrip": "SELECT doc_id, text, lang, source, n_chars FROM documents",
    "roundtrip_equal": _each([*_ORDER_INTS, *_ORDER_TEXTS], "count(*) AS rows, CAST(0 AS BIGINT) AS differing", "orders"),
    "delta_encode": _DELTA,
    "delta_decode": "SELECT event_id, user_id FROM events",
    "zigzag": f"SELECT event_id, d, {_Z} AS z, d AS back FROM ({_DELTA})",
    "vle_bytes": f"SELECT event_id, CAST(CASE WHEN z < 128 THEN 1 WHEN z < 16384 THEN 2 WHEN z < 2097152 THEN 3 WHEN z < 268435456 THEN 4 ELSE 5 END AS BIGINT) AS n_bytes, d AS back FROM (SELECT event_id, d, {_Z} AS z FROM ({_DELTA}))",
    "checksum_int": _each(_ORDER_INTS, f"CAST(sum({{c}}::hugeint * 31) % {_U64} AS VARCHAR) AS checksum", "orders"),
    "checksum_str": _each(_DOC_TEXTS, f"CAST(sum(list_sum(list_transform(regexp_extract_all(hex(encode({{c}})), '..'), lambda b: ('0x' || b)::bigint))::hugeint * 37 * 31) % {_U64} AS VARCHAR) AS checksum", "documents"),
    "int_averages": _each(_ORDER_INTS, "CAST(sum({c}) AS DOUBLE) / count({c}) AS avg_value", "orders"),
    "ascii_char_counts": _CHARS,
    "total_ascii": _each(_DOC_TEXTS, f"{_ASCII} AS total_ascii", "documents"),
    "table_metrics": _each(_DOC_INTS, "'INT64' AS column_type, count(*) AS row_count, CAST(sum({c}) AS DOUBLE) / count({c}) AS avg_value, CAST(NULL AS BIGINT) AS total_ascii", "documents")
    + " UNION ALL "
    + _each(_DOC_TEXTS, f"'VARCHAR' AS column_type, count(*) AS row_count, CAST(NULL AS DOUBLE) AS avg_value, {_ASCII} AS total_ascii", "documents"),
    "row_count": "SELECT count(*) AS row_count, CAST(6 AS BIGINT) AS column_count FROM lineitem",
    "column_details": _each(_ORDER_INTS, "'INT64' AS column_type, count(*) AS row_count", "orders") + " UNION ALL " + _each(_ORDER_TEXTS, "'VARCHAR' AS column_type, count(*) AS row_count", "orders"),
    "table_sums": _each(_DOC_INTS, "CAST(sum({c}) AS BIGINT) AS total", "documents") + " UNION ALL " + _each(_DOC_TEXTS, "CAST(sum(strlen({c})) AS BIGINT) AS total", "documents"),
    "int_profile": _each(_ORDER_INTS, "count({c}) AS n, min({c}) AS min_value, max({c}) AS max_value, CAST(sum({c}) AS BIGINT) AS sum_value, max({c}) - min({c}) AS range_value, CAST(sum({c}) AS DOUBLE) / count({c}) AS avg_value, round(var_pop({c}), 3) AS var_pop, round(stddev_pop({c}), 6) AS stddev_pop", "orders"),
    "varchar_profile": _each(_DOC_TEXTS, "count({c}) AS n, count(DISTINCT {c}) AS distinct_values, CAST(sum(strlen({c})) AS DOUBLE) / count({c}) AS mean_bytes, min(strlen({c})) AS min_bytes, max(strlen({c})) AS max_bytes, CAST(sum(strlen({c})) AS BIGINT) AS total_bytes", "documents"),
    "value_frequency": "SELECT event_type AS value, count(*) AS n FROM events GROUP BY 1",
    "categorical_frequency": " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, rank, value, CASE WHEN few THEN n END AS n FROM (SELECT value, n, few, CASE WHEN few THEN row_number() OVER (ORDER BY n DESC, value) ELSE row_number() OVER (ORDER BY value) END AS rank FROM (SELECT {c} AS value, count(*) AS n, count(*) OVER () <= 8 AS few FROM customer GROUP BY 1)) WHERE few OR rank <= 3"
        for c in _CUSTOMER_TEXTS
    ),
    "char_classes": _each(
        _DOC_TEXTS,
        r"CAST(sum(length(regexp_replace({c}, '[^A-Za-z]', '', 'g'))) AS BIGINT) AS letters, CAST(sum(length(regexp_replace({c}, '[^0-9]', '', 'g'))) AS BIGINT) AS digits, CAST(sum(length(regexp_replace({c}, '[^ ]', '', 'g'))) AS BIGINT) AS spaces, CAST(sum(length(regexp_replace({c}, '[^!-/:-@\[-`\{{-~]', '', 'g'))) AS BIGINT) AS punctuation",
        "documents",
    ),
    "topk_chars": f"SELECT column_name, rank, CASE WHEN ch = ' ' THEN 'SPACE' ELSE ch END AS ch, n FROM (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, ch) AS rank FROM ({_CHARS})) WHERE rank <= 5",
    "detailed_stats": " UNION ALL ".join(
        [f"SELECT '{c}' AS column_name, " + _STATS.format(v=f"sum({c})", m=c, c=c) + " FROM documents" for c in _DOC_INTS]
        + [f"SELECT '{c}' AS column_name, " + _STATS.format(v=f"sum(strlen({c}))", m=f"strlen({c})", c=c) + " FROM documents" for c in _DOC_TEXTS]
    ),
    "comprehensive_metrics": " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST(sum({v}) AS DOUBLE) / count({v}) AS mean, round(var_pop({v}), 3) AS variance, CAST(min({v}) AS DOUBLE) AS min_value, CAST(max({v}) AS DOUBLE) AS max_value, CAST(sum({v}) AS DOUBLE) AS total FROM documents"
        for c, v in [(c, c) for c in _DOC_INTS] + [(c, f"strlen({c})") for c in _DOC_TEXTS]
    ),
    "batch_meta": " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, rn // 1000 AS batch, min(rn) AS start_row, count(*) AS row_count, CAST(sum({s}) AS BIGINT) AS uncompressed_size FROM (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS rn FROM events) GROUP BY 2"
        for c, s in [(c, "8") for c in _EVENT_INTS] + [(c, f"strlen({c}) + 4") for c in _EVENT_TEXTS]
    ),
}
