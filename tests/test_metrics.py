import pytest

from marlstone import fixtures
from marlstone.operators import integrity, metrics, profile
from marlstone.sources.tables import from_columns


def by_name(df):
    return {r["column_name"]: r for r in df.collect()}


@pytest.fixture(scope="module")
def people(spark):
    return from_columns(spark, {"score": [85, 90, 95], "name": ["Ann", "Bob", "Zoé"]})


def test_averages_are_exact(spark):
    big = from_columns(spark, {"x": [2**53, 1, 1, 1], "y": [-(2**63), 2**63 - 1, -1, -1]})
    got = by_name(metrics.int_averages(big))
    assert got["x"]["avg_value"] == 2251799813685249
    assert got["y"]["avg_value"] == -3 / 4


def test_empty_columns(spark):
    none = spark.createDataFrame([], "n long, t string")
    assert metrics.int_averages(none).collect() == []
    assert by_name(metrics.total_ascii(none))["t"]["total_ascii"] == 0
    assert metrics.ascii_char_counts(none).collect() == []
    assert metrics.row_count(none).first() == (0, 2)


def test_ascii(spark, people):
    assert metrics.total_ascii_of(people, "name") == 8
    assert metrics.total_ascii_of(people, "score") is None and metrics.total_ascii_of(people, "no") is None
    counts = {r["ch"]: r["n"] for r in metrics.ascii_char_counts(from_columns(spark, {"t": ["aA a\x00", "é\n"]})).collect()}
    assert counts == {"a": 2, "A": 1, " ": 1, "\x00": 1, "\n": 1}


def test_report(people):
    assert metrics.report(people).splitlines() == ["rows: 3", "columns: 2", "name (VARCHAR): ASCII characters 8", "score (INT64): average 90.00"]


def test_profiles(spark):
    df = from_columns(spark, {"h": [12, 26, 20], "t": ["ab", "", "é"]})
    row = by_name(profile.int_profile(df))["h"]
    assert (row["min_value"], row["max_value"], row["sum_value"], row["range_value"], row["n"]) == (12, 26, 58, 14, 3)
    assert row["var_pop"] == pytest.approx(sum((v - 58 / 3) ** 2 for v in (12, 26, 20)) / 3)
    text = by_name(profile.varchar_profile(df))["t"]
    assert (text["distinct_values"], text["min_bytes"], text["max_bytes"], text["mean_bytes"]) == (3, 0, 2, 4 / 3)


def test_classes_and_top(spark):
    df = from_columns(spark, {"t": ["aab b1!`\t", "é a"]})
    row = by_name(profile.char_classes(df))["t"]
    assert (row["letters"], row["digits"], row["spaces"], row["punctuation"]) == (5, 1, 2, 2)
    top = [(r["ch"], r["n"]) for r in profile.topk_chars(df).orderBy("rank").collect()]
    assert top == [("a", 3), ("SPACE", 2), ("b", 2), ("\t", 1), ("!", 1)]


def test_categories(spark):
    df = from_columns(spark, {"few": list("aabbbc" * 2), "many": [f"v{i:02d}" for i in range(12)]})
    got = [tuple(r) for r in profile.categorical_frequency(df).orderBy("column_name", "rank").collect()]
    assert got == [("few", 1, "b", 6), ("few", 2, "a", 4), ("few", 3, "c", 2), ("many", 1, "v00", None), ("many", 2, "v01", None), ("many", 3, "v02", None)]


def test_checksums_ignore_order(spark):
    rows = [(-1, "b"), (2**63 - 1, ""), (-(2**63), "ä")]
    a, b = (by_name(metrics.checksums(spark.createDataFrame(r, "n long, t string"))) for r in (rows, rows[::-1]))
    want = sum((n % 2**64) * 31 for n, _ in rows) % 2**64
    assert a == b and a["n"]["checksum"] == str(want)
    assert a["t"]["checksum"] == str(sum(sum(t.encode()) * 37 * 31 for _, t in rows) % 2**64)


def test_differences(spark):
    a = spark.createDataFrame([(1, "x", 5), (2, "y", 6)], "k long, t string, n long")
    b = spark.createDataFrame([(1, "x", 5), (2, "z", 6), (3, "w", 7)], "k long, t string, n long")
    got = by_name(integrity.differences(a, b, "k"))
    assert {c: r["differing"] for c, r in got.items()} == {"k": 1, "t": 2, "n": 1}


def test_batches(spark):
    df = from_columns(spark, {"k": list(range(2500)), "t": ["ab"] * 2500})
    got = {(r["column_name"], r["batch"]): tuple(r)[2:] for r in integrity.batch_meta(df, "k", 1000).collect()}
    assert got["k", 2] == (2000, 500, 4000) and got["t", 0] == (0, 1000, 6000)


def test_large_fixture(spark):
    df = fixtures.large(spark, 10_000)
    assert by_name(metrics.int_averages(df))["value"]["avg_value"] == 499.5
    assert profile.value_frequency(df, "category").count() == 10


def test_bytes_are_counted_in_little_memory(spark, monkeypatch):
    import tracemalloc

    import pyarrow as pa

    frame, seen = type(spark.range(1)), []
    apply = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda df, f, schema: (seen.append(f), apply(df, f, schema))[1])
    metrics.byte_counts(spark.createDataFrame([("a",)], "t string"))
    batch = pa.RecordBatch.from_arrays([pa.array(["ab" * (1 << 20), None, "b" * 1000] * 8).slice(1)], names=["t"])
    tracemalloc.start()
    try:
        (out,) = seen[0]([batch])
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert {r["byte"]: r["n"] for r in out.to_pylist()} == {97: 7 << 20, 98: (7 << 20) + 8000}
    assert peak < 4 << 20
