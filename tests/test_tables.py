import os

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from marlstone.sources import csv, storage, tables
from marlstone.types import INT64, ROW, VARCHAR, Column

ID_NAME = [Column("id", INT64), Column("name", VARCHAR)]


def write(tmp_path, text, name="in.csv"):
    path = tmp_path / name
    path.write_bytes(text.encode())
    return str(path)


def load(spark, catalog, tmp_path, columns, text, **how):
    table = catalog.create("t", columns)
    tables.copy_csv(spark, catalog, table, write(tmp_path, text), **how)
    return [tuple(r) for r in tables.scan(spark, catalog.snapshot(table), ordered=True).collect()]


def test_load_and_scan(spark, catalog, tmp_path):
    assert load(spark, catalog, tmp_path, ID_NAME, "1,Alice\n2,Bob\n3,Charlie\n") == [(1, "Alice"), (2, "Bob"), (3, "Charlie")]


def test_header_is_skipped_not_matched(spark, catalog, tmp_path):
    assert load(spark, catalog, tmp_path, ID_NAME, "name,id\n1,a\n2,b\n", header=True) == [(1, "a"), (2, "b")]


def test_subset_by_position(spark, catalog, tmp_path):
    columns = [*ID_NAME, Column("age", INT64)]
    assert load(spark, catalog, tmp_path, columns, "x,7\ny,8\n", names=["name", "age"]) == [(None, "x", 7), (None, "y", 8)]


@pytest.mark.parametrize("names,message", [(["id", "no"], "'no' not found"), (["id", "id"], "repeat"), ([], "empty")])
def test_bad_subsets(spark, catalog, tmp_path, names, message):
    with pytest.raises(tables.PlanError, match=message):
        load(spark, catalog, tmp_path, ID_NAME, "1,a\n", names=names)


def test_extra_fields_are_ignored(spark, catalog, tmp_path):
    assert load(spark, catalog, tmp_path, ID_NAME, "1,a,x,y\n2,b,z,w\n") == [(1, "a"), (2, "b")]


def test_text_is_kept_as_it_is(spark, catalog, tmp_path):
    text = '1,"two\nlines"\n2," padded "\n3,""\n4,\n5,"a ""quote"", äöü"\n'
    assert [r[1] for r in load(spark, catalog, tmp_path, ID_NAME, text)] == ["two\nlines", " padded ", "", "", 'a "quote", äöü']


@pytest.mark.parametrize(
    "text,header,message",
    [
        ("1,5\n2,\n", False, "Row 2, column 'value': empty value cannot be parsed as INT64"),
        ("1,abc\n", False, "Row 1, column 'value': failed to parse 'abc' as INT64"),
        ("id,value\n1,1.5\n", True, "Row 2, column 'value': failed to parse '1.5' as INT64"),
        ("1,9223372036854775808\n", False, "failed to parse"),
        ("1\n2\n", False, "Row 1: expected 2 columns, but found 1 columns"),
        ("id\n2\n", True, "Row 2: expected 2 columns, but found 1 columns"),
        ("1,2\n3\n", False, "Failed to read CSV record"),
        ("1,2\n3,4,5\n", False, "Failed to read CSV record"),
    ],
)
def test_errors_leave_nothing_behind(spark, catalog, tmp_path, text, header, message):
    table = catalog.create("t", [Column("id", INT64), Column("value", INT64)])
    with pytest.raises(csv.CsvError, match=message.replace("(", "\\(")):
        tables.copy_csv(spark, catalog, table, write(tmp_path, text), header=header)
    assert catalog.get(table).data_files == [] and os.listdir(f"{catalog.root}/tables/{table}") == []


@pytest.mark.parametrize("text,header", [("", False), ("\n\n", False), ("id\n", True), ("id,name\n", True)])
def test_no_rows(spark, catalog, tmp_path, text, header):
    assert load(spark, catalog, tmp_path, ID_NAME, text, header=header) == []


def test_numbers(spark, catalog, tmp_path):
    text = "+5\n-5\n 7 \n007\n9223372036854775807\n-9223372036854775808\n"
    got = load(spark, catalog, tmp_path, [Column("v", INT64)], text)
    assert [r[0] for r in got] == [5, -5, 7, 7, 2**63 - 1, -(2**63)]


def test_loads_append_in_order(spark, catalog, tmp_path):
    table = catalog.create("t", [Column("v", INT64)])
    for part in ("3\n1\n", "2\n9\n8\n"):
        tables.copy_csv(spark, catalog, table, write(tmp_path, part))
    snapshot = catalog.snapshot(table)
    tables.copy_csv(spark, catalog, table, write(tmp_path, "4\n"))
    scan = lambda s, **k: [r[0] for r in tables.scan(spark, s, ordered=True, **k).collect()]
    assert scan(snapshot) == [3, 1, 2, 9, 8]  # an earlier snapshot doesn't see later loads
    assert scan(catalog.snapshot(table), limit=4) == [3, 1, 2, 9]
    assert scan(catalog.snapshot(table), limit=100) == [3, 1, 2, 9, 8, 4]
    assert scan(catalog.snapshot(table), limit=0) == []
    with pytest.raises(tables.PlanError):
        tables.scan(spark, snapshot, limit=-1)


def test_many_loads(spark, catalog):
    table = catalog.create("t", [Column("v", INT64)])
    for i in range(34):
        tables.append(catalog, table, spark.createDataFrame([(100 - i,)], "v long"))
    assert [r[0] for r in tables.scan(spark, catalog.snapshot(table), ordered=True).collect()] == [100 - i for i in range(34)]


def test_missing_folder_is_an_error(spark, catalog):
    table = tables.register(catalog, "t", spark.createDataFrame([(1,)], "v long"))
    catalog.get(table).data_files.append(f"{catalog.root}/tables/{table}/gone.parquet")
    with pytest.raises(Exception, match="gone"):
        tables.scan(spark, catalog.snapshot(table)).collect()


def test_empty_table(spark, catalog):
    table = catalog.create("t", ID_NAME)
    df = tables.scan(spark, catalog.snapshot(table))
    assert df.columns == ["id", "name"] and df.count() == 0


def test_odd_names(spark, catalog, tmp_path):
    columns = [Column("a.b", INT64), Column("c d", VARCHAR), Column("e`f", VARCHAR)]
    assert load(spark, catalog, tmp_path, columns, "1,x,y\n") == [(1, "x", "y")]


def test_from_columns(spark):
    assert tables.from_columns(spark, {"a": [1, 2], "b": ["x", "y"]}).collect() == [(1, "x"), (2, "y")]
    with pytest.raises(ValueError, match="length mismatch"):
        tables.from_columns(spark, {"a": [1], "b": ["x", "y"]})
    assert tables.get_column(tables.from_columns(spark, {"a": [1]}), "b") is None


def test_batch_size():
    assert [storage.batch_size(n) for n in (1, 1_000, 5_000, 10**7)] == [1_000, 1_000, 5_000, 1_000_000]


def test_row_groups(spark, tmp_path):
    import pyarrow.parquet as pq

    path = str(tmp_path / "f")
    storage.write(storage.with_rows(spark.range(250_000).withColumnRenamed("id", "n").coalesce(1)), path)
    (part,) = [f for f in os.listdir(path) if f.startswith("part-")]
    meta = pq.ParquetFile(f"{path}/{part}").metadata
    assert [meta.row_group(i).num_rows for i in range(meta.num_row_groups)] == [100_000, 100_000, 50_000]
    assert meta.row_group(0).column(0).compression == "ZSTD"


def test_damaged_file(spark, tmp_path):
    path = str(tmp_path / "f")
    storage.write(spark.range(1000).coalesce(1), path)
    (part,) = [f"{path}/{f}" for f in os.listdir(path) if f.startswith("part-")]
    data = open(part, "rb").read()
    os.remove(f"{path}/.{os.path.basename(part)}.crc")
    open(part, "wb").write(data[: len(data) // 2])
    with pytest.raises(Exception):  # noqa: B017
        storage.read(spark, path).count()


def test_extremes_survive(spark, tmp_path):
    from marlstone import fixtures
    from marlstone.operators.integrity import differences

    df, path = fixtures.extremes(spark), str(tmp_path / "f")
    storage.write(storage.with_rows(df), path)
    assert all(r["differing"] == 0 for r in differences(df, storage.read(spark, path).drop(ROW), "extreme_ints").collect())


CELL = st.text(st.characters(blacklist_categories=("Cs",), blacklist_characters="\r\x00﻿"), max_size=8)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(-(2**63), 2**63 - 1), CELL), min_size=1, max_size=20))
def test_any_rows_survive_csv(spark, tmp_path, rows):
    path = tmp_path / "h.csv"
    path.write_bytes("".join(f'{n},"{t.replace(chr(34), chr(34) * 2)}"\n' for n, t in rows).encode())
    assert [tuple(r) for r in csv.read(spark, str(path), ID_NAME).orderBy(ROW).drop(ROW).collect()] == rows


def test_samples_have_goldens(spark, tmp_path):
    from marlstone import fixtures

    names = fixtures.write_all(spark, str(tmp_path), rows=1000)
    text = {n: (tmp_path / f"{n}.txt").read_text() for n in names}
    assert len(names) == 7 and "rows: 8\ncolumns: 4\n" in text["employee"] and "average 73750.00" in text["employee"]
    assert "average 305.20" in text["sales"] and sum(fixtures.SALES["amount"]) == 6104
    assert all(f"average {a}" in text["student_grades"] for a in ("87.58", "89.08", "89.00"))
    assert "average 499.50" in text["large"] and all("file size: " in t for t in text.values())
    back = storage.read(spark, str(tmp_path / "batches")).orderBy("id_numbers").collect()
    assert len(back) == 1000 and (back[7]["id_numbers"], back[7]["categories"]) == (7, "category_C_0")


def test_sizes_of_written_batches(spark, tmp_path):
    df = spark.range(0, 2500, 1, 1).selectExpr("id", "concat('item ', id) AS name")
    storage.write(df, str(tmp_path / "t"), 1000)
    got = storage.row_groups(spark, str(tmp_path / "t")).collect()
    assert sorted((r["column_name"], r["batch"], r["start_row"], r["row_count"]) for r in got) == [(c, b, 1000 * b, min(1000, 2500 - 1000 * b)) for c in ("id", "name") for b in range(3)]
    assert all(0 < r["compressed_size"] for r in got)
    storage.write(df.limit(0), str(tmp_path / "e"))
    assert storage.row_groups(spark, str(tmp_path / "e")).count() == 0


def test_quoted_files_are_split(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(csv, "SPLIT", 1000, raising=False)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        for end in ("", "\n"):  # with and without line ends in quotes
            path = write(tmp_path, "".join(f'"{i}","name{end} {i}"\n' for i in range(500)))
            df = csv.read(spark, path, ID_NAME)
            assert df.rdd.getNumPartitions() >= 8
            assert [tuple(r) for r in df.orderBy(ROW).drop(ROW).collect()] == [(i, f"name{end} {i}") for i in range(500)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


SPLIT_TEXTS = [
    'a,"b\n\n\n1,2\n3,4\n"\nc,d\n',
    '"a ""x"" \n","b\r\n\r c"\r\n\r\n\n5,6\re","f\r"g\n"h\n,",\n',
    'x"y,z"\n"q"r,"s\nt"\nu"",","\n" "," "\n',
    '"","\n"\n,\n"""",""""""\n"\n""\n",""\n',
    'last,"without\nend"',
    'id,"na\nme' + "\nlong" * 40 + '"\n1,"x\ny"\n2,z\n',
    "﻿\"bom\n\",1\nä€😀,\"ö\nü\"\n",
]


@pytest.mark.parametrize("size", [5, 40])
@pytest.mark.parametrize("text", SPLIT_TEXTS)
def test_splits_cut_no_record(spark, tmp_path, monkeypatch, text, size):
    import csv as plain
    import io

    monkeypatch.setattr(csv, "SPLIT", size)
    rows = [tuple(r) for r in plain.reader(io.StringIO(text.removeprefix("﻿"), newline="")) if r]
    columns = [Column("a", VARCHAR), Column("b", VARCHAR)]
    path = write(tmp_path, text)
    for header in (False, True):
        got = [tuple(r) for r in csv.read(spark, path, columns, header).orderBy(ROW).drop(ROW).collect()]
        assert got == rows[header:]


def test_splits_report_errors(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(csv, "SPLIT", 10)
    with pytest.raises(csv.CsvError, match="Row 4, column 'id': failed to parse 'x'"):
        csv.read(spark, write(tmp_path, 'id,name\n1,"a\nb"\n2,"c\nd"\nx,"e\nf"\n'), ID_NAME, True)
    with pytest.raises(csv.CsvError, match="Failed to read CSV record"):
        csv.read(spark, write(tmp_path, '1,"a\nb"\n2,"c\nd",3\n'), ID_NAME)


@pytest.mark.parametrize("text,want", [
    ('1,2\n"a","b"\n"a""b",""\n,"x,y"\n', True),
    ('"a\nb",c\n', False), ('a"b,"c\nd"\n', False), ('x"","\n",y\n', False), ('"a\rb",c\n', False), ('"a""\n"",b"\n', False),
])
def test_lines_that_are_records(spark, tmp_path, text, want):
    assert csv._by_lines(spark, write(tmp_path, text)) is want


def test_first_field_longer_than_python_allows(spark, catalog, tmp_path):
    long = "x" * 200_000
    assert load(spark, catalog, tmp_path, ID_NAME, f'1,"{long}\n"\n2,b\n') == [(1, long + "\n"), (2, "b")]
