import os

import pytest

from marlstone.sources import tables
from marlstone.sources.catalog import Catalog, CatalogError, TableMissing
from marlstone.types import INT64, ROW, VARCHAR, Column, columns_of, project_supported

COLUMNS = [Column("id", INT64), Column("name", VARCHAR)]


def test_create_find_list_drop(catalog):
    a = catalog.create("a", COLUMNS)
    b = catalog.create("b", COLUMNS)
    assert catalog.list_tables() == [(a, "a"), (b, "b")]
    assert catalog.find("a").table_id == a and catalog.exists("b") and not catalog.exists("A")
    assert catalog.get(a).columns == COLUMNS
    catalog.drop(a)
    assert catalog.list_tables() == [(b, "b")]
    with pytest.raises(TableMissing):
        catalog.get(a)
    with pytest.raises(TableMissing):
        catalog.drop(a)


def test_all_problems_of_a_definition_are_reported(catalog):
    with pytest.raises(CatalogError) as e:
        catalog.create("", [Column("", INT64), Column("x", "FLOAT"), Column(ROW, INT64)])
    assert [c for _, c in e.value.problems] == ["name", "columns[0]", "columns[1]", "columns[2]"]
    with pytest.raises(CatalogError) as e:
        catalog.create("t", [])
    assert e.value.problems[0][1] == "columns"


def test_duplicates(catalog):
    catalog.create("t", COLUMNS)
    with pytest.raises(CatalogError, match="already exists"):
        catalog.create("t", COLUMNS)
    with pytest.raises(CatalogError, match="Duplicate column"):
        catalog.create("u", [Column("x", INT64), Column("x", VARCHAR)])
    catalog.create("v", [Column("x", INT64), Column("X", VARCHAR)])  # names are case-sensitive


def test_state_survives_reopening(spark, catalog):
    t = tables.register(catalog, "t", spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string"))
    again = Catalog(spark, catalog.root)
    assert again.get(t) == catalog.get(t)
    assert sorted(tables.scan(spark, again.snapshot(t)).collect()) == [(1, "a"), (2, "b")]


def test_drop_waits_for_pins(spark, catalog):
    t = tables.register(catalog, "t", spark.range(3).withColumnRenamed("id", "x"))
    (path,) = catalog.get(t).data_files
    catalog.pin(t, "one")
    catalog.pin(t, "two")
    catalog.drop(t)
    assert not catalog.exists("t") and catalog.is_pending_deletion(t) and os.path.exists(path)
    catalog.unpin(t, "one")
    assert catalog.active_pins(t) == 1 and os.path.exists(path)
    catalog.unpin(t, "two")
    assert not catalog.is_pending_deletion(t) and not os.path.exists(path)
    catalog.create("t", COLUMNS)  # the name is free


def test_crash_before_cleanup(spark, catalog):
    t = tables.register(catalog, "t", spark.range(3).withColumnRenamed("id", "x"))
    (path,) = catalog.get(t).data_files
    catalog.pin(t, "reader of a process that ends")
    catalog.drop(t)
    Catalog(spark, catalog.root)
    assert not os.path.exists(path)


def test_pinned_context(catalog):
    t = catalog.create("t", COLUMNS)
    with catalog.pinned(t):
        assert catalog.active_pins(t) == 1
    assert catalog.active_pins(t) == 0


def test_types(spark):
    df = spark.createDataFrame([(1, 2, "a", 0.5)], "a int, b short, c string, d double")
    with pytest.raises(TypeError, match="'d'"):
        columns_of(df)
    assert project_supported(df).dtypes == [("a", "bigint"), ("b", "bigint"), ("c", "string")]
