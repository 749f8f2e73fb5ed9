import pytest

from marlstone.plans.definitions import Copy, Select, Status, parse
from marlstone.plans.engine import Engine, NotAvailable, QueryMissing
from marlstone.sources.catalog import CatalogError
from marlstone.types import INT64, VARCHAR, Column


@pytest.fixture
def engine(spark, catalog):
    e = Engine(spark, catalog)
    yield e
    e.close()


@pytest.fixture
def table(catalog):
    return catalog.create("t", [Column("id", INT64), Column("name", VARCHAR)])


def file(tmp_path, text):
    (tmp_path / "x.csv").write_text(text)
    return str(tmp_path / "x.csv")


def test_copy_then_select(engine, table, tmp_path, catalog):
    c = engine.submit(Copy(file(tmp_path, "2,b\n1,a\n"), "t"))
    assert engine.wait(c) == Status.COMPLETED and catalog.active_pins(table) == 0
    s = engine.submit(Select("t"))
    assert engine.wait(s) == Status.COMPLETED and catalog.active_pins(table) == 1
    assert engine.fetch(s).wire() == [{"rowCount": 2, "columns": [[2, 1], ["b", "a"]]}]
    assert engine.fetch(s, 1).columns == [[2], ["b"]]
    with pytest.raises(NotAvailable, match="COPY"):
        engine.fetch(c)
    assert dict(engine.list_queries()) == {c: Status.COMPLETED, s: Status.COMPLETED}
    engine.flush(s)
    assert engine.get(s).status == Status.COMPLETED and catalog.active_pins(table) == 0
    with pytest.raises(NotAvailable, match="Result is not available"):
        engine.fetch(s)


def test_result_is_a_snapshot(engine, table, tmp_path, catalog):
    engine.wait(engine.submit(Copy(file(tmp_path, "1,a\n"), "t")))
    s = engine.submit(Select("t"))
    engine.wait(s)
    engine.wait(engine.submit(Copy(file(tmp_path, "2,b\n"), "t")))
    catalog.drop(table)
    assert engine.fetch(s).columns == [[1], ["a"]]  # neither the later load nor the drop shows


def test_refused_at_submission(engine, table):
    with pytest.raises(CatalogError, match="not found"):
        engine.submit(Select("none"))
    with pytest.raises(CatalogError) as e:
        engine.submit(Copy("/no/such.csv", "none"))
    assert len(e.value.problems) == 2


def test_failures(engine, table, tmp_path, catalog):
    bad = engine.submit(Copy(file(tmp_path, "1,a\nx,b\n"), "t"))
    assert engine.wait(bad) == Status.FAILED
    assert engine.error(bad) == "Execution failed: Row 2, column 'id': failed to parse 'x' as INT64"
    plan = engine.submit(Copy(file(tmp_path, "1,a\n"), "t", ("nope",)))
    assert engine.wait(plan) == Status.FAILED and engine.error(plan).startswith("Planning failed: Column 'nope'")
    assert catalog.active_pins(table) == 0 and catalog.get(table).data_files == []
    with pytest.raises(NotAvailable):
        engine.fetch(bad)


def test_unknown_query(engine):
    for call in (engine.get, engine.fetch, engine.error, engine.flush, engine.wait):
        with pytest.raises(QueryMissing):
            call("none")


def test_error_of_a_good_query(engine, table):
    s = engine.submit(Select("t"))
    engine.wait(s)
    with pytest.raises(NotAvailable):
        engine.error(s)
    assert engine.fetch(s).wire() == [{"rowCount": 0, "columns": [[], []]}]


def test_ingest_root(spark, catalog, table, tmp_path):
    engine = Engine(spark, catalog, ingest_root=str(tmp_path / "in"))
    with pytest.raises(CatalogError, match="outside"):
        engine.submit(Copy(file(tmp_path, "1,a\n"), "t"))
    engine.close()


def test_many_at_once(engine, table, tmp_path):
    source = file(tmp_path, "1,a\n2,b\n")
    done = [engine.submit(Copy(source, "t")) for _ in range(5)]
    assert {engine.wait(q) for q in done} == {Status.COMPLETED}
    s = engine.submit(Select("t"))
    engine.wait(s)
    assert engine.fetch(s).row_count == 10


def test_parse():
    both = {"sourceFilepath": "f", "destinationTableName": "t", "tableName": "t"}
    assert parse(both) == Copy("f", "t") and parse({"tableName": "t"}) == Select("t")
    assert parse(both | {"destinationColumns": ["a"], "doesCsvContainHeader": True}).wire()["destinationColumns"] == ["a"]
    for bad in (None, [], {}, {"tableName": 3}, both | {"destinationColumns": "a"}):
        with pytest.raises(ValueError):
            parse(bad)
