from marlstone.service.cli import inspect
from marlstone.sources import storage, tables
from marlstone.streaming.ingest import follow
from marlstone.types import INT64, Column


def test_follow_a_folder(spark, catalog, tmp_path):
    table = catalog.create("t", [Column("n", INT64)])
    folder, state = str(tmp_path / "in"), str(tmp_path / "state")
    for part in ([1, 2], [3]):
        spark.createDataFrame([(n,) for n in part], "n long").coalesce(1).write.mode("append").parquet(folder)
        follow(spark, catalog, table, folder, state).awaitTermination()
    follow(spark, catalog, table, folder, state).awaitTermination()  # nothing new
    assert [r[0] for r in tables.scan(spark, catalog.snapshot(table), ordered=True).collect()] == [1, 2, 3]


def test_inspect(spark, tmp_path):
    path = str(tmp_path / "f")
    storage.write(storage.with_rows(spark.createDataFrame([(1, "ab"), (3, "c")], "n long, t string")), path)
    text = inspect(spark, path)
    assert "n (INT64): average 2.00" in text and "t: VARCHAR, 2 rows" in text
