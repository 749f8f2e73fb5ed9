import pytest

from marlstone import queries as core
from tests.oracle import same

SF = "/root/testdata/sf0.001"


def test_every_query_has_sql():
    assert set(core.QUERIES) == set(core.ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_matches_sql(spark, name):
    same(spark, SF, core.QUERIES[name], core.ORACLE_SQL[name])


def test_entry(spark):
    import __spark_entry__

    got = {r["column_name"]: r for r in __spark_entry__.entry(spark).collect()}
    assert got["o_orderkey"]["row_count"] > 0 and got["o_orderstatus"]["column_type"] == "VARCHAR"
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


ODD = ["plain", " lead", "trail ", "\ttab\t", "\nlf\n", "a\r\nb", "a\rb", "end\r", "\r", "nul\0", "\0", '"', 'a"b"\n"c', "bs\\", '\\"', "a,b", ",", "", " ", "　x", None]


def test_odd_texts_survive_csv(spark, tmp_path):
    rows = [(i, t, t) for i, t in enumerate(ODD)] + [(None, "no id", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = core.copy_csv_roundtrip(spark, str(tmp_path)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted(rows, key=repr)


def test_nulls_of_orders_survive_csv(spark, tmp_path):
    rows = [(1, None, "O", " 1-URGENT "), (None, 7, None, ""), (3, 8, '"', None)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    for name, want in (("multi_copy_append", rows * 2), ("copy_extra_fields", [r[:2] for r in rows]), ("copy_column_subset", [(r[0], None, r[2], None) for r in rows])):
        got = [tuple(r) for r in core.QUERIES[name](spark, str(tmp_path)).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)


def test_quoted_loads_are_parallel_and_in_order(spark, tmp_path):
    key, rows = "spark.sql.files.maxPartitionBytes", [(i, i + 7, "O", f"{i % 5}-x, y") for i in range(400)]
    before = spark.conf.get(key)
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string").repartition(4).sortWithinPartitions("o_orderkey").write.parquet(f"{tmp_path}/orders.parquet")
    spark.conf.set(key, "2000")
    try:
        got = core.multi_copy_append(spark, str(tmp_path))
        ids = [r[0] for r in got.collect()]
        assert ids[:400] == ids[400:] and sorted(ids[:400]) == list(range(400))
        parts = [f for f in got.inputFiles() if "part-" in f]
        assert len(parts) >= 8  # several tasks wrote each load
    finally:
        spark.conf.set(key, before)
