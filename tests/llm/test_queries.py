import pytest

import corpus_pipeline
from marlstone.llm import decontaminate, near_join, queries
from tests.oracle import same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, name):
    same(spark, SF, queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


@pytest.mark.parametrize("name", ["op3_jaccard_join", "op4_sharding", "op5_substring_dedup", "op7_mixing", "op9_decontamination"])
def test_every_document_is_in_the_result(spark, name):
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    assert ids(queries.QUERIES[name](spark, SF)) == ids(spark.read.parquet(f"{SF}/documents.parquet"))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES[:3]:
        before, kept = kept, spark.createDataFrame(stage(spark, kept, SF).collect(), docs.schema)
        assert kept.columns == columns and kept.exceptAll(before).isEmpty(), name
    assert near_join.join(kept).filter("component_id != doc_id").isEmpty()
    assert decontaminate.flag(kept, spark.read.parquet(f"{SF}/benchmark.parquet")).filter("n_hit > 0").isEmpty()
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == [*columns, "shard"]
    assert out.select(*columns).distinct().exceptAll(kept).isEmpty()
    assert out.groupBy("doc_id").count().filter("count > 3").isEmpty()


def test_pipeline_of_an_empty_table(spark):
    none = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0
