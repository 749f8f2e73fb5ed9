import os

import pytest
from pyspark.sql import functions as F

from marlstone.llm import sharding
from tests.llm.helpers import frame, odd_texts


@pytest.fixture
def store(spark, tmp_path):
    return sharding.ShardStore(spark, str(tmp_path / "s"), target_bytes=40_000)


def test_round_trip(spark, store):
    df = frame(spark, odd_texts())
    store.append(df.repartition(6))
    store.append(df.limit(5))
    before = sorted(map(repr, df.union(df.limit(5)).select(*df.columns).drop("shard").collect()))
    assert store.compact() >= 3
    got = store.read()
    assert sorted(map(repr, got.drop("shard").collect())) == before
    names = {r[0] for r in got.select("shard").distinct().collect()}
    assert names <= {s["name"].removeprefix("shards/") for s in store.manifest()["shards"]}


def test_tiers_and_sizes(spark, store):
    for i in range(9):
        store.append(spark.range(i * 200, i * 200 + 200).select("id", F.sha2(F.col("id").cast("string"), 256).alias("t")).coalesce(1))
    small = store.manifest()["shards"]
    assert len(small) == 9 and len({s["tier"] for s in small}) == 1
    store.compact()
    merged = store.manifest()["shards"]
    assert len(merged) < 9 and max(s["bytes"] for s in merged) <= 2 * store.target
    assert store.read().select("id").distinct().count() == store.read().count() == 1800
    settled = store.compact()  # what reached the target stays
    assert settled - store.manifest()["version"] == 0


def test_versions_and_expiry(spark, store):
    store.append(spark.range(5))
    store.append(spark.range(5, 8))
    assert store.versions() == [1, 2] and store.read(1).count() == 5 and store.read(2).count() == 8
    store.compact()
    old = [s["name"] for s in store.manifest(2)["shards"]]
    store.expire(keep=1)
    assert store.versions() == [3] and store.read().count() == 8
    assert not any(os.path.exists(f"{store.root}/{n}") for n in old)


def test_other_columns(spark, store):
    store.append(spark.range(3).selectExpr("id", "'x' t"))
    store.append(spark.range(3, 5).selectExpr("id"))
    store.append(spark.range(5, 6).selectExpr("id", "1.5D w", "'y' t"))
    with pytest.raises(ValueError, match="column t"):
        store.append(spark.range(1).selectExpr("1 t"))
    want = [(0, "x", None), (1, "x", None), (2, "x", None), (3, None, None), (4, None, None), (5, "y", 1.5)]
    for _ in range(2):
        assert sorted(tuple(r) for r in store.read().select("id", "t", "w").collect()) == want
        store.compact()


def test_tiers_merge_on(spark, store):
    rows = lambda n: spark.range(n).select("id", F.sha2(F.col("id").cast("string"), 256).alias("t")).coalesce(1)
    for n in [20] * 8 + [120]:
        store.append(rows(n))
    before = {s["tier"] for s in store.manifest()["shards"]}
    store.compact()
    small = [s["tier"] for s in store.manifest()["shards"] if s["tier"]]
    assert len(before) > 1 and len(small) == len(set(small)) and store.read().count() == 280


def test_readers_of_kept_versions(spark, store):
    store.append(spark.range(5))
    store.append(spark.range(5, 8))
    open_version = store.read()
    store.compact()
    spark.range(100).write.parquet(f"{store.root}/shards/crashed")
    store.expire()
    assert open_version.count() == 8 and os.path.exists(f"{store.root}/shards/crashed")
    store.expire(grace=-1)
    assert open_version.count() == 8 == store.read().count() and not os.path.exists(f"{store.root}/shards/crashed")


def test_second_writer_loses(spark, store):
    store.append(spark.range(3))
    base = store.manifest()
    store.commit(base["version"], base["schema"], base["shards"])
    with pytest.raises(sharding.Conflict):
        store.commit(base["version"], base["schema"], [])
    assert store.read().count() == 3
    assert all(n.startswith("v") for n in os.listdir(f"{store.root}/manifests") if not n.startswith("."))
    store.append(spark.range(1))  # an append starts again from the latest version
    assert store.manifest()["version"] == 3 and store.read().count() == 4


def test_leftovers_are_ignored(spark, store):
    store.append(spark.range(3))
    spark.range(100).write.parquet(f"{store.root}/shards/crashed")
    assert store.read().count() == 3


def test_empty_tables(spark, store, tmp_path):
    with pytest.raises(ValueError):
        store.read()
    store.append(spark.range(0))
    store.compact()
    assert store.read().count() == 0
    done = sharding.shard(frame(spark, []).limit(0), str(tmp_path / "other"))
    assert done.read().count() == 0
