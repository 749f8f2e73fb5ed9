"""Sharding by size-tiered compaction, with versioned manifests.

A store is a folder of immutable Parquet shards and of manifests. ``append`` writes arrivals as
they come, one small shard for each task and without a shuffle, and commits a manifest that adds
them. ``compact`` takes the shards below the target size, puts those of similar size (within a
factor of ``FANOUT``) in one tier, and merges each tier's run into files of the target size, then what
came of it with shards of its new tier, until no tier has two: the
merge reads whole shards, packed into tasks by size, so it moves no rows between tasks. A commit
writes the manifest under a temporary name and renames it to the next version; the rename fails
if that version exists, so of two writers one wins and the other starts again, ``TRIES`` times at most.
``expire`` keeps the last versions, so readers of these go on reading, and removes files that no
manifest names, as failed tasks leave them, once they are a day old.

Everything goes through Hadoop's file system classes. A commit is safe on file systems whose rename is
atomic and refuses to overwrite (HDFS, local disks); object stores without such a rename need one writer.
Tasks may be lost and run again: only what Spark's commit protocol lists is registered.

Defined cases: nulls and texts of any length are stored as they are; repeated rows stay repeated;
arrivals with other columns extend the schema, and rows of shards without a column read null there; a
column of another type is an error; an empty table is a version without rows; a column named like the shard
column is replaced in what ``read`` returns.
"""

from __future__ import annotations

import json
import math
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.session import shared_dir

TARGET_BYTES = 128 << 20
FANOUT = 4
TRIES = 20
#: Versions that ``expire`` keeps, and the age in seconds of files without a manifest that it removes.
KEEP, GRACE = 2, 86_400


class Conflict(RuntimeError):
    """Another writer committed this version first."""


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT):
        self.spark, self.root, self.target, self.fanout = spark, root.rstrip("/"), target_bytes, fanout
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)
        self._fs.mkdirs(self._path(f"{self.root}/manifests"))

    def _path(self, p: str):
        return self._jvm.org.apache.hadoop.fs.Path(p)

    def versions(self) -> list[int]:
        names = (s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/manifests")))
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """version, schema (JSON) and shards: name, bytes, tier."""
        known = self.versions()
        if version is None:
            version = known[-1] if known else 0
        if version == 0:
            return {"version": 0, "schema": None, "shards": []}
        stream = self._fs.open(self._path(f"{self.root}/manifests/v{version:010d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def commit(self, base: int, schema: str, shards: list[dict]) -> int:
        version = base + 1
        body = json.dumps({"version": version, "schema": schema, "shards": shards}).encode()
        draft, final = self._path(f"{self.root}/manifests/.{uuid.uuid4().hex}"), self._path(f"{self.root}/manifests/v{version:010d}.json")
        out = self._fs.create(draft, False)
        out.write(bytearray(body))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.getFileSystem(self._conf).getUri(), self._conf)
        options = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(draft, final, options)
        except Py4JJavaError as e:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in str(e.java_exception):
                raise Conflict(f"version {version} exists") from e
            raise
        return version

    def _tier(self, size: int) -> int:
        """0 for shards of the target size, and one more for each factor of ``fanout`` below it."""
        return 0 if size >= self.target / 2 else max(1, math.ceil(math.log(self.target / max(size, 1), self.fanout)))

    def _written(self, folder: str) -> list[dict]:
        found = []
        for s in self._fs.listStatus(self._path(f"{self.root}/{folder}")):
            name, size = s.getPath().getName(), int(s.getLen())
            if name.startswith("part-"):
                found.append({"name": f"{folder}/{name}", "bytes": size, "tier": self._tier(size)})
        return sorted(found, key=lambda x: x["name"])

    def _write(self, df: DataFrame, kind: str) -> list[dict]:
        folder = f"shards/{kind}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(f"{self.root}/{folder}")
        return self._written(folder)

    def _commit(self, change) -> int:
        """Commits what ``change`` makes of the latest manifest: (schema, shards)."""
        for _ in range(TRIES):
            base = self.manifest()
            try:
                return self.commit(base["version"], *change(base))
            except Conflict:
                continue
        raise Conflict(f"other writers were faster {TRIES} times")

    def append(self, df: DataFrame) -> int:
        """Adds the rows of ``df`` as new shards; returns the version."""
        _merged(self.manifest()["schema"], df.schema)  # before anything is written
        new = self._write(df, "run")
        return self._commit(lambda base: (_merged(base["schema"], df.schema), base["shards"] + new))

    def compact(self) -> int:
        """Merges tiers of small shards until none has two; returns the version (the same if there was nothing to do)."""
        while self._compact_once():
            pass
        return self.manifest()["version"]

    def _compact_once(self) -> bool:
        base = self.manifest()
        tiers: dict[int, list[dict]] = {}
        for s in base["shards"]:
            if s["tier"]:
                tiers.setdefault(s["tier"], []).append(s)
        session = self.spark.newSession()
        for k, v in (("maxPartitionBytes", self.target), ("openCostInBytes", 0), ("minPartitionNum", 1)):
            session.conf.set(f"spark.sql.files.{k}", str(v))
        gone, new = set(), []
        for run in tiers.values():
            if len(run) > 1:
                merged = session.read.schema(_schema(base)).parquet(*(f"{self.root}/{s['name']}" for s in run))
                new += self._write(merged, "merged")
                gone |= {s["name"] for s in run}
        if not gone:
            return False

        def change(now):
            if gone - {s["name"] for s in now["shards"]}:
                raise RuntimeError("another compaction took the same shards")
            return now["schema"], [s for s in now["shards"] if s["name"] not in gone] + new

        self._commit(change)
        return len(new) < len(gone)  # else no merge makes these fewer

    def expire(self, keep: int = KEEP, grace: float = GRACE) -> None:
        """Drops all versions but the last ``keep``, the shards that only they name, and old files that no version names."""
        versions = self.versions()
        manifests = {v: self.manifest(v) for v in versions}
        kept = {s["name"] for v in versions[-keep:] for s in manifests[v]["shards"]}
        for v in versions[:-keep]:
            for s in manifests[v]["shards"]:
                if s["name"] not in kept:
                    self._fs.delete(self._path(f"{self.root}/{s['name']}"), False)
            self._fs.delete(self._path(f"{self.root}/manifests/v{v:010d}.json"), False)
        before = (time.time() - grace) * 1000
        folder = self._path(f"{self.root}/shards")
        for d in self._fs.listStatus(folder) if self._fs.exists(folder) else []:
            files = list(self._fs.listStatus(d.getPath())) if d.isDirectory() else []
            old = all(f.getModificationTime() < before for f in [d, *files])
            if old and not any(f"shards/{d.getPath().getName()}/{f.getPath().getName()}" in kept for f in files):
                self._fs.delete(d.getPath(), True)

    def read(self, version: int | None = None, shard: str = "shard") -> DataFrame:
        """The rows of a version, and the name of the shard that holds each."""
        m = self.manifest(version)
        if not m["shards"]:
            raise ValueError("no version has been committed")
        df = self.spark.read.schema(_schema(m)).parquet(*(f"{self.root}/{s['name']}" for s in m["shards"]))
        return df.withColumn(shard, F.concat_ws("/", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2), F.col("_metadata.file_name")))


def _schema(manifest: dict):
    from pyspark.sql.types import StructType

    return StructType.fromJson(json.loads(manifest["schema"]))


def _merged(schema: str | None, new) -> str:
    """The stored schema with the columns that are new, all of them nullable."""
    from pyspark.sql.types import StructField, StructType

    old = StructType.fromJson(json.loads(schema)).fields if schema else []
    fields = {f.name: f for f in old}
    for f in new.fields:
        if f.name not in fields:
            fields[f.name] = StructField(f.name, f.dataType, True)
        elif fields[f.name].dataType.simpleString() != f.dataType.simpleString():
            raise ValueError(f"column {f.name} is {fields[f.name].dataType.simpleString()}, not {f.dataType.simpleString()}")
    return StructType(list(fields.values())).json()


def shard(docs: DataFrame, root: str | None = None, target_bytes: int = TARGET_BYTES) -> ShardStore:
    """Appends ``docs`` to the store at ``root`` (a new one in the shared folder), compacts, expires."""
    spark = docs.sparkSession
    store = ShardStore(spark, root or f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}", target_bytes)
    store.append(docs)
    store.compact()
    store.expire()
    return store
