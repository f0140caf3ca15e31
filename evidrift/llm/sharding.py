"""Immutable shards with size-tiered compaction and a versioned manifest.

A store is a folder. Each append writes its rows as small immutable Parquet shards. Shards fall into tiers by size: tier t holds
those of SMALLEST * FANOUT**t bytes and more. Once a tier has FANOUT shards below the target size, compaction merges the
tier's shards into files of about the target size, and goes on until no tier is that full. Every change is one new version of the manifest, a file that lists the
live shards; it is written aside and renamed into place, and the rename fails if another writer has taken that version, so readers see whole versions only and a
lost executor or driver leaves at most files that no manifest names. An append that loses the race commits again on top of the winner; a merge does so if its shards are all still live, and else
gives its files up. Vacuum removes the versions before the last with the shards that only they list, and files that no version has ever listed once they are older than any writer could still be at work on.

Defined results: rows are kept as they are, nulls, empty texts, repeats and extra columns included; an empty frame appends no shard;
frames of different columns may be appended, columns that a shard lacks read as null, and a column that comes with another type is an error. Texts of any length are kept whole, rows are never
compared, and where a column is named like those that `read` adds for the place, the added one gets an underscore.

Plan: appends are narrow. Compaction shuffles nothing: Spark's file scan packs small files into partitions of the target size, and each
becomes one file. The manifest has one line a shard, bytes and path, and is the only thing the driver holds.
"""

from __future__ import annotations

import json
import math
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import unused

SMALLEST = 1 << 20
FANOUT = 4
TARGET = 128 << 20


class Conflict(RuntimeError):
    """Another writer has committed the version first."""


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target: int = TARGET, fanout: int = FANOUT):
        self.spark, self.root, self.target, self.fanout = spark, root.rstrip("/"), target, fanout
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, at: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{at}" if at else self.root)

    def _names(self, at: str) -> list:
        path = self._path(at)
        return list(self._fs.listStatus(path)) if self._fs.exists(path) else []

    def version(self) -> int:
        """The last committed version, 0 for a store without any."""
        return max((int(s.getPath().getName()[1:-5]) for s in self._names("manifest") if s.getPath().getName().endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> tuple[StructType, list[dict]]:
        version = self.version() if version is None else version
        if not version:
            return StructType(), []
        lines = [r.value for r in self.spark.read.text(f"{self.root}/manifest/v{version:08d}.json").collect()]
        found = [json.loads(x) for x in lines]
        head = next(x for x in found if "schema" in x)
        return StructType.fromJson(head["schema"]), sorted((x for x in found if "path" in x), key=lambda x: x["ordinal"])

    def _commit(self, base: int, schema: StructType, shards: list[dict]) -> int:
        lines = [json.dumps({"schema": schema.jsonValue(), "version": base + 1})]
        lines += [json.dumps({"path": s["path"], "bytes": s["bytes"], "tier": self.tier(s["bytes"]), "ordinal": i}) for i, s in enumerate(shards)]
        aside, place = self._path(f"manifest/.{uuid.uuid4().hex}"), self._path(f"manifest/v{base + 1:08d}.json")
        out = self._fs.create(aside, False)
        out.write(bytearray("\n".join(lines).encode()))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), self._conf).rename(aside, place, options)
        except Exception as e:
            self._fs.delete(aside, False)
            raise Conflict(f"version {base + 1} exists") from e
        return base + 1

    def tier(self, size: int) -> int:
        return max(0, int(math.log(max(size, 1) / SMALLEST, self.fanout))) if size > SMALLEST else 0

    def _write(self, df: DataFrame, rows: int = 0) -> list[dict]:
        at = f"data/{uuid.uuid4().hex}"
        df.write.option("maxRecordsPerFile", rows).parquet(f"{self.root}/{at}")
        found = [(s.getPath().getName(), s.getLen()) for s in self._names(at)]
        return [{"path": f"{at}/{name}", "bytes": size} for name, size in sorted(found) if name.startswith("part-")]

    def _widened(self, schema: StructType, df: DataFrame) -> StructType:
        own = {f.name: f for f in schema}
        for f in df.schema:
            if own.setdefault(f.name, f).dataType != f.dataType:
                raise ValueError(f"column {f.name} is {own[f.name].dataType.simpleString()}, not {f.dataType.simpleString()}")
        return StructType([*own.values()])

    def append(self, df: DataFrame, rows: int = 4096, tries: int = 20) -> int:
        """Writes df as shards of at most so many rows and commits them, again if other writers come first; returns the version."""
        self._widened(self.manifest()[0], df)
        added = self._write(df, rows) if df.columns else []
        if added and all(x["bytes"] < 4096 for x in added) and self.spark.read.schema(df.schema).parquet(*(f"{self.root}/{x['path']}" for x in added)).isEmpty():
            added = []
        for left in reversed(range(tries)):
            base = self.version()
            schema, shards = self.manifest(base)
            try:
                return self._commit(base, self._widened(schema, df), [*shards, *added])
            except Conflict:
                if not left:
                    raise
        raise AssertionError

    def compact(self) -> int:
        """Merges full tiers until there are none; returns the version. A tier that the session cannot pack into fewer files is left as it is."""
        stalled: set[int] = set()
        while True:
            base = self.version()
            schema, shards = self.manifest(base)
            tiers: dict[int, list[dict]] = {}
            for s in shards:
                if s["bytes"] <= self.target // 2:
                    tiers.setdefault(self.tier(s["bytes"]), []).append(s)
            full = [t for t, own in sorted(tiers.items()) if len(own) >= self.fanout and t not in stalled]
            if not full:
                return base
            merged = tiers[full[0]]
            packed = self._merge(schema, merged)
            if len(packed) >= len(merged) or not self._replace(merged, packed):
                self._delete(packed)
                if len(packed) >= len(merged):
                    stalled.add(full[0])

    def _replace(self, merged: list[dict], packed: list[dict]) -> bool:
        """Commits packed in place of merged, on whatever version is the last, unless another writer has removed some of merged."""
        gone = {s["path"] for s in merged}
        while True:
            base = self.version()
            schema, shards = self.manifest(base)
            if not gone <= {s["path"] for s in shards}:
                return False
            try:
                self._commit(base, schema, [*(s for s in shards if s["path"] not in gone), *packed])
                return True
            except Conflict:
                continue

    def _delete(self, shards: list[dict]) -> None:
        for s in shards:
            self._fs.delete(self._path(s["path"]), False)

    def _merge(self, schema: StructType, shards: list[dict]) -> list[dict]:
        """One file of each partition into which the scan packs the shards."""
        packing = self.spark.newSession()  # settings of the merge alone
        packing.conf.set("spark.sql.files.maxPartitionBytes", str(self.target))
        packing.conf.set("spark.sql.files.openCostInBytes", "0")
        packing.conf.set("spark.sql.files.minPartitionNum", str(max(1, math.ceil(sum(s["bytes"] for s in shards) / self.target))))
        return self._write(packing.read.schema(schema).parquet(*(f"{self.root}/{s['path']}" for s in shards)))

    def vacuum(self, orphan_age_s: float = 86_400) -> None:
        """Deletes the versions before the last and the files that they list and the last does not; of files that no version lists, which a writer
        may yet commit, only those older than orphan_age_s."""
        last = self.version()
        live = {s["path"] for s in self.manifest(last)[1]}
        listed: set[str] = set()
        for s in self._names("manifest"):
            name = s.getPath().getName()
            if name.startswith("v") and name.endswith(".json") and int(name[1:-5]) < last:
                listed |= {x["path"] for x in self.manifest(int(name[1:-5]))[1]}
                self._fs.delete(s.getPath(), False)
        oldest = (time.time() - orphan_age_s) * 1000
        for folder in self._names("data"):
            at = f"data/{folder.getPath().getName()}"
            for s in self._names(at):
                path = f"{at}/{s.getPath().getName()}"
                if path not in live and (path in listed or s.getModificationTime() < oldest):
                    self._fs.delete(s.getPath(), False)

    def read(self, version: int | None = None, place: bool = False) -> DataFrame:
        """The rows of a version; with place, also shard (its ordinal) and shard_bytes."""
        version = self.version() if version is None else version
        schema, shards = self.manifest(version)
        empty = self.spark.createDataFrame([], schema)
        shard, size, file = (unused(empty, c) for c in ("shard", "shard_bytes", "file"))
        if not shards:
            return empty.withColumns({shard: F.lit(0), size: F.lit(0).cast("bigint")}) if place else empty
        out = self.spark.read.schema(schema).parquet(*(f"{self.root}/{s['path']}" for s in shards))
        if not place:
            return out
        listed = self.spark.read.schema("path string, bytes bigint, ordinal int").json(f"{self.root}/manifest/v{version:08d}.json").where("path is not null")
        listed = listed.select(F.element_at(F.split("path", "/"), -1).alias(file), F.col("ordinal").alias(shard), F.col("bytes").alias(size))
        hint = F.broadcast if len(shards) <= 100_000 else lambda x: x
        return out.withColumn(file, F.col("_metadata.file_name")).join(hint(listed), file).drop(file)
