"""Sharding: size-tiered compaction of immutable shards under versioned manifests.

Arrivals are appended as small Parquet shards. Compaction groups shards by size
tier and merges ``fan_in`` or more of one tier into files of about the target
size; the small rest of the last tiers is merged when ``final`` is asked for.
Each step ends with a new manifest: a JSON file that is created only if its
version does not exist yet, so of two writers one commits and one fails.
Readers see the newest complete manifest; shards that no manifest names are
dropped by ``vacuum``.

All files go through Spark's file systems. Rows are kept as they are, repeated
and null ones too; an empty arrival adds no shard; a store without shards reads as an empty table.
"""

from __future__ import annotations

import json
import math
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

TARGET, SMALLEST, FAN_IN, PER_JOB = 128 << 20, 1 << 20, 4, 256


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _list(self, folder: str):
        path = self._path(folder)
        return [(s.getPath().toString(), s.getPath().getName(), s.getLen()) for s in self.fs.listStatus(path)] if self.fs.exists(path) else []

    def version(self) -> int:
        return max((int(n[1:-5]) for _, n, _ in self._list(f"{self.root}/manifests") if n.startswith("v") and n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if version == 0:
            return {"version": 0, "schema": None, "shards": []}
        stream = self.fs.open(self._path(f"{self.root}/manifests/v{version}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, parent: int, shards: list[dict], schema: str) -> int:
        """Writes manifest parent + 1 under another name and renames it; fails if that version exists."""
        name = f"{self.root}/manifests/v{parent + 1}.json"
        draft = self._path(f"{self.root}/manifests/.{uuid.uuid4().hex}")
        stream = self.fs.create(draft, False)
        stream.write(bytearray(json.dumps({"version": parent + 1, "parent": parent, "schema": schema, "shards": shards}), "utf-8"))
        stream.close()
        if self.fs.exists(self._path(name)) or not self.fs.rename(draft, self._path(name)):
            self.fs.delete(draft, False)
            raise RuntimeError(f"another writer has committed version {parent + 1}")
        return parent + 1

    def _write(self, df: DataFrame, tier: int) -> list[dict]:
        run = f"{self.root}/shards/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(run)
        return [{"path": p, "bytes": size, "tier": tier} for p, n, size in self._list(run) if n.startswith("part-")]

    def append(self, df: DataFrame) -> int:
        """Adds a table's partitions as shards, as they lie."""
        now = self.manifest()
        schema = now["schema"] or df.schema.json()
        if json.loads(schema)["fields"] and [f["name"] for f in json.loads(schema)["fields"]] != df.columns:
            raise ValueError("an arrival must have the store's columns")
        return self.commit(now["version"], now["shards"] + self._write(df, 0), schema)

    def compact(self, target: int = TARGET, smallest: int = SMALLEST, fan_in: int = FAN_IN, final: bool = False) -> bool:
        """One round: merges tiers that have enough shards; False if there is nothing to merge."""
        now = self.manifest()
        tiers: dict[int, list[dict]] = {}
        for s in now["shards"]:
            if s["bytes"] < target * 3 // 4:
                tiers.setdefault(max(0, math.ceil(math.log(max(1, s["bytes"]) / smallest, fan_in))), []).append(s)
        if final:
            tiers = {0: [s for t in tiers.values() for s in t]}
        groups: list[list[dict]] = []
        for _, shards in sorted(tiers.items()):
            if len(shards) < (2 if final else fan_in):
                continue
            group, size = [], 0
            for s in sorted(shards, key=lambda s: (s["bytes"], s["path"])):
                if group and size + s["bytes"] > target:
                    groups.append(group)
                    group, size = [], 0
                group, size = [*group, s], size + s["bytes"]
            groups.append(group)
        groups = [g for g in groups if len(g) > 1]
        if not groups:
            return False
        made: list[dict] = []
        schema = T.StructType.fromJson(json.loads(now["schema"]))
        for k in range(0, len(groups), PER_JOB):
            parts = [self.spark.read.schema(schema).parquet(*[s["path"] for s in g]).coalesce(1) for g in groups[k : k + PER_JOB]]
            made += self._write(reduce(DataFrame.union, parts), 1 + max(s["tier"] for g in groups[k : k + PER_JOB] for s in g))
        gone = {s["path"] for g in groups for s in g}
        self.commit(now["version"], [s for s in now["shards"] if s["path"] not in gone] + made, now["schema"])
        return True

    def compact_all(self, **sizes) -> int:
        while self.compact(**sizes):
            self.vacuum()
        while self.compact(final=True, **sizes):
            self.vacuum()
        return self.version()

    def vacuum(self) -> None:
        """Deletes shards that the newest manifest does not name. Only while no reader holds an older one."""
        kept = {s["path"] for s in self.manifest()["shards"]}
        for run, _, _ in self._list(f"{self.root}/shards"):
            files = {p for p, n, _ in self._list(run) if n.startswith("part-")}
            if not files & kept:
                self.fs.delete(self._path(run), True)
            else:
                for p in files - kept:
                    self.fs.delete(self._path(p), False)

    def read(self, version: int | None = None) -> DataFrame:
        found = self.manifest(version)
        if not found["shards"]:
            return self.spark.createDataFrame([], T.StructType.fromJson(json.loads(found["schema"])) if found["schema"] else T.StructType())
        return self.spark.read.schema(T.StructType.fromJson(json.loads(found["schema"]))).parquet(*[s["path"] for s in found["shards"]])
