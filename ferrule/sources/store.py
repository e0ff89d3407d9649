"""Keyed tables in a folder: upserts, deletions and updates as new snapshots."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ferrule.operators import changes


class Store:
    """Tables as numbered Parquet snapshots below ``root``.

    A change reads the newest snapshot and writes the next one; readers of older ones aren't disturbed,
    and a job that is lost leaves no half-written table, since a snapshot counts only once it is complete
    (has ``_SUCCESS``).
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def versions(self, name: str) -> list[int]:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        found = (re.fullmatch(r"v(\d+)", s.getPath().getName()) for s in fs.listStatus(path))
        return sorted(int(m[1]) for m in found if m and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/v{m[1]}/_SUCCESS")))

    def read(self, name: str, version: int | None = None) -> DataFrame:
        known = self.versions(name)
        if not known or version is not None and version not in known:
            raise KeyError(f"no such snapshot: {name} {version if version is not None else ''}".strip())
        return self.spark.read.parquet(f"{self.root}/{name}/v{known[-1] if version is None else version}")

    def write(self, name: str, rows: DataFrame, partition_by: list[str] | None = None) -> int:
        version = (self.versions(name) or [0])[-1] + 1
        out = rows.write.mode("overwrite")
        (out.partitionBy(*partition_by) if partition_by else out).parquet(f"{self.root}/{name}/v{version}")
        return version

    def upsert(self, name: str, rows: DataFrame, key: list[str]) -> int:
        return self.write(name, changes.upsert(self.read(name), rows, key) if self.versions(name) else rows)

    def delete(self, name: str, keys: DataFrame, key: list[str]) -> int:
        return self.write(name, changes.delete_by_key(self.read(name), keys, key))

    def update(self, name: str, updates: DataFrame, key: list[str], columns: list[str]) -> int:
        return self.write(name, changes.update_by_key(self.read(name), updates, key, columns))
