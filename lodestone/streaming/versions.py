"""A versioned table that streams upsert into, each batch once: rows first, then one atomic commit that names them and the batch.

A batch is written to a folder of its own, and then counts from the moment its commit file appears under its final name, a rename that fails where the
name is taken. The commit holds the folders that make the table and the last batch of every stream. A batch that comes again (its number is not above the
last one of its stream) changes nothing, whether the job died before the commit (nothing of it counted) or after it (all of it did).

Batches are deltas, merged by key when the table is read: columns of `update` take the last value, the others the first; a row whose `status` has become
one of `terminal` keeps it, whatever comes later. `compact` writes the merged rows as one folder; `vacuum` removes folders that no commit names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another writer has made this version."""


class VersionedTable:
    """path: the table's folder; keys: its key; update: columns that later rows replace (all but the keys by default)."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], update: list[str] | None = None, status: str | None = None, terminal: tuple[str, ...] = ()):
        self.spark, self.path, self.keys, self.status, self.terminal = spark, path.rstrip("/"), keys, status, terminal
        self.schema = spark.createDataFrame([], schema).schema
        self.rest = [c for c in self.schema.names if c not in keys]
        self.update = self.rest if update is None else update
        self._kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema)

    def _fs(self, name: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def versions(self) -> list[int]:
        fs, where = self._fs("_commits")
        if not fs.exists(where):
            return []
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(where) if s.getPath().getName().isdigit())

    def commit_of(self, version: int | None = None) -> dict:
        """version, folders [(name, order)], batches {stream: last number}."""
        at = max(self.versions(), default=0) if version is None else version
        if not at:
            return {"version": 0, "folders": [], "batches": {}}
        return json.loads("\n".join(r.value for r in self.spark.read.text(f"{self.path}/_commits/{at}").collect()))

    def _commit(self, told: dict) -> None:
        """Make the next version: its file is written aside and renamed."""
        fs, aside = self._fs(f"_commits/.{uuid.uuid4().hex}")
        out = fs.create(aside, False)
        out.write(bytearray(json.dumps(told).encode()))
        out.close()
        _, final = self._fs(f"_commits/{told['version']}")
        if fs.exists(final) or not fs.rename(aside, final):
            fs.delete(aside, False)
            raise Conflict(f"version {told['version']} of {self.path} is there already")

    def deltas(self, version: int | None = None) -> DataFrame:
        told = self.commit_of(version)
        parts = [self.spark.read.schema(self._kinds).parquet(f"{self.path}/{name}").withColumn("_v", F.lit(order)) for name, order in told["folders"]]
        out = self.spark.createDataFrame([], f"{self._kinds}, _v int")
        for p in parts:
            out = out.unionByName(p)
        return out

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the latest by default: one aggregation by key that combines before its shuffle."""
        rows = self.deltas(version)
        if self.terminal:
            ended = F.min(F.when(F.col(self.status).isin(*self.terminal), F.col("_v"))).alias("_end")
            rows = rows.join(rows.groupBy(*self.keys).agg(ended).where("_end is not null"), self.keys, "left").where("_end is null or _v <= _end").drop("_end")
        pick = lambda c: (F.max_by if c in self.update else F.min_by)(F.struct(c), "_v")[c].alias(c)  # noqa: E731  in a struct a null counts
        return rows.groupBy(*self.keys).agg(*[pick(c) for c in self.rest]).select(*self.schema.names)

    def upsert(self, batch: DataFrame, number: int, stream: str = "batch", order: list[str] | None = None, before_commit: Callable[[], None] | None = None) -> bool:
        """Merge a batch; False if it is in the table already. order: of rows of one key inside the batch, the last by these columns counts.

        before_commit is called between the two steps, for tests.
        """
        told = self.commit_of()
        if number <= told["batches"].get(stream, -1):
            return False
        rows = batch
        if order:
            others = [c for c in self.schema.names if c not in self.keys]
            rows = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_r")).select(*self.keys, "_r.*")
        name = f"delta-{uuid.uuid4().hex}"
        rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema]).write.parquet(f"{self.path}/{name}")
        if before_commit:
            before_commit()
        version = told["version"] + 1
        self._commit({"version": version, "folders": [*told["folders"], [name, version]], "batches": told["batches"] | {stream: number}})
        return True

    def sink(self, stream: str, order: list[str] | None = None, before_commit: Callable[[], None] | None = None) -> Callable[[DataFrame, int], None]:
        """What foreachBatch takes."""
        return lambda batch, number: self.upsert(batch, number, stream, order, before_commit) and None

    def compact(self) -> None:
        """The merged rows as one folder, in a version of its own; batches stay known."""
        told = self.commit_of()
        name = f"base-{uuid.uuid4().hex}"
        self.read().write.parquet(f"{self.path}/{name}")
        self._commit({"version": told["version"] + 1, "folders": [[name, told["version"] + 1]], "batches": told["batches"]})

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete the folders that none of the last `keep` versions names, and older commits; no stream may be writing. Returns their names."""
        versions = self.versions()
        named = {name for v in versions[-keep:] for name, _ in self.commit_of(v)["folders"]}
        fs, root = self._fs("")
        gone = [s.getPath() for s in fs.listStatus(root) if s.isDirectory() and s.getPath().getName() != "_commits" and s.getPath().getName() not in named]
        for p in gone:
            fs.delete(p, True)
        for v in versions[:-keep]:
            fs.delete(self._fs(f"_commits/{v}")[1], False)
        return sorted(p.getName() for p in gone)
