"""A table kept as copy-on-write snapshots: upserts write new files and a commit names them; readers resolve the newest commit.

Under a folder lie ``data/<id>/day=...`` (files that never change) and ``_commits/<version>``, one file for each version, which lists
the day folders that make up the table then. A commit file is created only if it isn't there, so of two writers that began from the
same version one fails and starts anew. A job that dies before its commit leaves the table as it was; its files are garbage that
``vacuum`` removes. A reader keeps the version that it began with.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.sources.shared import delete, materialise
from tidewatch.sources.sinks import with_day


class Snapshots:
    """One table of rows with a key, a time in ms, and a schema that stays."""

    def __init__(self, spark: SparkSession, folder: str, key: str, at: str):
        self.spark, self.folder, self.key, self.at = spark, folder.rstrip("/"), key, at
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Versions that were committed, in order."""
        at = self._path(f"{self.folder}/_commits")
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def days(self, version: int | None = None) -> dict[str, str]:
        """Day -> folder of a version, by default the newest. An entry for each day."""
        version = version if version is not None else (self.versions() or [0])[-1]
        if not version:
            return {}
        line = self.spark.read.text(f"{self.folder}/_commits/{version}", wholetext=True).first()
        return json.loads(line[0])

    def read(self, like: DataFrame, version: int | None = None, days: list[str] | None = None) -> DataFrame:
        """The table at a version. like: a DataFrame of the table's schema. days: only these."""
        found = [p for d, p in sorted(self.days(version).items()) if days is None or d in days]
        if not found:
            return like.limit(0)
        return self.spark.read.schema(like.schema).parquet(*found)

    def write(self, rows: DataFrame) -> dict[str, str]:
        """Writes rows by day into a folder of their own; no reader sees them before a commit. Returns day -> folder."""
        path = f"{self.folder}/data/{uuid.uuid4().hex}"
        with_day(rows, self.at).withColumnRenamed("dt", "day").write.partitionBy("day").parquet(path)
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(path))]
        return {n.removeprefix("day="): f"{path}/{n}" for n in names if n.startswith("day=")}

    def commit(self, days: dict[str, str], after: int) -> int:
        """Makes the days the table's next version; fails if another writer has made one since ``after``."""
        new = self._path(f"{self.folder}/_commits/{after + 1}")
        out = self._fs.create(new, False)  # not over an existing file
        try:
            out.write(bytearray(json.dumps(days, sort_keys=True).encode()))
        finally:
            out.close()
        return after + 1

    def upsert(self, rows: DataFrame) -> int:
        """The latest row of each key in the batch replaces the table's; equal times are settled by the rows' contents. Only days that
        hold these keys, before or after, are written anew. Returns the new version."""
        version = (self.versions() or [0])[-1]
        before = self.days(version)
        tie = F.xxhash64(F.to_json(F.struct(*sorted(rows.columns))))
        latest = F.row_number().over(W.partitionBy(self.key).orderBy(F.col(self.at).desc(), tie.desc()))
        rows = materialise(rows.withColumn("_nth", latest).filter("_nth = 1").drop("_nth"), "latest")
        keys = rows.select(self.key)
        old = with_day(self.read(rows, version), self.at)
        moved = old.join(keys, self.key, "left_semi").select("dt").unionByName(with_day(rows, self.at).select("dt")).distinct()
        touched = [r["dt"] for r in moved.collect()]  # days, not rows
        kept = self.read(rows, version, touched).join(keys, self.key, "left_anti")
        new = self.write(kept.unionByName(rows))
        return self.commit({**{d: p for d, p in before.items() if d not in touched}, **new}, version)

    def vacuum(self, keep: int = 1) -> int:
        """Deletes commits but the last ``keep`` ones, and data folders that these don't name; returns how many folders went. Readers of
        older versions and writers under way must have ended."""
        versions = self.versions()
        named = {p.rpartition("/day=")[0].rpartition("/")[2] for v in versions[-keep:] for p in self.days(v).values()}
        at = self._path(f"{self.folder}/data")
        gone = [n for s in (self._fs.listStatus(at) if self._fs.exists(at) else []) if (n := s.getPath().getName()) not in named]
        delete(self.spark, *(f"{self.folder}/_commits/{v}" for v in versions[:-keep]), *(f"{self.folder}/data/{n}" for n in gone))
        return len(gone)
