"""A log of snapshots: each is a folder of its own, and exists for readers once its manifest stands in the log.

A manifest's name is its version. It is written aside and renamed to that name, which fails where the name is taken:
of two writers that start from one version the second loses and says so. A folder without a manifest (a writer that
died, or lost) is never read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class LostRace(RuntimeError):
    """Another writer has committed the version that this one was to be."""


class SnapshotLog:
    """root/log/<version>.json and root/data/<name>; versions count from 0."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.root}/{name}")

    def versions(self) -> list[int]:
        folder = self._path("log")
        fs = folder.getFileSystem(self._conf)
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.root}/log/{version:012d}.json", wholetext=True).first()[0])

    def read(self, version: int | None = None) -> DataFrame:
        """The snapshot of a version, the latest if none is given; an error where there is none."""
        known = self.versions()
        if not known or (version is not None and version not in known):
            raise LookupError(f"no finished snapshot {'' if version is None else version} in {self.root}")
        m = self.manifest(known[-1] if version is None else version)
        return self.spark.read.schema(m["schema"]).parquet(f"{self.root}/data/{m['data']}")

    def commit(self, df: DataFrame, parent: int | None = None, check: Callable[[int], None] | None = None) -> int:
        """Writes all rows of df as the version after ``parent`` (the latest, if not given), or none.

        check: given the number of rows that were written, may raise before anything is committed.
        """
        known = self.versions()
        version = (parent if parent is not None else known[-1] if known else -1) + 1
        name, seen = uuid.uuid4().hex, Observation()
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(f"{self.root}/data/{name}")
        rows = seen.get["rows"]
        if check:
            check(rows)
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
        self._publish(json.dumps({"version": version, "data": name, "rows": rows, "schema": schema}), version)
        return version

    def _publish(self, text: str, version: int) -> None:
        aside, at = self._path(f"log/.{uuid.uuid4().hex}"), self._path(f"log/{version:012d}.json")
        out = aside.getFileSystem(self._conf).create(aside, False)
        out.write(bytearray(text.encode()))
        out.close()
        context = self._hadoop.FileContext.getFileContext(at.toUri(), self._conf)
        gateway = self.spark.sparkContext._gateway
        options = gateway.new_array(getattr(gateway.jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(aside, at, options)
        except Exception as e:
            context.delete(aside, False)
            if context.util().exists(at):
                raise LostRace(f"version {version} of {self.root} is another writer's") from e
            raise

    def unfinished(self) -> list[str]:
        """Names of data folders that no manifest stands for."""
        folder = self._path("data")
        fs = folder.getFileSystem(self._conf)
        names = {s.getPath().getName() for s in fs.listStatus(folder)} if fs.exists(folder) else set()
        return sorted(names - {self.manifest(v)["data"] for v in self.versions()})
