"""Versioned tables in a folder, and results kept between rounds.

A version is a Parquet directory that is complete before a manifest names it. A commit renames a small file to the next
manifest number, which fails if another commit has taken it; readers open the greatest number. Nothing is overwritten.
"""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


_temporary: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` as the cluster names it; a temporary folder only where it is unset in local mode, as in
    tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        found = _temporary[app] = _temporary.get(app) or "file://" + tempfile.mkdtemp(prefix="grovewise-shared-")
    return found.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage by a table in the shared folder, which outlives executors."""
    path = f"{shared_folder(df.sparkSession)}/rounds-{uuid.uuid4().hex}"
    spark = df.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def observed(df: DataFrame, **metrics: Column) -> tuple[DataFrame, dict]:
    """``checkpointed``, and aggregates of the rows that were taken while they were written: no job of their own."""
    watch = Observation()
    stored = checkpointed(df.observe(watch, *[m.alias(k) for k, m in metrics.items()]))
    return stored, watch.get


class VersionedTable:
    """A table with versions: ``commit`` adds one, ``read`` opens any, ``abort`` drops an unfinished one."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _manifest(self) -> dict:
        root = self._path(self.path)
        names = [f.getPath().getName() for f in self._fs.listStatus(root)] if self._fs.exists(root) else []
        numbers = [int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json")]
        if not numbers:
            return {"versions": []}
        return json.loads(self.spark.read.text(f"{self.path}/manifest-{max(numbers)}.json", wholetext=True).first()[0])

    def versions(self) -> list[int]:
        return [v["version"] for v in self._manifest()["versions"]]

    def stage(self, df: DataFrame) -> str:
        """Write a candidate; it is invisible until committed."""
        name = f"data-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        return name

    def commit(self, staged: str) -> int:
        now = self._manifest()
        version = 1 + max((v["version"] for v in now["versions"]), default=0)
        now["versions"].append({"version": version, "data": staged})
        own = self._path(f"{self.path}/.manifest-{uuid.uuid4().hex}")
        out = self._fs.create(own)
        out.write(bytearray(json.dumps(now).encode()))
        out.close()
        if not self._fs.rename(own, self._path(f"{self.path}/manifest-{version}.json")):
            raise RuntimeError(f"version {version} was committed by another writer")
        return version

    def abort(self, staged: str) -> None:
        self._fs.delete(self._path(f"{self.path}/{staged}"), True)

    def read(self, version: int | None = None) -> DataFrame:
        found = [v for v in self._manifest()["versions"] if version in (None, v["version"])]
        if not found:
            raise ValueError(f"no version {version} in {self.path}")
        return self.spark.read.parquet(f"{self.path}/{found[-1]['data']}")

    def inherit(self, df: DataFrame, key: str) -> DataFrame:
        """``df`` and the rows of the last version whose key it doesn't have, marked as inherited."""
        new = df.withColumn("inherited", F.lit(False))
        if not self.versions():
            return new
        old = self.read().drop("inherited").join(df.select(key), key, "left_anti")
        return new.unionByName(old.withColumn("inherited", F.lit(True)))

    def wipe_if(self, condition: bool) -> bool:
        """Delete all versions if the predicate, usually an aggregate of the caller's, holds."""
        if condition:
            self._fs.delete(self._path(self.path), True)
        return condition
