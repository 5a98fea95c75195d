"""Helpers that several operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What parts words in every contract: runs of the bytes that are neither space nor 0x09 to 0x0D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_temporary: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where it is unset, a temporary folder, but in
    local mode only: executors of a cluster don't see the driver's folders."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        found = _temporary[app] = _temporary.get(app) or "file://" + tempfile.mkdtemp(prefix="grovewise-")
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver's JVM ends."""
    out = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(out)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return out


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: ``df`` as Parquet in the shared folder, so that a lost executor costs no recomputation."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo ``n``."""
    return F.crc32(doc_id.cast("string")) % n


def buckets_for(rows: int, per_bucket: int = 2_000) -> int:
    """How many hash buckets keep about ``per_bucket`` rows each; grows with the table, and is never so few that a hot
    key's buckets leave tasks without work."""
    return max(1024, -(-rows // per_bucket))


def running_sums(df: DataFrame, keys: list[str], order: str, value: str, out: str, span: int = 4096) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over the rows of a smaller ``order`` (an integer) of the same keys.

    In two levels, runs of ``span`` numbers and rows within a run, so that a key with very many rows is no one task's.
    """
    runs = df.withColumn("_run", F.floor(F.col(order) / span))
    whole = runs.groupBy(*keys, "_run").agg(F.sum(value).alias("_whole"))
    whole = whole.withColumn("_before", F.sum("_whole").over(Window.partitionBy(*keys).orderBy("_run")) - F.col("_whole")).drop("_whole")
    within = F.sum(value).over(Window.partitionBy(*keys, "_run").orderBy(order)) - F.col(value)
    return runs.withColumn(out, within).join(whole, [*keys, "_run"]).withColumn(out, F.col(out) + F.col("_before")).drop("_run", "_before")


def text_slices(batch: pa.RecordBatch, column: str | int, rows: int = 512, size: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of at most ``rows`` rows and ``size`` bytes of text, so that a task's working memory doesn't
    follow the length of the texts around; a longer text comes alone."""
    upto = np.append(0, np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, min(at + rows, int(np.searchsorted(upto, upto[at] + size, side="right")) - 1))
        yield batch.slice(at, end - at)
        at = end
