"""Structured Streaming forms of the change-log operators, each with the results of its batch form."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovewise.sources.documents import history_log, revision_log
from grovewise.sources.store import shared_folder

#: Fixed value: what stands between the entries of revision logs.
RULER = "=" * 77 + "\n"


def event_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def history_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """History logs of a folder as they come, as by ``documents.history_log``. Files that were read are kept in the stream's
    checkpoint, so a restart goes on after them; the folder may be in any store that Spark reads."""
    return history_log(spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path))


def revision_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Revision logs of a folder as they come, as by ``documents.revision_log``: entries are parted by a ruler of equal signs."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).option("lineSep", RULER).text(path)
    return revision_log(lines)


def snapshot_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """(doc, modified) of the files of a folder as they come: what ``latest`` keeps and ``snapshot_diff`` compares. A file that is
    changed in place isn't seen again by the file source, one that is put under another name is."""
    found = spark.readStream.format("binaryFile").option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", "true").schema("path string, modificationTime timestamp, length long, content binary").load(path)
    return found.select(F.col("path").alias("doc"), F.col("modificationTime").alias("modified"))


def sessions(events: DataFrame, keys: list[str], ts: str, gap: timedelta, late: timedelta) -> DataFrame:
    """(keys, first_ts, last_ts, n) of sessions: rows less than ``gap`` after the one before; state is dropped once the
    watermark, ``late`` behind the newest row, has passed a session's end.

    Session windows join rows up to and without the gap, which is the strict comparison of the batch form.
    """
    stamped = events.withColumn("_at", F.col(ts).cast("timestamp")).withWatermark("_at", f"{int(late.total_seconds())} seconds")
    window = F.session_window("_at", f"{int(gap.total_seconds())} seconds")
    out = stamped.groupBy(*keys, window.alias("w")).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("n"))
    return out.select(*keys, "first_ts", "last_ts", "n")


def latest(events: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """(key, stamp, value) as of the newest row of each key: the state that snapshots are compared by."""
    return events.groupBy(key).agg(F.max(ts).alias("stamp"), F.max_by(value, ts).alias(value))


def run_once(stream: DataFrame, mode: str, out: str | None = None, each: Callable[[DataFrame, int], None] | None = None) -> str | None:
    """Process what is there and stop; the checkpoint lies in the shared folder."""
    spark = stream.sparkSession
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True)
    if each is not None:
        writer.foreachBatch(each).start().awaitTermination()
        return None
    out = out or f"{root}/out"
    writer.format("parquet").option("path", out).start().awaitTermination()
    return out
