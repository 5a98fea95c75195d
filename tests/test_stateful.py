"""Stateful streams: after restarts and rows out of order, the results of the batch forms."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from grovewise.operators import temporal
from grovewise.streaming import stateful
from grovewise.streaming.changes import event_stream

T0 = datetime(2024, 1, 1)


def streamed(spark, rows, far, schema, form, tmp_path, parts=3):
    """Rows in ``parts`` files, nearly in the order of time, and one far in the future, a run of the stream after each: every
    run starts from the checkpoint of the one before."""
    rnd = random.Random(1)
    at = next(i for i, x in enumerate(rows[0]) if isinstance(x, datetime))
    rows = sorted(rows, key=lambda r: r[at] + timedelta(minutes=rnd.randint(0, 200)))
    size = -(-len(rows) // parts)
    chunks = [rows[i * size : (i + 1) * size] for i in range(parts)] + [[far]]
    own = stateful.with_timers(spark)
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    for chunk in chunks:
        own.createDataFrame(chunk, schema).coalesce(1).write.mode("append").parquet(source)
        stream = form(event_stream(own, source, own.read.parquet(source).schema))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def test_quiet_ranges_by_a_stream_equal_those_of_the_batch(spark, tmp_path):
    rnd = random.Random(2)
    rows = [(k, T0 + timedelta(minutes=rnd.randint(0, 6000))) for k in (1, 2, 3) for _ in range(25)]
    start, end, quiet, unit = T0, T0 + timedelta(minutes=6500), timedelta(hours=6), timedelta(seconds=1)
    micros = lambda t: int((t - datetime(1970, 1, 1)).total_seconds() * 1_000_000)
    far = (0, T0 + timedelta(days=900))  # moves the watermark past all
    schema = "k long, ts timestamp_ntz"
    got = streamed(spark, rows, far, schema, lambda s: stateful.quiet_ranges(s, ["k"], "ts", micros(start), micros(end), quiet, timedelta(hours=4), unit), tmp_path)
    want = temporal.quiet_ranges(spark.createDataFrame(rows, schema), ["k"], "ts", F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"), quiet, unit)
    assert sorted(map(tuple, got.where("k > 0").collect())) == sorted(map(tuple, want.collect()))


def test_commit_sessions_by_a_stream_equal_those_of_the_batch(spark, tmp_path):
    rnd = random.Random(3)
    rows = sorted({(rnd.choice("ab"), rnd.choice("mn"), rnd.choice("xyz"), T0 + timedelta(minutes=rnd.randint(0, 900))) for _ in range(60)}, key=lambda r: r[::-1])
    schema = "author string, message string, file string, date timestamp_ntz"
    far = ("far", "far", "far", T0 + timedelta(days=900))
    got = streamed(spark, rows, far, schema, lambda s: stateful.commit_sessions(s, timedelta(minutes=30), timedelta(hours=4)), tmp_path)
    want = temporal.commit_sessions(spark.createDataFrame(rows, schema), timedelta(minutes=30))
    columns = ["author", "message", "date", "file", "stretch", "part"]
    assert sorted(map(tuple, got.where("author <> 'far'").select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))


def test_log_streams_go_on_after_a_restart(spark, tmp_path):
    from grovewise.sources import documents
    from grovewise.streaming import changes

    def runs(stream_of, files, form, name):
        folder, out, mark = tmp_path / name, str(tmp_path / f"{name}-out"), str(tmp_path / f"{name}-mark")
        folder.mkdir()
        for i, text in enumerate(files):
            (folder / f"f{i}").write_text(text)
            stream_of(spark, str(folder)).writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
        got = spark.read.parquet(out)
        want = form(str(folder)).select(*got.columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count() > len(files)

    history = ["M 2024-01-02 03:04 u 1.1 f\nbroken\nT 2024-01-02 03:05 v 1.2 g\n", "A 2024-01-03 00:00 u 1.1 h\nX 2024-01-03 00:00 u 1.1 h\nM 2024-01-03 00:01 u 1.3 f\n"]
    runs(changes.history_stream, history, lambda p: documents.history_log(spark.read.text(p)), "history")
    entry = lambda f, n: f"\nRCS file: {f},v\n" + "".join(f"{'-' * 28}\nrevision 1.{i}\ndate: 2024/01/0{i} 00:00:00;  author: u;  commitid: c{i};\nmessage {i}\n" for i in range(1, n + 1))
    logs = [changes.RULER.join([entry("a", 2), entry("b", 1)]), changes.RULER.join([entry("c", 3)])]
    runs(changes.revision_stream, logs, lambda p: documents.revision_log(spark.read.option("lineSep", changes.RULER).text(p)), "revisions")
    stream = changes.latest(changes.snapshot_stream(spark, str(tmp_path / "history")).withColumn("v", F.lit(1)), "doc", "modified", "v")
    kept = {}
    changes.run_once(stream, "complete", each=lambda batch, _: kept.update({r["doc"].split("/")[-1]: r["stamp"] for r in batch.collect()}))
    assert set(kept) == {"f0", "f1"}
