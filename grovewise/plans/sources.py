"""Registered queries on sources and streams."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovewise.operators import axes, snapshots
from grovewise.operators.axes import attr, each, step
from grovewise.registry import query
from grovewise.session import table
from grovewise.sources import documents
from grovewise.sources.forest import conversation_forest, region_forest
from grovewise.sources.store import VersionedTable, checkpointed, shared_folder
from grovewise.plans.changes import END, QUIET, RANGES, START
from grovewise.streaming import changes as streams
from grovewise.streaming import stateful


@query()
def shred_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of all pages by name and depth; HTML isn't well-formed, hence no SQL form."""
    nodes = documents.shredded(table(spark, sf_dir, "pages"), "page_id", "html", html=True).where("error is null")
    return nodes.groupBy("name", F.size("path").alias("depth")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc").alias("n_docs"))


@query("SELECT 'v' || conv_id AS doc, count(*) AS n_turns FROM conversations GROUP BY conv_id")
def shred_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as XML text and read again have their turns back."""
    text = documents.serialised(conversation_forest(spark, sf_dir))
    again = checkpointed(documents.shredded(text, "doc", "xml"))
    return step(each(again, "c", "conversation"), again, "c", "child", "turn", "t").groupBy(F.col("c.doc").alias("doc")).agg(F.count(F.lit(1)).alias("n_turns"))


@query("SELECT 'r' || r_regionkey AS doc, '<region name=\"' || r_name || '\">' || string_agg('<nation name=\"' || n_name || '\"/>', '' ORDER BY n_nationkey) || '</region>' AS xml FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name")
def serialise_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.serialised(region_forest(spark, sf_dir, "region", "nation"))


@query("SELECT 'n' || n_nationkey AS id, 'A' AS kind FROM nation UNION ALL SELECT 'n' || n_nationkey || '>' || 'r' || n_regionkey, 'in' FROM nation UNION ALL SELECT 'r' || r_regionkey, 'B&C' FROM region")
def gxl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph written as GXL and read again through the XML reader."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    a, b = F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey")
    nodes = n.select(a.alias("id"), F.lit("A").alias("kind")).union(r.select(F.concat(F.lit("r"), "r_regionkey"), F.lit("B&C")))
    path = f"{shared_folder(spark)}/gxl-{uuid.uuid4().hex}"
    documents.gxl_lines(nodes, n.select(a.alias("src"), b.alias("dst"), F.lit("in").alias("kind"))).write.text(path)
    back, arcs = documents.read_gxl(spark, path)
    return back.unionByName(arcs.select(F.concat("src", F.lit(">"), "dst").alias("id"), "kind"))


_HISTORY = "SELECT CASE WHEN event_type = 'purchase' THEN 'T' ELSE 'M' END AS code, 'u' || user_id AS author, count(*) AS n, count(DISTINCT date_trunc('minute', ts)) AS n_minutes FROM events WHERE event_id % 10 <> 0 GROUP BY ALL"


def _history_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as history lines, every tenth of them broken."""
    e = table(spark, sf_dir, "events")
    code = F.when(F.col("event_type") == "purchase", "T").otherwise("M")
    line = F.concat_ws(" ", code, F.date_format("ts", "yyyy-MM-dd HH:mm"), F.concat(F.lit("u"), "user_id"), F.lit("1.1"), F.concat(F.lit("f"), "event_id"))
    return e.select(F.when(F.col("event_id") % 10 == 0, F.lit("M broken line")).otherwise(line).alias("value"))


@query(_HISTORY)
def history_log_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as history lines, every tenth of them broken, and parsed again."""
    return documents.history_log(_history_lines(spark, sf_dir)).groupBy("code", "author").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("date").alias("n_minutes"))


@query(_HISTORY)
def stream_history_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lines as files of a folder, read by a stream."""
    folder = f"{shared_folder(spark)}/history-{uuid.uuid4().hex}"
    _history_lines(spark, sf_dir).write.text(folder)
    found = spark.read.parquet(streams.run_once(streams.history_stream(spark, folder, 4), "append"))
    return found.groupBy("code", "author").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("date").alias("n_minutes"))


@query("SELECT p_partkey, p_partkey % 3 = 0 AS inherited FROM part")
def versioned_inherit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second version writes two parts of three and inherits the rest of the first."""
    store = VersionedTable(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    store.commit(store.stage(p))
    store.commit(store.stage(store.inherit(p.where("p_partkey % 3 <> 0"), "p_partkey")))
    return store.read().select("p_partkey", "inherited")


@query("SELECT translate(name, ':-.', '___') AS name, count(*) AS n FROM (SELECT 'uml:' || lower(replace(n_name, ' ', '-')) AS name FROM nation JOIN customer ON c_nationkey = n_nationkey) GROUP BY ALL")
def collapse_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = region_forest(spark, sf_dir, "nation", "customer")
    up = step(each(f, "c", "customer"), f, "c", "parent", "nation", "n")
    named = up.select(F.concat(F.lit("uml:"), F.lower(F.replace(attr("n", "name"), F.lit(" "), F.lit("-")))).alias("name"))
    return documents.collapsed_names(named).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT role, count(*) AS n, count(DISTINCT conv_id) AS n_docs FROM conversations WHERE turn = 0 GROUP BY role")
def first_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversation/turn[1] by role."""
    f = conversation_forest(spark, sf_dir)
    turns = step(each(f, "c", "conversation"), f, "c", "child", "turn", "t").select(F.col("c.id").alias("conversation"), "t")
    first = axes.numbered(turns, "t", ["conversation"]).where("position = 1 and t.ord = 0")
    return first.groupBy(attr("t", "role").alias("role")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("conversation").alias("n_docs"))


_GAPS = "SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events"


@query(f"SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM ({_GAPS})) GROUP BY user_id, s")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions by a stream, closed by a row far in the future, equal those of the batch form."""
    folder = f"{shared_folder(spark)}/events-{uuid.uuid4().hex}"
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    e.repartitionByRange(3, "ts").write.parquet(folder)
    # One row a year later moves the watermark past every session.
    end = e.agg(F.max("event_id").alias("event_id"), F.lit(-1).cast("long").alias("user_id"), (F.max("ts") + F.lit(timedelta(days=365))).alias("ts"))
    end.coalesce(1).write.mode("append").parquet(folder)
    found = streams.sessions(streams.event_stream(spark, folder, e.schema, 10), ["user_id"], "ts", timedelta(hours=6), timedelta(days=40))
    return spark.read.parquet(streams.run_once(found, "append")).where("user_id >= 0")


@query("SELECT user_id, CASE WHEN b.stamp IS NULL THEN 'add' WHEN a.stamp <> b.stamp THEN 'edit' ELSE 'same' END AS action FROM (SELECT user_id, max(ts) AS stamp FROM events GROUP BY user_id) a LEFT JOIN (SELECT user_id, max(ts) AS stamp FROM events WHERE ts < TIMESTAMP '2024-01-28 00:00:00' GROUP BY user_id) b USING (user_id)")
def stream_snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest stamps by user, kept by a stream, against an earlier snapshot."""
    folder, e = f"{shared_folder(spark)}/events-{uuid.uuid4().hex}", table(spark, sf_dir, "events").select("user_id", "ts", "event_type")
    e.repartitionByRange(3, "ts").write.parquet(folder)
    kept: dict[str, DataFrame] = {}

    def keep(batch: DataFrame, _: int) -> None:
        kept["now"] = checkpointed(batch)

    streams.run_once(streams.latest(streams.event_stream(spark, folder, e.schema), "user_id", "ts", "event_type"), "complete", each=keep)
    before = e.where(F.col("ts") < F.to_timestamp_ntz(F.lit("2024-01-28 00:00:00"))).groupBy("user_id").agg(F.max("ts").alias("stamp"))
    return snapshots.snapshot_diff(before, kept["now"], "user_id", "stamp")


@query(RANGES + "SELECT user_id, from_ts, to_ts FROM ranges")
def stream_quiet_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quiet ranges by timers of a stateful stream over three files, out of order within a file, equal those of the batch
    form; a row far in the future moves the watermark past all."""
    own, folder = stateful.with_timers(spark), f"{shared_folder(spark)}/events-{uuid.uuid4().hex}"
    e = table(spark, sf_dir, "events").select("user_id", "ts")
    e.repartitionByRange(3, "ts").write.parquet(folder)
    e.agg(F.lit(-1).cast("long").alias("user_id"), (F.max("ts") + F.lit(timedelta(days=365))).alias("ts")).coalesce(1).write.mode("append").parquet(folder)
    micros = lambda text: round((datetime.fromisoformat(text.split("'")[1]) - datetime(1970, 1, 1)).total_seconds() * 1_000_000)
    found = stateful.quiet_ranges(streams.event_stream(own, folder, e.schema, 10), ["user_id"], "ts", micros(START), micros(END), QUIET, timedelta(days=40), timedelta(seconds=1))
    return spark.read.parquet(streams.run_once(found, "append")).where("user_id >= 0")
