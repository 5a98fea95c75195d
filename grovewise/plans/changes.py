"""Registered queries over change logs and snapshots."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovewise.operators import snapshots, temporal
from grovewise.registry import query
from grovewise.session import table

START, END, QUIET = "TIMESTAMP '2024-01-01 00:00:00'", "TIMESTAMP '2024-02-01 00:00:00'", timedelta(hours=12)


def _at(text: str):
    return F.to_timestamp_ntz(F.lit(text.split("'")[1]))


RANGES = f"""
    WITH p AS (SELECT DISTINCT user_id, ts AS to_ts FROM events WHERE ts >= {START} AND ts < {END} UNION SELECT DISTINCT user_id, {END} FROM events),
    g AS (SELECT user_id, coalesce(lag(to_ts) OVER (PARTITION BY user_id ORDER BY to_ts) + INTERVAL 1 SECOND, {START}) AS from_ts, to_ts FROM p),
    ranges AS (SELECT * FROM g WHERE to_ts - from_ts >= INTERVAL 12 HOUR)
"""


def _ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.quiet_ranges(table(spark, sf_dir, "events"), ["user_id"], "ts", _at(START), _at(END), QUIET, timedelta(seconds=1))


@query(RANGES + "SELECT user_id, from_ts, to_ts FROM ranges")
def quiet_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranges(spark, sf_dir)


_FLAGGED = RANGES + """,
    first AS (SELECT user_id, min(ts) AS f FROM events GROUP BY user_id),
    flagged AS (SELECT r.*, r.from_ts >= f AND (r.from_ts = max(r.from_ts) OVER (PARTITION BY r.user_id) OR EXISTS (
        SELECT 1 FROM events e WHERE e.user_id = r.user_id AND e.event_type = 'purchase' AND e.ts - INTERVAL 1 MINUTE >= r.from_ts AND e.ts - INTERVAL 1 MINUTE < r.to_ts)) AS interesting
        FROM ranges r JOIN first USING (user_id))
"""


def _flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    # A minute before a purchase is the point of interest.
    points = e.where("event_type = 'purchase'").withColumn("ts", F.col("ts") - F.lit(timedelta(minutes=1)))
    return temporal.interesting(_ranges(spark, sf_dir), points, e, ["user_id"], "ts")


@query(_FLAGGED + "SELECT user_id, from_ts, to_ts, interesting FROM flagged")
def interesting_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flagged(spark, sf_dir)


@query("SELECT user_id, CASE WHEN max(ts) + INTERVAL 12 HOUR > TIMESTAMP '2024-01-31 00:00:00' THEN max(ts) + INTERVAL 12 HOUR END AS postpone_until FROM events GROUP BY user_id")
def postpone_until(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.postpone_until(table(spark, sf_dir, "events"), ["user_id"], "ts", QUIET, _at("'2024-01-31 00:00:00'"))


@query(_FLAGGED + """,
    s AS (SELECT user_id % 10 AS scope, user_id, from_ts, to_ts, interesting FROM flagged),
    c AS (SELECT DISTINCT scope, greatest(from_ts, TIMESTAMP '2024-01-03 00:00:00') AS lb, least(to_ts, TIMESTAMP '2024-01-30 00:00:00') AS ub FROM s WHERE interesting),
    k AS (SELECT * FROM c WHERE lb < ub),
    b AS (
        SELECT scope, lb AS b, true AS lower FROM k UNION SELECT scope, ub, false FROM k
        UNION SELECT k.scope, from_ts, true FROM k JOIN s ON s.scope = k.scope AND from_ts >= lb AND from_ts < ub
        UNION SELECT k.scope, to_ts, false FROM k JOIN s ON s.scope = k.scope AND to_ts > lb AND to_ts <= ub),
    h AS (SELECT b.scope, b.b, b.lower, count(DISTINCT s.user_id) AS n FROM b JOIN s ON s.scope = b.scope
          AND ((b.lower AND b.b >= s.from_ts AND b.b < s.to_ts) OR (NOT b.lower AND b.b > s.from_ts AND b.b <= s.to_ts)) GROUP BY ALL)
    SELECT h.scope, min(h.b) AS checkpoint FROM h JOIN (SELECT scope, count(DISTINCT user_id) AS n FROM s GROUP BY scope) t ON t.scope = h.scope AND t.n = h.n GROUP BY h.scope
""")
def mediate_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    scoped = _flagged(spark, sf_dir).withColumn("scope", F.col("user_id") % 10)
    return temporal.mediate(scoped, ["scope"], "user_id", _at("'2024-01-03 00:00:00'"), _at("'2024-01-30 00:00:00'"))


_SESSIONS = "SELECT user_id, event_type, event_id, ts, sum(fresh) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS session FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) < INTERVAL 1 DAY THEN 0 ELSE 1 END AS fresh FROM events)"


@query(f"SELECT user_id, event_type, session::BIGINT AS session, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM ({_SESSIONS}) GROUP BY ALL")
def sessionize_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = temporal.gap_sessions(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", "event_id", timedelta(days=1))
    return rows.groupBy("user_id", "event_type", "session").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n"))


@query()
def synthetic_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions in which a file comes once: sequential within a stretch, hence no SQL form."""
    e = table(spark, sf_dir, "events")
    revisions = e.select(F.col("user_id").cast("string").alias("author"), F.col("event_type").alias("message"), F.get_json_object("props", "$.k").alias("file"), F.col("ts").alias("date"), "event_id")
    return temporal.commit_sessions(revisions, timedelta(days=1)).groupBy("author", "message", "stretch", "part").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("file").alias("n_files"))


@query("SELECT a.event_id AS tag_id, b.event_id AS commit_id FROM events a JOIN events b ON a.user_id = b.user_id AND date_trunc('hour', a.ts) = date_trunc('hour', b.ts) AND a.event_id < b.event_id WHERE regexp_matches(b.props, '\"k\": *[0-9]*[02468]}')")
def log_regex_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal author and truncated time are the join's keys; the pattern is a filter on one side."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.date_trunc("hour", "ts").alias("at"), "props")
    commits = e.where(F.col("props").rlike('"k": *[0-9]*[02468]}')).select("user_id", "at", F.col("event_id").alias("commit_id"))
    tags = e.select("user_id", "at", F.col("event_id").alias("tag_id"))
    return tags.join(commits, ["user_id", "at"]).where("tag_id < commit_id").select("tag_id", "commit_id")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events WHERE ts <= TIMESTAMP '2024-01-15 00:00:00' GROUP BY user_id")
def as_of_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.as_of(table(spark, sf_dir, "events"), "user_id", "ts", _at("'2024-01-15 00:00:00'"), "event_type", "event_id")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20 00:00:00'")
def modified_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.modified_since(table(spark, sf_dir, "events"), "ts", _at("'2024-01-20 00:00:00'")).select("event_id")


_BEFORE = "SELECT p_partkey, p_size AS stamp FROM part WHERE p_partkey % 7 <> 0"
_NOW = "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN p_size + 1 ELSE p_size END AS stamp, p_partkey % 10 = 0 AS is_dir FROM part WHERE p_partkey % 11 <> 0"


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, sf_dir, "part")
    p.createOrReplaceTempView("_part")
    return spark.sql(_BEFORE.replace("FROM part", "FROM _part")), spark.sql(_NOW.replace("FROM part", "FROM _part"))


@query(f"SELECT p_partkey, CASE WHEN a.stamp IS NULL THEN 'add' WHEN b.stamp IS NULL THEN 'delete' WHEN a.stamp <> b.stamp AND NOT is_dir THEN 'edit' ELSE 'same' END AS action FROM ({_BEFORE}) a FULL JOIN ({_NOW}) b USING (p_partkey)")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, now = _versions(spark, sf_dir)
    return snapshots.snapshot_diff(before, now, "p_partkey", "stamp", "is_dir")


@query(f"SELECT p_partkey FROM ({_NOW}) WHERE p_partkey NOT IN (SELECT p_partkey FROM ({_BEFORE}))")
def uninherited(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, now = _versions(spark, sf_dir)
    return snapshots.uninherited(now, before, "p_partkey").select("p_partkey")


@query("SELECT k, CASE WHEN h IS NULL THEN 'added' WHEN w IS NULL THEN 'deleted' ELSE 'matched' END AS state FROM (SELECT DISTINCT o_orderkey || '/' || o_orderstatus AS k, 1 AS h FROM orders) FULL JOIN (SELECT DISTINCT l_orderkey || '/' || l_linestatus AS k, 1 AS w FROM lineitem) USING (k)")
def reconcile_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their status against those of lines."""
    key = lambda k, status: F.concat(F.col(k).cast("string"), F.lit("/"), status).alias("k")
    have, want = table(spark, sf_dir, "orders").select(key("o_orderkey", "o_orderstatus")), table(spark, sf_dir, "lineitem").select(key("l_orderkey", "l_linestatus"))
    return snapshots.reconcile(have, want, "k")


_OLD = "SELECT p_partkey AS id, p_name AS name, p_brand AS brand, p_size AS size FROM part WHERE p_partkey % 3 <> 0"
_NEW = "SELECT p_partkey + 1000000 AS id, CASE WHEN p_partkey % 4 = 0 THEN p_name || '!' ELSE p_name END AS name, p_brand AS brand, CASE WHEN p_partkey % 8 = 1 THEN -p_size ELSE p_size END AS size FROM part WHERE p_partkey % 5 <> 0"
_ONE = "SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY {0}) AS c FROM {1}) WHERE c = 1"
_MATCH = f"""
    WITH o AS ({_OLD}), n AS ({_NEW}),
    m1 AS (SELECT n.id AS new_id, o.id AS old_id FROM ({_ONE.format("name", "n")}) n JOIN ({_ONE.format("name", "o")}) o ON n.name = o.name),
    n2 AS (SELECT * FROM n WHERE id NOT IN (SELECT new_id FROM m1)), o2 AS (SELECT * FROM o WHERE id NOT IN (SELECT old_id FROM m1)),
    m2 AS (SELECT n.id AS new_id, o.id AS old_id FROM ({_ONE.format("brand, size", "n2")}) n JOIN ({_ONE.format("brand, size", "o2")}) o ON n.brand = o.brand AND n.size = o.size),
    m AS (SELECT * FROM m1 UNION ALL SELECT * FROM m2)
"""


def _matched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    table(spark, sf_dir, "part").createOrReplaceTempView("_part")
    old, new = spark.sql(_OLD.replace("FROM part", "FROM _part")), spark.sql(_NEW.replace("FROM part", "FROM _part"))
    return old, new, snapshots.identity_match(old, new, [["name"], ["brand", "size"]], "id")


@query(_MATCH + "SELECT new_id, old_id FROM m")
def identity_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir)[2]


@query(_MATCH + "SELECT new_id AS id, 'edit' AS action FROM m JOIN n ON n.id = new_id JOIN o ON o.id = old_id WHERE n.name <> o.name OR n.size <> o.size UNION ALL SELECT id, 'add' FROM n WHERE id NOT IN (SELECT new_id FROM m) UNION ALL SELECT id, 'delete' FROM o WHERE id NOT IN (SELECT old_id FROM m)")
def change_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new, matches = _matched(spark, sf_dir)
    return snapshots.change_records(old, new, matches, "id", ["name", "size"])


@query("SELECT p_partkey, p_brand AS name, n AS n_holders, serial::INT AS serial FROM (SELECT *, count(*) OVER (PARTITION BY p_brand) AS n, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS serial FROM part) WHERE n > 1 AND serial > 1")
def dup_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("name"))
    return snapshots.duplicate_names(rows, "name", "p_partkey")


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN 'part-' || row_number() OVER (PARTITION BY p_size < 10 ORDER BY p_partkey) ELSE CASE WHEN row_number() OVER (PARTITION BY p_size < 10, p_brand ORDER BY p_partkey) = 1 THEN p_brand ELSE p_brand || '-' || (row_number() OVER (PARTITION BY p_size < 10, p_brand ORDER BY p_partkey) - 1) END END AS unique_name FROM (SELECT p_partkey, p_size, replace(p_brand, '-', '') AS p_brand FROM (SELECT *, regexp_replace(p_brand, '#', '') FROM part))")
def missing_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small parts have no name and get one; repeated brands are numbered."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") >= 10, F.replace("p_brand", F.lit("-"), F.lit(""))).alias("name"))
    return snapshots.dispense_names(rows, "name", "p_partkey", F.lit("part")).select("p_partkey", "unique_name")


@query("""
    WITH own AS (SELECT c_custkey AS k, min('o' || o_orderkey) AS t, count(DISTINCT o_orderkey) AS n FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 300000 GROUP BY 1),
    near AS (SELECT c_custkey AS k, min('s' || s_suppkey) AS t, count(DISTINCT s_suppkey) AS n FROM customer JOIN supplier ON s_nationkey = c_nationkey WHERE s_acctbal > 8000 GROUP BY 1)
    SELECT c_custkey AS ref_id, CASE WHEN own.n = 1 THEN own.t WHEN own.n > 1 THEN NULL WHEN near.n = 1 THEN near.t END AS target,
        CASE WHEN own.n > 0 THEN 'own' WHEN near.n > 0 THEN 'near' END AS scope,
        CASE WHEN own.n > 1 OR (own.n IS NULL AND near.n > 1) THEN 'ambiguous' WHEN own.n IS NULL AND near.n IS NULL THEN 'unresolved' ELSE 'resolved' END AS status
    FROM customer LEFT JOIN own ON own.k = c_custkey LEFT JOIN near ON near.k = c_custkey
""")
def resolve_priority_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ref_id"), F.col("c_nationkey").alias("nation"))
    orders = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' and o_totalprice > 300000").select("o_custkey", F.concat(F.lit("o"), "o_orderkey").alias("target"))
    suppliers = table(spark, sf_dir, "supplier").where("s_acctbal > 8000").select("s_nationkey", F.concat(F.lit("s"), "s_suppkey").alias("target"))
    scopes = [("own", orders, {"ref_id": "o_custkey"}), ("near", suppliers, {"nation": "s_nationkey"})]
    return snapshots.resolve_in_scopes(refs, scopes).drop("nation")
