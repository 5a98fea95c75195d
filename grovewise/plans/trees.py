"""Registered queries on name tests, attribute and text nodes, interval labels and what they count."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovewise.operators import axes, construct, intervals
from grovewise.operators.axes import each, step
from grovewise.operators.pathways import path
from grovewise.registry import query
from grovewise.session import table
from grovewise.sources import documents
from grovewise.sources.forest import conversation_forest, region_forest
from grovewise.sources.store import checkpointed


@query("SELECT 'r' || n_regionkey AS region, name, count(*) AS n FROM (SELECT n_regionkey, 'nation' AS name FROM nation UNION ALL SELECT n_regionkey, 'customer' FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT n_regionkey, 'supplier' FROM supplier JOIN nation ON s_nationkey = n_nationkey) GROUP BY ALL")
def path_any_descendant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region/descendant::*: the name test of every axis."""
    f = region_forest(spark, sf_dir, "region", "nation", "customer", "supplier")
    found = step(each(f, "r", "region"), f, "r", "descendant", "*", "x")
    return found.groupBy(F.col("r.id").alias("region"), F.col("x.name").alias("name")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 's' || s_suppkey AS id, 'name' AS attribute, s_name AS value FROM supplier UNION ALL SELECT 's' || s_suppkey, 'balance', s_acctbal::VARCHAR FROM supplier")
def path_any_attribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier/@*: an attribute node for each attribute."""
    f = region_forest(spark, sf_dir, "supplier")
    found = step(each(f, "s", "supplier"), f, "s", "attribute", "*", "a")
    return found.select(F.col("s.id").alias("id"), F.col("a.name").alias("attribute"), F.col("a.value").alias("value"))


@query("SELECT 'n' || n_nationkey AS id FROM nation UNION ALL SELECT 's' || s_suppkey FROM supplier")
def path_any_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = region_forest(spark, sf_dir, "nation", "supplier")
    return step(each(f, "x"), f, "x", "self", "*", "y").select("y.id")


def _labelled(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    return checkpointed(intervals.labelled(region_forest(spark, sf_dir, *names)))


_TREE = """
    WITH f AS (
        SELECT 'r' || r_regionkey AS doc, 'r' || r_regionkey AS id, 'region' AS name, [r_regionkey::BIGINT] AS pos FROM region
        UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey, 'nation', [n_regionkey::BIGINT, n_nationkey::BIGINT] FROM nation
        UNION ALL SELECT 'r' || n_regionkey, 'c' || c_custkey, 'customer', [n_regionkey::BIGINT, n_nationkey::BIGINT, c_custkey::BIGINT] FROM customer JOIN nation ON c_nationkey = n_nationkey
        UNION ALL SELECT 'r' || n_regionkey, 'o' || o_orderkey, 'order', [n_regionkey::BIGINT, n_nationkey::BIGINT, c_custkey::BIGINT, o_orderkey::BIGINT] FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    ), p AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY pos) - 1 AS pre FROM f)
"""


@query(_TREE + ", s AS (SELECT x.doc, x.id, count(*) AS n FROM f x JOIN f y ON x.doc = y.doc AND y.pos[1:len(x.pos)] = x.pos WHERE x.name <> 'order' GROUP BY ALL UNION ALL SELECT doc, id, 1 FROM f WHERE name = 'order') SELECT p.doc, p.id, p.pre::BIGINT AS pre, (p.pre + s.n)::BIGINT AS \"end\" FROM p JOIN s USING (doc, id)")
def interval_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of all nodes in document order and of what comes after their last descendants."""
    # Read once, so not stored: only ids are joined with their numbers.
    return intervals.labelled(region_forest(spark, sf_dir, "region", "nation", "customer", "order")).select("doc", "id", "pre", "end")


@query("SELECT 'c' || o_custkey AS node, 'o' || o_orderkey AS descendant FROM orders UNION ALL SELECT 'n' || c_nationkey, 'o' || o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey UNION ALL SELECT 'r' || n_regionkey, 'o' || o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def interval_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """*/descendant::order as a join of intervals with the places of orders."""
    f = _labelled(spark, sf_dir, "region", "nation", "customer", "order")
    found = step(each(f, "x", "*"), f, "x", "descendant", "order", "o")
    return found.select(F.col("x.id").alias("node"), F.col("o.id").alias("descendant"))


_COUNTS = _TREE + """, c AS (
        SELECT doc, id, pos, name, count(CASE WHEN name = 'customer' THEN 1 END) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
               count(CASE WHEN name = 'customer' THEN 1 END) OVER (PARTITION BY doc) AS total FROM f WHERE name <> 'order'
    ), i AS (SELECT doc, 'n' || c_nationkey AS id, count(*) AS n FROM f JOIN customer ON f.id = 'c' || c_custkey GROUP BY ALL)
    SELECT c.doc, c.id, coalesce(i.n, 0)::BIGINT AS n_inside, (c.total - c.before - coalesce(i.n, 0) - (c.name = 'customer')::INT)::BIGINT AS n_following, c.before::BIGINT AS n_preceding
    FROM c LEFT JOIN i USING (doc, id) WHERE c.name IN ('nation', 'customer')
"""


@query(_COUNTS)
def interval_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many customers lie in, after and before each nation and customer: differences of running counts, no pair."""
    f = _labelled(spark, sf_dir, "region", "nation", "customer")
    customers, bound = each(f, "x", "customer"), each(f.where("name <> 'region'"), "s")
    for axis, into in (("descendant", "n_inside"), ("following", "n_following"), ("preceding", "n_preceding")):
        bound = intervals.structural_count(bound, customers, "s", axis, "x", into)
    return bound.select("s.doc", "s.id", "n_inside", "n_following", "n_preceding")


@query("SELECT o_orderpriority AS doc, o_orderkey AS id, (row_number() OVER w - 1)::BIGINT AS pre, (row_number() OVER w - 1)::BIGINT AS level, (count(*) OVER (PARTITION BY o_orderpriority))::BIGINT AS \"end\" FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderkey)")
def deep_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order lies in the one before it of its priority: trees as deep as a fifth of the orders, labelled from parents
    alone by list ranking."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("doc"), F.col("o_orderkey").alias("id"))
    placed = intervals.ranked_order(o, "doc", [F.col("id")], "id", "n")
    above = placed.select("doc", F.col("id").alias("parent_id"), (F.col("n") + 1).alias("n"))
    nodes = placed.join(above, ["doc", "n"], "left").select("doc", F.col("id").cast("string").alias("id"), F.col("parent_id").cast("string").alias("parent_id"), F.lit(0).cast("long").alias("ord"))
    return intervals.labelled_by_parents(nodes).select("doc", F.col("id").cast("long").alias("id"), "pre", "level", "end")


@query("SELECT 'k' || conv_id || '.' || turn AS id, 'said by ' || role || ': ' AS before, trim(text, ' \t\r\n') AS bold, '. End' AS after FROM conversations WHERE trim(text, ' \t\r\n') <> ''")
def mixed_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A paragraph for each turn, text, bold text, text; written as XML and read again, its parts are in their order."""
    f = conversation_forest(spark, sf_dir)
    turns = each(f.where("name = 'turn' and trim(' \t\r\n' from value) <> ''"), "t")
    E, T = construct.Element, construct.Text
    tree = E("p", T((F.lit("said by "),)), T((F.concat(F.element_at("t.attrs", "role"), F.lit(": ")),)), E("b", T((F.col("t.value"),))), T((F.lit(". End"),)))
    key = F.concat(F.lit("k"), F.substring("t.id", 2, 100))
    made = construct.constructed(turns, key, key, tree, mixed=True)
    # Stored: the step reads them twice.
    again = checkpointed(documents.shredded(documents.serialised(made), "doc", "xml").where("error is null"))
    kids = step(each(again, "p", "p"), again, "p", "child", None, "x").select(F.col("p.doc").alias("id"), "x.ord", F.col("x.value").alias("value"))
    at = lambda n: F.max(F.when(F.col("ord") == n, F.col("value")))
    return kids.groupBy("id").agg(at(0).alias("before"), at(1).alias("bold"), at(2).alias("after"))


@query("SELECT 'r' || n_regionkey AS region, 'o' || o_orderkey AS last_order FROM (SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey) JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE c_mktsegment = 'BUILDING'")
def path_value_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation/customer[@segment = 'BUILDING']/order[last()] as a path that is a value."""
    f = region_forest(spark, sf_dir, "region", "nation", "customer", "order")
    p = path().child("nation").child("customer").where(lambda c: F.element_at(c["attrs"], "segment") == "BUILDING", "segment").child("order").at(-1)
    return p.bind(each(f, "r", "region"), f, "r", "o").select(F.col("r.id").alias("region"), F.col("o.id").alias("last_order"))


@query("SELECT DISTINCT 'r' || n_regionkey AS region, 'n' || n_nationkey AS nation FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_totalprice > 300000 AND c_acctbal > 0")
def path_value_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """//customer[@balance > 0][order[@total > 300000]]/parent::nation: each nation once, by a path inside a filter."""
    f = region_forest(spark, sf_dir, "region", "nation", "customer", "order")
    large = path().child("order").where(lambda o: F.element_at(o["attrs"], "total").cast("double") > 300000, "total")
    p = path().anywhere("customer").where(lambda c: F.element_at(c["attrs"], "balance").cast("double") > 0, "balance").where(large).parent("nation")
    return p.bind(each(f, "r", "region"), f, "r", "n").select(F.col("r.id").alias("region"), F.col("n.id").alias("nation"))


@query("SELECT 's' || s_suppkey AS id, s_suppkey % 7 < 5 AS available, r_name AS region FROM supplier LEFT JOIN region ON r_regionkey = s_suppkey % 7")
def doc_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the document that each supplier names is there, and its root's name where it is."""
    f = region_forest(spark, sf_dir, "region", "supplier")
    name = F.concat(F.lit("r"), F.substring("s.id", 2, 20).cast("long") % 7)
    known = axes.doc_available(each(f, "s", "supplier"), f, name)
    found = axes.opened(known, f, name, "r", "region", outer=True)
    return found.select("s.id", "available", axes.attr("r", "name").alias("region"))


@query("SELECT 'o' || o_orderkey AS id, r_name AS region FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey")
def root_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """root(): the root of each order's tree."""
    f = region_forest(spark, sf_dir, "region", "order")
    return axes.root(each(f, "o", "order"), f, "o", "r").select("o.id", axes.attr("r", "name").alias("region"))
