"""Registered queries over forests: axes, predicates, positions, sets, bindings and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovewise.functions import values
from grovewise.operators import axes, bindings
from grovewise.operators.axes import attr, each, step
from grovewise.registry import query
from grovewise.session import table
from grovewise.sources.forest import conversation_forest, region_forest


@query("SELECT 'c' || c_custkey AS customer, 'o' || o_orderkey AS child FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def path_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = region_forest(spark, sf_dir, "customer", "order")
    found = step(each(f, "c", "customer").where(attr("c", "segment") == "BUILDING"), f, "c", "child", "order", "o")
    return found.select(F.col("c.id").alias("customer"), F.col("o.id").alias("child"))


@query("SELECT 'r' || n_regionkey AS region, count(*) AS n_orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderpriority = '1-URGENT' GROUP BY n_regionkey")
def path_descendant(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = region_forest(spark, sf_dir, "region", "order")
    urgent = f.where((F.col("name") != "order") | (F.element_at("attrs", "priority") == "1-URGENT"))
    found = step(each(f, "r", "region"), urgent, "r", "descendant", "order", "o")
    return found.groupBy(F.col("r.id").alias("region")).agg(F.count(F.lit(1)).alias("n_orders"))


@query("SELECT 'n' || n_nationkey AS nation, count(*) AS n FROM (SELECT n_nationkey, c_custkey FROM nation JOIN customer ON c_nationkey = n_nationkey UNION ALL SELECT n_nationkey, s_suppkey FROM nation JOIN supplier ON s_nationkey = n_nationkey UNION ALL SELECT n_nationkey, NULL FROM nation) GROUP BY n_nationkey")
def path_descendant_or_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = region_forest(spark, sf_dir, "nation", "customer", "supplier")
    return step(each(f, "n", "nation"), f, "n", "descendant-or-self", None, "d").groupBy(F.col("n.id").alias("nation")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT 'n' || c_nationkey AS nation FROM customer WHERE c_acctbal < 0")
def path_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = region_forest(spark, sf_dir, "nation", "customer")
    poor = each(f, "c", "customer").where(attr("c", "balance").cast("double") < 0)
    return axes.distinct_nodes(step(poor, f, "c", "parent", "nation", "n"), "n").select(F.col("n.id").alias("nation"))


@query("SELECT 'o' || o_orderkey AS order_id, 'r' || n_regionkey AS ancestor, 'region' AS name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'o' || o_orderkey, 'n' || c_nationkey, 'nation' FROM orders JOIN customer ON o_custkey = c_custkey UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, 'customer' FROM orders")
def path_ancestor(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = region_forest(spark, sf_dir, "region", "nation", "customer", "order")
    found = step(each(f, "o", "order"), f, "o", "ancestor", None, "a")
    return found.select(F.col("o.id").alias("order_id"), F.col("a.id").alias("ancestor"), F.col("a.name").alias("name"))


@query("SELECT 'n' || n_nationkey AS node, 'n' || n_nationkey AS ancestor FROM nation UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation")
def path_ancestor_or_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = region_forest(spark, sf_dir, "region", "nation")
    return step(each(f, "n", "nation"), f, "n", "ancestor-or-self", None, "a").select(F.col("n.id").alias("node"), F.col("a.id").alias("ancestor"))


@query("SELECT 'n' || n_nationkey AS id, n_name AS name FROM nation WHERE n_name LIKE '%A%'")
def path_attribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = region_forest(spark, sf_dir, "nation")
    found = step(each(f, "n", "nation"), f, "n", "attribute", "name", "name")
    return found.where(F.col("name").contains("A")).select(F.col("n.id").alias("id"), "name")


@query("SELECT 'o' || a.o_orderkey AS node, 'o' || b.o_orderkey AS sibling FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND b.o_orderkey > a.o_orderkey")
def path_siblings_following(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = region_forest(spark, sf_dir, "order")
    return step(each(f, "o", "order"), f, "o", "following-sibling", "order", "s").select(F.col("o.id").alias("node"), F.col("s.id").alias("sibling"))


@query("SELECT 'o' || a.o_orderkey AS node, count(*) AS n_before FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND b.o_orderkey < a.o_orderkey GROUP BY a.o_orderkey")
def path_siblings_preceding(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = region_forest(spark, sf_dir, "order")
    found = step(each(f, "o", "order"), f, "o", "preceding-sibling", "order", "s")
    return found.groupBy(F.col("o.id").alias("node")).agg(F.count(F.lit(1)).alias("n_before"))


@query("SELECT 'n' || a.n_nationkey AS node, count(*) AS n_after FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND b.n_nationkey > a.n_nationkey JOIN customer ON c_nationkey = b.n_nationkey GROUP BY a.n_nationkey")
def path_following(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = region_forest(spark, sf_dir, "region", "nation", "customer")
    found = step(each(f, "n", "nation"), f, "n", "following", "customer", "c")
    return found.groupBy(F.col("n.id").alias("node")).agg(F.count(F.lit(1)).alias("n_after"))


@query("SELECT 'n' || a.n_nationkey AS node, count(*) AS n_before FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND b.n_nationkey < a.n_nationkey JOIN customer ON c_nationkey = b.n_nationkey GROUP BY a.n_nationkey")
def path_preceding(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = region_forest(spark, sf_dir, "region", "nation", "customer")
    found = step(each(f, "n", "nation"), f, "n", "preceding", "customer", "c")
    return found.groupBy(F.col("n.id").alias("node")).agg(F.count(F.lit(1)).alias("n_before"))


_RANKED = "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders"


def _orders_by_customer(spark: SparkSession, sf_dir: str, reverse: bool = False) -> DataFrame:
    f = region_forest(spark, sf_dir, "customer", "order")
    found = step(each(f, "c", "customer"), f, "c", "child", "order", "o")
    keyed = found.select(F.col("c.id").alias("customer"), F.struct("o.doc", "o.pos", "o.id").alias("o"))
    return axes.numbered(keyed, "o", ["customer"], reverse, "position", "n")


@query(f"SELECT 'c' || o_custkey AS customer, 'o' || o_orderkey AS first_order FROM ({_RANKED}) WHERE p = 1")
def path_positional_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders_by_customer(spark, sf_dir).where("position = 1").select("customer", F.col("o.id").alias("first_order"))


@query(f"SELECT 'c' || o_custkey AS customer, 'o' || o_orderkey AS last_order, n FROM ({_RANKED}) WHERE p = n")
def path_positional_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders_by_customer(spark, sf_dir).where("position = n").select("customer", F.col("o.id").alias("last_order"), "n")


@query(f"SELECT 'c' || o_custkey AS customer, 'o' || o_orderkey AS third_from_end FROM ({_RANKED}) WHERE n - p = 2")
def path_positional_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders_by_customer(spark, sf_dir, reverse=True).where("position = 3").select("customer", F.col("o.id").alias("third_from_end"))


@query(f"SELECT 'c' || o_custkey AS customer, 'o' || o_orderkey AS order_id FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS q FROM ({_RANKED}) WHERE p > 1) WHERE q = 2")
def path_predicate_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order[position() > 1][2]: the second predicate numbers what the first has left."""
    left = _orders_by_customer(spark, sf_dir).where("position > 1").drop("position", "n")
    return axes.numbered(left, "o", ["customer"]).where("position = 2").select("customer", F.col("o.id").alias("order_id"))


@query("SELECT 'r' || n_regionkey AS region, 'c' || c_custkey AS customer FROM (SELECT n_regionkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS p FROM customer JOIN nation ON c_nationkey = n_nationkey) WHERE p = 2")
def path_grouped_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """//customer[2] counts within each parent, not within the result."""
    f = region_forest(spark, sf_dir, "region", "customer")
    found = step(each(f, "r", "region"), f, "r", "descendant", "customer", "c")
    keyed = found.select(F.col("r.id").alias("region"), F.col("c.parent_id").alias("parent"), F.struct("c.doc", "c.pos", "c.id").alias("c"))
    return axes.numbered(keyed, "c", ["region", "parent"]).where("position = 2").select("region", F.col("c.id").alias("customer"))


@query("SELECT 'c' || c_custkey AS customer FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def pred_general_exists_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer[order/@priority = '1-URGENT']: some order has it."""
    f = region_forest(spark, sf_dir, "customer", "order")
    urgent = f.where((F.col("name") == "order") & (F.element_at("attrs", "priority") == "1-URGENT")).select(F.col("parent_id").alias("p"))
    return axes.exists(each(f, "c", "customer"), urgent, F.col("c.id") == F.col("p")).select(F.col("c.id").alias("customer"))


@query("SELECT 'c' || c_custkey AS customer FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority <> '1-URGENT')")
def pred_general_ne(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer[order/@priority != '1-URGENT']: some order differs, which isn't the opposite of equality."""
    f = region_forest(spark, sf_dir, "customer", "order")
    other = f.where((F.col("name") == "order") & (F.element_at("attrs", "priority") != "1-URGENT")).select(F.col("parent_id").alias("p"))
    return axes.exists(each(f, "c", "customer"), other, F.col("c.id") == F.col("p")).select(F.col("c.id").alias("customer"))


@query("SELECT 'o' || o_orderkey AS order_id, o_totalprice > 200000 AS large FROM orders WHERE o_orderstatus = 'O' AND (o_totalprice > 200000 OR o_orderpriority = '5-LOW') AND NOT o_orderpriority = '2-HIGH'")
def pred_and_or_not(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = region_forest(spark, sf_dir, "order")
    total = attr("o", "total").cast("double")
    keep = (attr("o", "status") == "O") & ((total > 200000) | (attr("o", "priority") == "5-LOW")) & ~(attr("o", "priority") == "2-HIGH")
    return each(f, "o", "order").where(keep).select(F.col("o.id").alias("order_id"), (total > 200000).alias("large"))


@query("SELECT 'c' || c_custkey AS id FROM customer WHERE c_acctbal >= 9000")
def pred_value_cmp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value comparison with an empty side is empty, hence null and dropped."""
    return each(region_forest(spark, sf_dir, "region", "customer"), "c").where(attr("c", "balance").cast("double") >= 9000).select("c.id")


@query("SELECT 'c' || c_custkey AS customer FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def quant_some(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = region_forest(spark, sf_dir, "customer", "order")
    large = each(f, "o", "order").where(attr("o", "total").cast("double") > 300000).select(F.col("o.parent_id").alias("p"))
    return axes.exists(each(f, "c", "customer"), large, F.col("c.id") == F.col("p")).select(F.col("c.id").alias("customer"))


@query("SELECT 'c' || c_custkey AS customer FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND NOT o_totalprice > 50000)")
def quant_every(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = region_forest(spark, sf_dir, "customer", "order")
    orders = each(f, "o", "order").select(F.col("o.parent_id").alias("p"), attr("o", "total").cast("double").alias("total"))
    return axes.every(each(f, "c", "customer"), orders, F.col("c.id") == F.col("p"), F.col("total") > 50000).select(F.col("c.id").alias("customer"))


@query("SELECT 'n' || a.n_nationkey AS node, count(*) AS n_later FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey GROUP BY a.n_nationkey")
def node_order_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """$a << $b within a document, counted from ranks."""
    found = axes.later_in_document(region_forest(spark, sf_dir, "nation")).where("n_later > 0")
    return found.select(F.col("id").alias("node"), F.col("n_later").cast("long").alias("n_later"))


@query("SELECT 'r' || n_regionkey AS doc, 'n' || n_nationkey AS id, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey))::BIGINT AS rank FROM nation")
def doc_order_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = axes.document_rank(region_forest(spark, sf_dir, "region", "nation"))
    return f.where("name = 'nation'").select("doc", "id", F.col("rank").cast("long").alias("rank"))


@query("SELECT 'c' || c_custkey AS id, n_name AS found FROM customer JOIN nation ON c_nationkey = n_nationkey")
def nearest_with_attribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = region_forest(spark, sf_dir, "region", "nation", "customer")
    plain = f.withColumn("attrs", F.when(F.col("name") == "customer", F.create_map().cast("map<string,string>")).otherwise(F.col("attrs")))
    return axes.nearest(each(plain, "c", "customer"), plain, "c", "name").select(F.col("c.id").alias("id"), attr("found", "name").alias("found"))


def _by_nation(spark: SparkSession, sf_dir: str, name: str, least: float) -> DataFrame:
    f = region_forest(spark, sf_dir, name)
    return each(f, "x", name).where(attr("x", "balance").cast("double") > least).select(F.col("x.parent_id").alias("id")).distinct()


_NATIONS = ("SELECT DISTINCT 'n' || c_nationkey AS id FROM customer WHERE c_acctbal > 9500", "SELECT DISTINCT 'n' || s_nationkey AS id FROM supplier WHERE s_acctbal > 5000")


@query(f"{_NATIONS[0]} UNION {_NATIONS[1]}")
def set_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bindings.union(_by_nation(spark, sf_dir, "customer", 9500), _by_nation(spark, sf_dir, "supplier", 5000))


@query(f"{_NATIONS[0]} INTERSECT {_NATIONS[1]}")
def set_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bindings.intersect(_by_nation(spark, sf_dir, "customer", 9500), _by_nation(spark, sf_dir, "supplier", 5000))


@query(f"{_NATIONS[0]} EXCEPT {_NATIONS[1]}")
def set_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bindings.minus(_by_nation(spark, sf_dir, "customer", 9500), _by_nation(spark, sf_dir, "supplier", 5000))


@query("SELECT 'n' || n_nationkey AS id FROM nation WHERE n_regionkey IN (1, 2) UNION ALL SELECT 'r0' UNION ALL SELECT 'c' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 3")
def set_topmost(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = region_forest(spark, sf_dir, "region", "nation", "customer")
    chosen = f.where("(name = 'region' and id = 'r0') or (name = 'nation' and doc in ('r0', 'r1', 'r2')) or name = 'customer' and doc in ('r1', 'r3')")
    return bindings.topmost(chosen).select("id")


@query("SELECT 'n' || n_nationkey AS id, i::BIGINT AS i FROM nation, generate_series(2, n_regionkey + 2) t(i)")
def range_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2 to @region + 2; an empty range where the end is below the start."""
    n = table(spark, sf_dir, "nation")
    span = values.integer_range(F.lit(2), F.col("n_regionkey") + 2)
    return n.select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("id"), F.explode(span).alias("i"))


@query("SELECT 1 AS branch, r_name AS item FROM region UNION ALL SELECT 2, n_name FROM nation UNION ALL SELECT 1, r_name FROM region WHERE r_regionkey < 2")
def seq_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b, a[...]): duplicates stay; the branch carries the order."""
    r, n = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    first = r.select(F.lit(1).alias("branch"), F.col("r_name").alias("item"))
    return first.unionByName(n.select(F.lit(2).alias("branch"), F.col("n_name").alias("item"))).unionByName(r.where("r_regionkey < 2").select(F.lit(1).alias("branch"), F.col("r_name").alias("item")))


@query("SELECT 'c' || c_custkey AS customer, CASE WHEN c_acctbal < 0 THEN 'n' || c_nationkey ELSE 'o' || o_orderkey END AS item FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND c_acctbal >= 0 WHERE c_acctbal < 0 OR o_orderkey IS NOT NULL")
def cond_if(spark: SparkSession, sf_dir: str) -> DataFrame:
    """if (@balance < 0) then .. else order: the union of two filtered branches."""
    f = region_forest(spark, sf_dir, "nation", "customer", "order")
    poor = attr("c", "balance").cast("double") < 0
    found = bindings.choose(each(f, "c", "customer"), poor, lambda c: step(c, f, "c", "parent", None, "x"), lambda c: step(c, f, "c", "child", "order", "x"))
    return found.select(F.col("c.id").alias("customer"), F.col("x.id").alias("item"))


@query("SELECT 'n' || n_nationkey AS id, 'nation' AS name, n_name AS label FROM nation UNION ALL SELECT 'r' || r_regionkey, 'region', r_name FROM region UNION ALL SELECT 's' || s_suppkey, 'other', NULL FROM supplier")
def typeswitch_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = region_forest(spark, sf_dir, "region", "nation", "supplier")
    known = F.col("name").isin("region", "nation")
    return f.select("id", F.when(known, F.col("name")).otherwise("other").alias("name"), F.when(known, F.element_at("attrs", "name")).alias("label"))


@query("SELECT l_partkey AS ref, p_name AS name, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL")
def id_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Space-separated id lists are split, exploded and looked up by an equi-join."""
    items = table(spark, sf_dir, "lineitem").select(F.concat_ws(" ", F.col("l_partkey").cast("string")).alias("refs"))
    refs = items.select(F.explode(F.split("refs", " ")).alias("ref")).select(F.col("ref").cast("long"))
    return refs.join(table(spark, sf_dir, "part"), F.col("ref") == F.col("p_partkey")).groupBy("ref", F.col("p_name").alias("name")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey AS id FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)")
def id_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").where("o_totalprice > 450000")
    return axes.lacks(c, o, F.col("c_custkey") == F.col("o_custkey")).select(F.col("c_custkey").alias("id"))


@query("SELECT n_name AS nation, c_custkey AS customer, count(*) AS n_orders FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey WHERE n_regionkey = 1 GROUP BY ALL")
def join_multi_for_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = region_forest(spark, sf_dir, "nation", "customer", "order")
    c = step(each(f, "n", "nation").where("n.doc = 'r1'"), f, "n", "child", "customer", "c")
    o = step(c, f, "c", "child", "order", "o")
    return o.groupBy(attr("n", "name").alias("nation"), F.substring("c.id", 2, 20).cast("long").alias("customer")).agg(F.count(F.lit(1)).alias("n_orders"))


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def join_for_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "k")
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), "n_name")
    return bindings.for_one(c, n, ["k"]).select("c_custkey", "n_name")


@query("SELECT c_nationkey AS nation, string_agg('c' || c_custkey, ',' ORDER BY 'c' || c_custkey) AS members FROM customer GROUP BY c_nationkey")
def join_for_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.concat(F.lit("c"), F.col("c_custkey")).alias("id"))
    return bindings.for_all(c, ["nation"], "id", "members").select("nation", F.array_join("members", ",").alias("members"))


@query("SELECT DISTINCT c_mktsegment AS segment, o_orderpriority AS priority FROM customer JOIN orders ON o_custkey = c_custkey")
def with_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("k"))
    o = c.join(table(spark, sf_dir, "orders"), F.col("k") == F.col("o_custkey")).select("segment", F.col("o_orderpriority").alias("priority"))
    return bindings.with_distinct(c.select("segment").distinct(), o, ["segment"], "priority")


_BOUND = "SELECT c_custkey AS k, string_agg(o_orderpriority, ',' ORDER BY o_orderpriority) AS items FROM customer {} JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey"


@query(_BOUND.format(""))
def with_some(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderpriority")
    return bindings.with_some(c, o, ["k"], "o_orderpriority", "items").select("k", F.array_join("items", ",").alias("items"))


@query("SELECT k, coalesce(items, '') AS items FROM (" + _BOUND.format("LEFT") + ")")
def with_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderpriority")
    return bindings.with_any(c, o, ["k"], "o_orderpriority", "items").select("k", F.array_join("items", ",").alias("items"))


@query("SELECT l_returnflag AS flag, count(*) AS n, max(l_quantity) AS most, min(l_quantity) AS least, round(avg(l_quantity), 4) AS mean, max(CASE WHEN l_linestatus = 'O' THEN l_linenumber END) AS last_open, greatest(0, coalesce(max(CASE WHEN l_quantity > 1000 THEN l_linenumber END), 0)) AS floor, bool_and(l_discount < 0.2) AS modest FROM lineitem GROUP BY l_returnflag")
def agg_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """count, max, min, avg, conditional max, max with a default, every."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(
        F.count(F.lit(1)).alias("n"), F.max("l_quantity").alias("most"), F.min("l_quantity").alias("least"), F.round(F.avg("l_quantity"), 4).alias("mean"),
        F.max(F.when(F.col("l_linestatus") == "O", F.col("l_linenumber"))).alias("last_open"),
        F.greatest(F.lit(0), F.coalesce(F.max(F.when(F.col("l_quantity") > 1000, F.col("l_linenumber"))), F.lit(0))).alias("floor"),
        F.bool_and(F.col("l_discount") < 0.2).alias("modest"),
    )


@query("SELECT conv_id, string_agg(role, '/' ORDER BY turn, role) AS joined FROM conversations GROUP BY conv_id")
def agg_string_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = conversation_forest(spark, sf_dir)
    turns = each(f, "t", "turn").select(F.substring("t.doc", 2, 20).cast("long").alias("conv_id"), F.struct("t.ord", attr("t", "role").alias("role")).alias("key"), attr("t", "role").alias("role"))
    return bindings.joined_text(turns, ["conv_id"], "role", "key", "/")


@query("SELECT user_id, CASE WHEN min(event_type) = max(event_type) THEN min(event_type) END AS event_type, min(event_type) <> max(event_type) AS conflict FROM events GROUP BY user_id")
def agg_exactly_one_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bindings.exactly_one(table(spark, sf_dir, "events"), ["user_id"], "event_type")


@query("SELECT c_nationkey AS nation, to_json(list({k: c_custkey, s: c_mktsegment} ORDER BY c_custkey))::VARCHAR AS members FROM customer GROUP BY c_nationkey")
def agg_nested_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = F.array_sort(F.collect_list(F.struct(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("s"))))
    return table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.to_json(members).alias("members"))


@query("""
    WITH e AS (SELECT *, floor(value)::BIGINT % 4 AS s FROM events),
    a AS (SELECT * FROM e JOIN (SELECT user_id AS u, greatest(0, coalesce(max(CASE WHEN event_type = 'error' THEN event_id END), 0)) AS f FROM e GROUP BY user_id) ON user_id = u WHERE event_id >= f),
    b AS (SELECT a.* FROM a JOIN (SELECT user_id AS u2, greatest(0, max(s)) AS t FROM a GROUP BY user_id) ON user_id = u2 WHERE s >= t)
    SELECT user_id, event_id, s AS specificity FROM b WHERE event_id = (SELECT max(event_id) FROM b x WHERE x.user_id = b.user_id)
""")
def deconflict_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("specificity", F.floor("value") % 4)
    return bindings.winners(e, "user_id", F.col("event_type") == "error", "specificity", "event_id").select("user_id", "event_id", "specificity")
