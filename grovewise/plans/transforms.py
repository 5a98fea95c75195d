"""Registered queries on rules, order and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grovewise.functions import scalars as S
from grovewise.operators import blocks, ordering, rules
from grovewise.operators.axes import attr, each, step
from grovewise.registry import query
from grovewise.session import table
from grovewise.sources.forest import region_forest


def _summary_rules() -> list[rules.Rule]:
    """A document for each region, in it an entry for each nation, in that a flag for rich suppliers: three stages."""

    def reports(b: DataFrame) -> DataFrame:
        key = rules.binding_key("report", F.col("r.id"))
        name = rules.document_name(F.concat(F.lit("reports/"), attr("r", "name"), F.lit(".xml ")), key)
        return rules.inserted(b, key, [F.col("r.id")], [F.col("r.doc")], None, "report", F.create_map(F.lit("of"), F.col("r.id")), doc=name)

    def entries(b: DataFrame) -> DataFrame:
        key = rules.binding_key("entry", F.col("n.id"), F.col("p.id"))
        return rules.inserted(b, key, [F.col("n.id"), F.col("p.id")], [F.col("n.doc"), F.col("p.doc")], None, "entry", F.create_map(F.lit("of"), F.col("n.id")), attr("n", "name"), F.col("n.ord"), under="p")

    def flags(b: DataFrame) -> DataFrame:
        key = rules.binding_key("flag", F.col("s.id"), F.col("e.id"))
        return rules.inserted(b, key, [F.col("s.id"), F.col("e.id")], [F.col("s.doc"), F.col("e.doc")], None, "flag", value=attr("s", "name"), ord_=F.col("s.ord"), under="e")

    rich = rules.For("s", "supplier", lambda _, found: found.where(attr("s", "balance").cast("double") > 9000))
    into = rules.For("e", "entry", lambda bound, found: bound.join(found, F.col("s.parent_id") == attr("e", "of")), target=True)
    page = rules.For("p", "report", lambda bound, found: bound.join(found, F.col("n.parent_id") == attr("p", "of")), target=True)
    # The last rule comes first: it finds its targets in a later cycle.
    return [rules.rule("flag", [rich, into], flags), rules.rule("report", [rules.For("r", "region")], reports), rules.rule("entry", [rules.For("n", "nation"), page], entries)]


_OUT = """
    SELECT 'report' AS name, 'reports/' || r_name || '.xml' AS doc, NULL AS value, NULL AS parent FROM region
    UNION ALL SELECT 'entry', 'reports/' || r_name || '.xml', n_name, 'report' FROM nation JOIN region ON r_regionkey = n_regionkey
    UNION ALL SELECT 'flag', 'reports/' || r_name || '.xml', s_name, 'entry' FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey WHERE s_acctbal > 9000 {}
"""


def _outputs(state: rules.State) -> DataFrame:
    made = each(state.nodes.where(F.col("name").isin("report", "entry", "flag")), "x")
    return step(made, state.nodes, "x", "parent", None, "up", outer=True).select(F.col("x.name").alias("name"), F.col("x.doc").alias("doc"), F.col("x.value").alias("value"), F.col("up.name").alias("parent"))


@query(_OUT.format(""))
def fixpoint_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = rules.run(rules.start(region_forest(spark, sf_dir, "region", "nation", "supplier"), unique=True), _summary_rules())
    return _outputs(state)


@query(_OUT.format("AND s_suppkey % 4 <> 0 UNION ALL SELECT 'flag', 'reports/' || r_name || '.xml', s_name || '*', 'entry' FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey WHERE s_suppkey % 8 = 0"))
def incremental_equals_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth supplier goes, every eighth comes back richer and renamed; outputs follow."""
    base = region_forest(spark, sf_dir, "region", "nation", "supplier")
    state = rules.run(rules.start(base, unique=True), _summary_rules())
    key = F.substring("id", 2, 20).cast("long")
    edited = base.where((F.col("name") == "supplier") & (key % 8 == 0))
    edited = edited.withColumn("attrs", F.create_map(F.lit("name"), F.concat(F.element_at("attrs", "name"), F.lit("*")), F.lit("balance"), F.lit("10000")))
    state = rules.update(state, _summary_rules(), base.where((F.col("name") == "supplier") & (key % 4 == 0)).select("id"), edited)
    return _outputs(state)


@query("SELECT '_report.r' || r_regionkey || '.' AS key, '_report.r' || r_regionkey || '.report.' AS affected FROM region")
def insert_copy_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = rules.run(rules.start(region_forest(spark, sf_dir, "region"), unique=True), _summary_rules()[1:2])
    return state.mods.select("key", "affected")


@query("SELECT DISTINCT 'reports/' || r_name || '.xml' AS doc FROM region")
def create_doc_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.run(rules.start(region_forest(spark, sf_dir, "region"), unique=True), _summary_rules()[1:2]).nodes.where("name = 'report'").select("doc").distinct()


@query("SELECT o_custkey AS parent, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INT AS place FROM orders")
def sort_by_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("parent"), F.col("o_orderkey").alias("id"), "o_totalprice")
    return ordering.sort_by_value(o, "parent", F.col("o_totalprice"), "id", descending=True).select("parent", "id", "place")


@query("SELECT o_orderpriority AS parent, o_orderkey AS id, row_number() OVER (PARTITION BY o_orderpriority ORDER BY f, o_custkey, o_orderkey)::INT AS place FROM (SELECT *, min(o_orderkey) OVER (PARTITION BY o_orderpriority, c_nationkey) AS f FROM orders JOIN customer ON c_custkey = o_custkey)")
def sort_corresponding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a priority follow their customers' order within each nation's document."""
    o = table(spark, sf_dir, "orders")
    children = o.select(F.col("o_orderpriority").alias("parent"), F.col("o_orderkey").alias("id"))
    proxies = o.join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")).select(F.col("o_orderkey").alias("id"), F.col("c_nationkey").alias("doc"), F.array("o_custkey").alias("pos"))
    return ordering.sort_as_corresponding(children, proxies, "parent", "id").select("parent", "id", "place")


_URGENT_FIRST = "SELECT o_custkey AS parent, 'o' || o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority = '1-URGENT' DESC, dense, 'o' || o_orderkey)::INT AS place FROM (SELECT *, CASE WHEN o_orderpriority = '1-URGENT' THEN 0 ELSE dense_rank() OVER (PARTITION BY o_custkey, o_orderpriority = '1-URGENT' ORDER BY o_orderdate) END AS dense FROM orders)"


@query(_URGENT_FIRST)
def order_graph_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By date at a low priority, but urgent orders first at a high one; urgent orders among each other by id."""
    return _urgent_first(table(spark, sf_dir, "orders"))


@query(_URGENT_FIRST)
def order_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the order graph: successive orders by urgency and date at a high priority, against successive ids at a
    low one, which lose wherever they conflict."""
    o = _with_ranks(table(spark, sf_dir, "orders"))
    place = F.row_number().over(Window.partitionBy("parent").orderBy("late", "date", "id"))
    strong = ordering.sequence_edges(o.withColumn("pos", place), "parent", "pos", 2)
    weak = ordering.sequence_edges(o, "parent", "id", 1)
    return ordering.priority_order(o.select("parent", "id"), strong.unionByName(weak), "parent")


def _with_ranks(orders: DataFrame) -> DataFrame:
    """Urgent orders have no date rank, and so only their ids order them; neither constraint can conflict with itself."""
    urgent = F.col("o_orderpriority") == "1-URGENT"
    return orders.select(F.col("o_custkey").alias("parent"), F.concat(F.lit("o"), "o_orderkey").alias("id"), F.when(urgent, 0).when(~urgent, 1).otherwise(2).alias("late"), F.when(~F.coalesce(urgent, F.lit(False)), F.col("o_orderdate")).alias("date"))


def _urgent_first(orders: DataFrame) -> DataFrame:
    return ordering.ranked_order(_with_ranks(orders), "parent", [F.col("late"), F.col("date")]).select("parent", "id", "place")


@query("""
    SELECT p_partkey, upper(p_brand[1]) || p_brand[2:] AS capitalized, replace(replace('<' || p_name || '&">', '&', '&amp;'), '<', '&lt;').replace('>', '&gt;').replace('"', '&quot;') AS escaped,
        CASE WHEN p_size = 1 THEN 'part' ELSE 'parts' END AS plural, p_type AS stripped, CASE WHEN length(p_type) <= 8 THEN p_type ELSE p_type[:8] || '...' END AS truncated,
        replace(p_name, 'a', 'aa') AS replaced, p_partkey || ' of ' || p_brand || ' #{x}' AS expanded,
        CASE WHEN p_size <= 10 THEN ['no', 'one', 'two', 'three', 'four', 'five', 'six', 'seven', 'eight', 'nine', 'ten'][p_size + 1] ELSE p_size::VARCHAR END AS cardinal,
        starts_with(p_type, 'S') AS starts, suffix(p_type, 'EL') AS ends, p_brand[strpos(p_brand, '#') + 1:] AS after_hash, translate(p_brand, '#.', '_') AS translated FROM part
""".replace(".replace('>', '&gt;').replace('\"', '&quot;')", "").replace("replace(replace('<' || p_name || '&\">', '&', '&amp;'), '<', '&lt;')", "replace(replace(replace(replace('<' || p_name || '&\">', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"))
def fn_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    brand, name, kind = F.col("p_brand"), F.col("p_name"), F.col("p_type")
    return table(spark, sf_dir, "part").select(
        "p_partkey", S.capitalize(brand).alias("capitalized"), S.escape_html(F.concat(F.lit("<"), name, F.lit('&">'))).alias("escaped"),
        S.pluralize(F.lit("part"), F.col("p_size")).alias("plural"), S.strip(F.concat(F.lit(" \t"), kind, F.lit("\r\n "))).alias("stripped"), S.truncate(kind, 8).alias("truncated"),
        F.replace(name, F.lit("a"), F.lit("aa")).alias("replaced"), S.expand("#{k} of #{b} #{x}", {"k": F.col("p_partkey"), "b": brand}).alias("expanded"), S.cardinal(F.col("p_size")).alias("cardinal"),
        kind.startswith("S").alias("starts"), kind.endswith("EL").alias("ends"),
        F.when(F.instr(brand, "#") > 0, S.substring_after(brand, "#")).otherwise(brand).alias("after_hash"), F.translate(brand, "#.", "_").alias("translated"),
    )


@query("""
    SELECT user_id, event_id, a / b AS quotient, trunc(a / b)::BIGINT AS whole, CASE WHEN b = 0 THEN NULL ELSE a % b END AS rest, -a AS negated, a AS restored
    FROM (SELECT user_id, event_id, (event_id % 17 - 8)::DOUBLE AS a, (event_id % 5 - 2)::DOUBLE AS b FROM events) WHERE b <> 0
    UNION ALL SELECT user_id, event_id, CASE WHEN event_id % 17 > 8 THEN 'inf'::DOUBLE WHEN event_id % 17 < 8 THEN '-inf'::DOUBLE ELSE 'nan'::DOUBLE END, 0, NULL, -(event_id % 17 - 8)::DOUBLE, (event_id % 17 - 8)::DOUBLE FROM events WHERE event_id % 5 = 2
""")
def fn_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (F.col("event_id") % 17 - 8).cast("double"), (F.col("event_id") % 5 - 2).cast("double")
    known = table(spark, sf_dir, "events").where("event_id is not null")
    return known.select("user_id", "event_id", S.divide(a, b).alias("quotient"), F.coalesce(S.integer_divide(a, b), F.lit(0)).alias("whole"), S.remainder(a, b).alias("rest"), S.sign_run("-+-+-", a).alias("negated"), S.sign_run("--", a).alias("restored"))


@query("""
    WITH w AS (SELECT p_partkey, string_split(p_type, ' ') AS a, string_split(p_name, ' ') AS b, list_transform([p_size, p_size * 2, 3], lambda x: x::DOUBLE) AS n FROM part)
    SELECT p_partkey, len(list_filter(a, lambda x: x LIKE '%E%')) = len(a) AS every_e, len(list_filter(a, lambda x: x LIKE '%E%')) > 0 AS some_e, list_filter(a, lambda x: x LIKE 'S%')[1] AS detected,
        coalesce(list_position(a, 'STEEL'), 0) - 1 AS at, array_to_string(list_transform(a, lambda x: lower(x)), ',') AS mapped, list_sum(n) AS total, array_to_string(list_filter(a, lambda x: x <> 'STEEL'), ',') AS without, a[-1] AS last,
        list_contains(a, 'BRASS') AS contains, array_to_string(a || b, ',') AS appended, array_to_string(flatten(list_transform(a, lambda x: [x, left(x, 1)])), ',') AS mapped_twice, a = b AS equal FROM w
""")
def fn_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.split("p_type", " "), F.split("p_name", " ")
    n = F.array(F.col("p_size").cast("double"), F.col("p_size") * 2.0, F.lit(3.0))
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.forall(a, lambda x: x.contains("E")).alias("every_e"), F.exists(a, lambda x: x.contains("E")).alias("some_e"), S.detect(a, lambda x: x.startswith("S")).alias("detected"),
        S.index_of(a, F.lit("STEEL")).alias("at"), S.commas(F.transform(a, F.lower)).alias("mapped"), S.total(n).alias("total"), S.commas(F.array_remove(a, "STEEL")).alias("without"), S.last(a).alias("last"),
        F.array_contains(a, "BRASS").alias("contains"), S.commas(F.concat(a, b)).alias("appended"), S.commas(S.concat_map(a, lambda x: F.array(x, F.left(x, F.lit(1))))).alias("mapped_twice"), (a == b).alias("equal"),
    )


@query("SELECT s_suppkey, 'a=' || s_suppkey || '&b=x+y&c=' || s_nationkey AS query, s_nationkey::VARCHAR AS merged, 2 AS n_kept, s_suppkey::VARCHAR || ',x y,' || s_nationkey AS vals FROM supplier")
def fn_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    m = F.create_map(F.lit("a"), k, F.lit("b"), F.lit("x y"), F.lit("c"), n)
    holed = F.create_map(F.lit("a"), k, F.lit("b"), F.lit(None).cast("string"), F.lit("c"), n)
    return table(spark, sf_dir, "supplier").select("s_suppkey", S.query_string(m).alias("query"), F.element_at(S.merge(F.create_map(F.lit("a"), k), F.create_map(F.lit("a"), n)), "a").alias("merged"), F.size(S.compact_map(holed)).alias("n_kept"), F.array_join(F.map_values(m), ",").alias("vals"))


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k, '{\"id\":' || event_id || ',\"kind\":\"' || event_type || '\"}' AS rendered FROM events")
def fn_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"), F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"))).alias("rendered"))


@query("SELECT doc_id, to_base64(unhex(md5(text))) AS digest, md5(text) AS hexed FROM documents")
def fn_md5_b64(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", S.md5_base64(F.col("text")).alias("digest"), F.md5(F.col("text").cast("binary")).alias("hexed"))


@query("SELECT p_partkey, replace(replace(replace(p_brand || ' a.b', '-', '--'), '#', '-23-'), ' ', '-20-').replace('.', '-2e-') AS key FROM part".replace("replace(replace(replace(p_brand || ' a.b', '-', '--'), '#', '-23-'), ' ', '-20-').replace('.', '-2e-')", "replace(replace(replace(replace(p_brand || ' a.b', '-', '--'), '#', '-23-'), ' ', '-20-'), '.', '-2e-')"))
def fn_sanitize_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", S.sanitize_ascii(F.concat("p_brand", F.lit(" a.b"))).alias("key"))


@query()
def fn_hmac(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed digests; DuckDB has no HMAC."""
    return table(spark, sf_dir, "part").select("p_partkey", S.hmac_md5("secret")(F.col("p_name")).alias("mac"), S.sanitize_key(F.col("p_type")).alias("key"))


#: A page for each region, in it an entry for each nation, in that a line for each customer in debt, by balance.
DEBTS = [
    {"id": "line", "blocks": [
        {"for each": "c", "name": "customer", "where": "cast(c.attrs['balance'] as double) < 0"}, {"for each": "e", "name": "entry", "on": "e.attrs['of'] = c.parent_id", "target": True},
        {"insert": "line", "attrs": {"of": "c.id", "balance": "c.attrs['balance']"}, "value": "c.attrs['name']", "ord": "c.ord"}]},
    {"id": "page", "blocks": [{"for each": "r", "name": "region"}, {"create-doc": "concat('pages/', r.attrs['name'], '.xml')", "root": "page", "attrs": {"of": "r.id"}}]},
    {"id": "entry", "blocks": [
        {"for each": "n", "name": "nation"}, {"for each": "p", "name": "page", "on": "p.attrs['of'] = n.parent_id", "target": True},
        {"insert": "entry", "attrs": {"of": "n.id"}, "value": "n.attrs['name']", "ord": "n.ord"}]},
    {"id": "by-balance", "blocks": [{"for each": "l", "name": "line"}, {"sort": "l", "by": "cast(l.attrs['balance'] as double)"}]},
]
_DEBTS = """
    WITH c AS ({}), r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey::VARCHAR) AS place FROM c WHERE c_acctbal < 0)
    SELECT 'line' AS name, 'pages/' || r_name || '.xml' AS doc, c_name AS value, place::BIGINT AS place FROM r JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
    UNION ALL SELECT 'entry', 'pages/' || r_name || '.xml', n_name, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey))::BIGINT FROM nation JOIN region ON r_regionkey = n_regionkey
    UNION ALL SELECT 'page', 'pages/' || r_name || '.xml', NULL, 1 FROM region
"""


def _placed(state: rules.State) -> DataFrame:
    """Outputs with their places among their siblings."""
    made = state.nodes.where(F.col("name").isin("page", "entry", "line")).withColumn("parent", F.struct("doc", "parent_id"))
    found = ordering.ranked_order(made, "parent", [F.col("ord")])
    return found.select("name", "doc", "value", F.col("place").cast("long").alias("place"))


@query(_DEBTS.format("SELECT * FROM customer"))
def rules_as_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules from data to a fixpoint; then lines are brought into the order of their balances."""
    base = region_forest(spark, sf_dir, "region", "nation", "customer")
    return _placed(blocks.run(base, DEBTS, unique=True))


@query(_DEBTS.format("SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 9 = 0 THEN c_name || '*' ELSE c_name END AS c_name, CASE WHEN c_custkey % 9 = 0 THEN -c_acctbal ELSE c_acctbal END AS c_acctbal FROM customer"))
def rules_as_data_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same after every ninth customer's balance has changed its sign: bindings of these customers are looked at, their
    lines come, go and move; the rest stays."""
    base = region_forest(spark, sf_dir, "region", "nation", "customer")
    state = blocks.run(base, DEBTS, unique=True)
    changed = base.where((F.col("name") == "customer") & (F.substring("id", 2, 20).cast("long") % 9 == 0))
    balance = F.element_at("attrs", "balance").cast("double")
    attrs = F.create_map(F.lit("name"), F.concat(F.element_at("attrs", "name"), F.lit("*")), F.lit("segment"), F.element_at("attrs", "segment"), F.lit("balance"), (-balance).cast("string"))
    return _placed(blocks.update(state, DEBTS, changed.select("id"), changed.withColumn("attrs", attrs)))


@query("SELECT o_custkey AS parent, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)::BIGINT AS place FROM orders")
def order_labels_by_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer stand by key; labels bring them into the order of their totals, moving those out of order."""
    o = table(spark, sf_dir, "orders")
    key = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long") * ordering.GAP
    rows = o.select(F.col("o_custkey").alias("parent"), F.col("o_orderkey").alias("id"), key.alias("ord"), F.lit(True).alias("fresh"), F.col("o_totalprice").alias("by"))
    found = ordering.order_labels(rows, "parent", [F.col("by")])
    return ordering.ranked_order(found, "parent", [F.col("label")]).select("parent", "id", F.col("place").cast("long").alias("place"))
