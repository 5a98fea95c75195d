"""Registered queries on values, constructed trees, functions by name, decisions of a run, and types of code."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovewise.functions import registry, values
from grovewise.operators import axes, bindings, construct, ordering, rules, similarity, snapshots, temporal
from grovewise.operators.axes import attr, each
from grovewise.plans.changes import QUIET, _at
from grovewise.registry import query
from grovewise.session import table
from grovewise.sources import documents
from grovewise.sources.forest import conversation_forest, region_forest
from grovewise.sources.store import shared_folder

_ITEMS = "SELECT p_partkey, string_split(p_type, ' ') AS a, string_split(p_name, ' ') AS b, [p_size::DOUBLE, p_size * 2.0] AS n, [p_size::VARCHAR, p_brand] AS t FROM part"


@query(f"""
    SELECT p_partkey, len(list_intersect(a, b)) > 0 AS eq, len(list_distinct(a || b)) > 1 AS ne, list_min(a) < list_max(b) AS lt, list_min(a) <= list_max(b) AS le, list_max(a) > list_min(b) AS gt, list_max(a) >= list_min(b) AS ge,
        true AS num_eq, true AS num_ne, n[1] > 10 AS num_gt, false AS none_eq, false AS none_ne FROM ({_ITEMS})
""")
def cmp_general(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of texts with each other, and of numbers with texts, of which one isn't a number; empty sides never hold."""
    a, b, n = F.split("p_type", " "), F.split("p_name", " "), F.array(F.col("p_size").cast("double"), F.col("p_size") * 2.0)
    t, none = F.array(F.col("p_size").cast("string"), "p_brand"), F.array().cast("array<string>")
    names = dict(zip(("eq", "ne", "lt", "le", "gt", "ge"), ("=", "!=", "<", "<=", ">", ">="), strict=True))
    return table(spark, sf_dir, "part").select(
        "p_partkey", *[values.general_comparison(a, op, b).alias(k) for k, op in names.items()],
        *[values.general_comparison(n, names[k], t, numeric=True).alias(f"num_{k}") for k in ("eq", "ne")], values.general_comparison(F.slice(n, 1, 1), ">", F.array(F.lit("10"), F.lit("x")), numeric=True).alias("num_gt"),
        *[values.general_comparison(a, names[k], none).alias(f"none_{k}") for k in ("eq", "ne")],
    )


_SPENT = "SELECT op, c_custkey AS customer FROM customer, (VALUES ('='), ('!='), ('<'), ('<='), ('>'), ('>=')) v(op) WHERE EXISTS (SELECT 1 FROM orders x, orders y WHERE x.o_custkey = c_custkey AND y.o_custkey = c_custkey AND x.o_orderstatus = 'F' AND y.o_orderstatus = 'O' AND {})"


@query(_SPENT.format("CASE op WHEN '=' THEN x.o_orderpriority = y.o_orderpriority WHEN '!=' THEN x.o_orderpriority <> y.o_orderpriority WHEN '<' THEN x.o_orderpriority < y.o_orderpriority WHEN '<=' THEN x.o_orderpriority <= y.o_orderpriority WHEN '>' THEN x.o_orderpriority > y.o_orderpriority ELSE x.o_orderpriority >= y.o_orderpriority END"))
def pred_general_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer[order[@status = 'F']/@priority op order[@status = 'O']/@priority] for all six comparisons."""
    f = region_forest(spark, sf_dir, "customer", "order")
    o = each(f, "o", "order").select(F.col("o.parent_id").alias("id"), attr("o", "status").alias("status"), attr("o", "priority").alias("value"))
    c = each(f, "c", "customer").select(F.col("c.id").alias("id"))
    left, right = o.where("status = 'F'"), o.where("status = 'O'")
    found = [axes.general(c, left, right, "id", "value", op).select(F.lit(op).alias("op"), F.substring("id", 2, 20).cast("long").alias("customer")) for op in values.OPERATORS]
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


@query("SELECT c_custkey, c_nationkey % 3 <> 0 AS node_first, c_mktsegment <> 'BUILDING' AS text, c_acctbal <> 0 AS num, c_acctbal > 0 AS truth, count(o_orderkey) > 0 AS items FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL")
def fn_boolean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth of sequences: of nodes, of one text, number or boolean, and of none."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    n = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    one, lit = F.lit(1), F.lit
    truth = values.effective_boolean
    return c.join(n, "c_custkey", "left").select(
        "c_custkey", truth(lit("node"), lit(None).cast("string"), F.col("c_nationkey") % 3).alias("node_first"), truth(lit("string"), F.when(F.col("c_mktsegment") == "BUILDING", "").otherwise(F.col("c_mktsegment")), one).alias("text"),
        truth(lit("number"), F.col("c_acctbal").cast("string"), one).alias("num"), truth(lit("boolean"), (F.col("c_acctbal") > 0).cast("string"), one).alias("truth"), truth(lit("node"), lit(None).cast("string"), F.col("n")).alias("items"),
    )


@query("SELECT o_orderkey, o_orderkey::BIGINT AS whole, o_totalprice > 100000 AS large, strftime(o_orderdate, '%Y-%m-%d')::DATE AS day, false AS castable FROM orders")
def fn_cast_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types named at run time: texts of each become values, and others aren't castable."""
    make = {t: values.constructor(t) for t in ("xs:integer", "xs:double", "xs:date")}
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(spark, sf_dir, "orders").select("o_orderkey", make["xs:integer"](F.concat(F.lit(" "), F.col("o_orderkey").cast("string"))).alias("whole"), (make["xs:double"](F.col("o_totalprice").cast("string")) > 100000).alias("large"), make["xs:date"](day).alias("day"), values.castable(F.col("o_orderpriority"), "xs:integer").alias("castable"))


_ACRONYM = "CASE WHEN len(p) >= 2 THEN array_to_string(list_filter(list_transform(p, lambda x: lower(x[1])), lambda c: regexp_matches(c, '^[a-z]$')), '') WHEN len(caps) > 0 THEN lower(f || array_to_string(caps[:3], '')) ELSE lower(f || rest[:2]) END"


@query(f"""
    WITH n AS (SELECT 1 AS k, p_name AS name, p_partkey AS id FROM part UNION ALL SELECT 2, p_brand, p_partkey FROM part UNION ALL SELECT 3, upper(p_name[1]) || replace(p_name, ' ', '')[2:], p_partkey FROM part UNION ALL SELECT 4, replace(initcap_, ' ', ''), p_partkey FROM (SELECT *, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS initcap_ FROM part)),
    t AS (SELECT *, list_filter(regexp_split_to_array(name, '[-_ .]+'), lambda x: x <> '') AS p, regexp_extract(name, '[A-Za-z]') AS f, regexp_extract_all(regexp_extract(name, '(?s)^[^A-Za-z]*[A-Za-z](.*)$', 1), '[A-Z]') AS caps, regexp_replace(regexp_extract(name, '(?s)^[^A-Za-z]*[A-Za-z](.*)$', 1), '[^A-Za-z]', '', 'g') AS rest FROM n)
    SELECT k, id, {_ACRONYM} AS short FROM t
""")
def fn_acronym(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of names in several words, of brands, and of names in one word with and without capitals."""
    p = table(spark, sf_dir, "part")
    forms = (F.col("p_name"), F.col("p_brand"), F.concat(F.upper(F.left("p_name", F.lit(1))), F.expr("substring(replace(p_name, ' ', ''), 2)")), F.array_join(F.transform(F.split("p_name", " "), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substr(w, F.lit(2)))), ""))
    one = p.select(F.col("p_partkey").alias("id"), F.explode(F.array(*[F.struct(F.lit(k).alias("k"), x.alias("name")) for k, x in enumerate(forms, 1)])).alias("f"))
    return one.select("f.k", "id", values.acronym(F.col("f.name")).alias("short"))


@query("SELECT 'c' || c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'urn:r' || n_regionkey ELSE 'urn:n' || n_nationkey END AS ns, 'name' AS local FROM customer JOIN nation ON n_nationkey = c_nationkey")
def namespaces_in_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions declare prefixes a and b, nations b anew: names of customers resolve to the nearest."""
    f = region_forest(spark, sf_dir, "region", "nation", "customer")
    uri = F.concat(F.lit("urn:"), F.col("id"))
    declared = F.when(F.col("name") == "region", F.create_map(F.lit("xmlns:a"), uri, F.lit("xmlns:b"), F.lit("urn:none"))).when(F.col("name") == "nation", F.create_map(F.lit("xmlns:b"), uri)).otherwise(F.create_map().cast("map<string,string>"))
    c = construct.prefixes_in_scope(f.withColumn("attrs", declared)).where("id like 'c%'")
    name = F.when(F.substring("id", 2, 20).cast("long") % 2 == 0, "a:name").otherwise("b:name")
    found = c.select("id", values.expanded_name(name, F.col("prefixes")).alias("x"))
    return found.select("id", "x.ns", "x.local")


@query("SELECT doc, id, parent_id, name, of, value FROM (SELECT 'made' AS doc, 'x' || n_nationkey AS id, NULL AS parent_id, 'page' AS name, 'n' || n_nationkey AS of, NULL AS value, n_nationkey FROM nation UNION ALL SELECT 'made', 'x' || n_nationkey || '.0', 'x' || n_nationkey, 'title', NULL, 'On ' || n_name || '!', n_nationkey FROM nation UNION ALL SELECT 'made', 'x' || n_nationkey || '.1', 'x' || n_nationkey, 'list', NULL, NULL, n_nationkey FROM nation UNION ALL SELECT 'made', 'x' || n_nationkey || '.1.0.n' || n_nationkey, 'x' || n_nationkey || '.1', 'nation', NULL, NULL, n_nationkey FROM nation UNION ALL SELECT 'made', 'x' || c_nationkey || '.1.0.c' || c_custkey, 'x' || c_nationkey || '.1.0.n' || c_nationkey, 'customer', NULL, NULL, c_nationkey FROM customer)")
def construct_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each nation from markup: a title with its name, and a list with a copy of its subtree."""
    f = region_forest(spark, sf_dir, "nation", "customer")
    b = each(f, "n", "nation")
    page = construct.direct("<page of='{id}' none='{none}'><title>On {name}!</title></page>", {"id": F.col("n.id"), "name": attr("n", "name"), "none": F.lit(None).cast("string")})
    page.content.append(construct.Element("list", construct.Copy("n")))
    key = F.concat(F.lit("x"), F.substring("n.id", 2, 20))
    made = construct.constructed(b, key, F.lit("made"), page, f)
    return made.select("doc", "id", "parent_id", "name", F.when(F.col("name") == "page", F.element_at("attrs", "of")).alias("of"), "value")


@query("SELECT 'v' || conv_id AS id, '' AS atom FROM conversations GROUP BY conv_id UNION ALL SELECT 'v' || conv_id || '.' || turn, text FROM conversations")
def atomised_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return construct.atomised(conversation_forest(spark, sf_dir))


@query("SELECT p_partkey, len(a) AS n, list_reverse(a)[1] AS last, array_to_string(a, '+') AS joined, a = b AS same, upper(p_brand) AS up, contains(p_brand, '#1') AS has FROM (SELECT *, string_split(p_type, ' ') AS a, string_split(p_name, ' ') AS b FROM part)")
def functions_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Built-in functions and one that is defined with their help."""
    fn = registry.builtin()
    fn.define("last-of", [registry.Param("item", "sequence")], lambda s: F.try_element_at(fn.call("reverse", s), F.lit(1)))
    a, b, brand = F.split("p_type", " "), F.split("p_name", " "), F.col("p_brand")
    return table(spark, sf_dir, "part").select(
        "p_partkey", fn.call("count", a).alias("n"), fn.call("last-of", a).alias("last"), fn.call("string-join", a, F.lit("+")).alias("joined"), fn.call("deep-equal", a, b).alias("same"), fn.call("upper-case", context=brand).alias("up"), fn.call("contains", brand, F.lit("#1")).alias("has"),
    )


@query("SELECT a, b, round(-2.0 * p - n, 6) AS cost FROM (SELECT p_partkey AS a, p_partkey + 1 AS b, CASE WHEN string_split(p_type, ' ')[1] <> string_split(t, ' ')[1] THEN 0 WHEN string_split(p_type, ' ')[2] <> string_split(t, ' ')[2] THEN 1 WHEN string_split(p_type, ' ')[3] <> string_split(t, ' ')[3] THEN 2 ELSE 3 END / 3 AS p, 1 - levenshtein(p_name, m) / greatest(length(p_name), length(m)) AS n FROM (SELECT *, lead(p_type) OVER (ORDER BY p_partkey) AS t, lead(p_name) OVER (ORDER BY p_partkey) AS m, lead(p_partkey) OVER (ORDER BY p_partkey) AS k FROM part) WHERE k = p_partkey + 1)")
def calculators_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part against the one after it, by costs that are chosen and weighed by name."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("a"), F.col("p_name").alias("an"), F.replace("p_type", F.lit(" "), F.lit(".")).alias("ap"))
    n = p.select((F.col("a") - 1).alias("a"), F.col("a").alias("b"), F.col("an").alias("bn"), F.col("ap").alias("bp"))
    cost = similarity.weighed([("prefix", 2.0), ("names", 1.0)], *map(F.col, ("an", "bn", "ap", "bp")))
    return p.join(n, "a").select("a", "b", F.round(cost, 6).alias("cost"))


_BOTH = "SELECT coalesce(a.p_partkey, b.p_partkey) AS k, a.p_size AS old, b.p_size AS new FROM (SELECT * FROM part WHERE p_partkey % 7 <> 0) a FULL JOIN (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN p_size + 1 ELSE p_size END AS p_size FROM part WHERE p_partkey % 11 <> 0) b USING (p_partkey)"


@query(f"SELECT k, new AS stamp, CASE WHEN old IS NULL OR old <> new THEN 'copied' WHEN k % 13 = 0 OR k % 17 = 0 THEN 'copied again' ELSE 'kept' END AS done FROM ({_BOTH}) WHERE new IS NOT NULL")
def apply_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A working copy in which some files are missing and others were touched follows a snapshot's actions."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("stamp"))
    before = p.where("k % 7 <> 0")
    now = p.where("k % 11 <> 0").withColumn("stamp", F.when(F.col("k") % 5 == 0, F.col("stamp") + 1).otherwise(F.col("stamp")))
    diff = snapshots.snapshot_diff(before, now, "k", "stamp")
    copy = before.where("k % 13 <> 0").withColumn("recorded", F.col("stamp")).withColumn("stamp", F.when(F.col("k") % 17 == 0, -1).otherwise(F.col("stamp")))
    return snapshots.apply_snapshot(diff, now, copy, "k", "stamp").select("k", "stamp", "done")


@query("SELECT 'u' || user_id AS file, 'a' || (event_id % 7) AS author, count(*) AS n, max(date_trunc('second', ts)) AS latest, count(DISTINCT event_type) AS n_messages FROM events GROUP BY ALL")
def revision_log_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as a log of revisions, an entry for each user's file, and parsed again."""
    e = table(spark, sf_dir, "events")
    rule, end = "-" * 28 + "\n", "=" * 77 + "\n"
    head = F.concat(F.lit("revision 1."), F.col("event_id").cast("string"), F.lit("\ndate: "), F.date_format("ts", "yyyy/MM/dd HH:mm:ss"), F.lit(";  author: a"), (F.col("event_id") % 7).cast("string"), F.lit(";  state: Exp;\n"), "event_type", F.lit("\r\n"))
    text = e.groupBy("user_id").agg(F.array_join(F.collect_list(F.concat(F.lit(rule), head)), "").alias("r"))
    path = f"{shared_folder(spark)}/log-{uuid.uuid4().hex}"
    text.select(F.concat(F.lit("RCS file: u"), F.col("user_id").cast("string"), F.lit(",v\n"), "r").alias("value")).write.option("lineSep", end).text(path)
    found = documents.revision_log(spark.read.option("lineSep", end).text(path))
    return found.groupBy("file", "author").agg(F.count(F.lit(1)).alias("n"), F.max("date").alias("latest"), F.countDistinct("message").alias("n_messages"))


@query("SELECT p_partkey, p_name AS name, p_size AS size, 2 AS n_tags, p_brand || ',' || p_type AS tags FROM part")
def xml_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of parts as structs, and a path of names into them."""
    from grovewise.functions.scalars import escape_html as q

    xml = F.concat(F.lit('<part size="'), F.col("p_size").cast("string"), F.lit('"><name>'), q(F.col("p_name")), F.lit("</name><tags><tag>"), q(F.col("p_brand")), F.lit("</tag><tag>"), q(F.col("p_type")), F.lit("</tag></tags></part>"))
    rows = documents.objects_from_xml(table(spark, sf_dir, "part").select("p_partkey", xml.alias("xml")), "xml", "name string, _size int, tags struct<tag: array<string>>")
    tags = documents.simple_path(F.col("xml"), "tags tag")
    return rows.select("p_partkey", F.col("object.name").alias("name"), F.col("object._size").alias("size"), F.size("object.tags.tag").alias("n_tags"), F.array_join(tags, ",").alias("tags"))


@query("""
    WITH s AS (SELECT user_id % 50 AS scope, max(ts) AS last, count(*) AS n FROM events GROUP BY 1)
    SELECT scope, CASE WHEN n % 3 = 0 THEN 'checkpoint' WHEN last + INTERVAL 12 HOUR > TIMESTAMP '2024-01-30 12:00:00' THEN 'postpone' ELSE 'abandon' END AS decision,
        CASE WHEN n % 3 = 0 THEN TIMESTAMP '2024-01-15 00:00:00' WHEN last + INTERVAL 12 HOUR > TIMESTAMP '2024-01-30 12:00:00' THEN last + INTERVAL 12 HOUR END AS until FROM s
""")
def no_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scopes without a checkpoint wait for their latest proposal, or are given up."""
    e = table(spark, sf_dir, "events").withColumn("scope", F.col("user_id") % 50)
    agreed = e.groupBy("scope").agg(F.count(F.lit(1)).alias("n")).where("n % 3 = 0").select("scope", _at("'2024-01-15 00:00:00'").alias("checkpoint"))
    postponed = temporal.postpone_until(e, ["scope", "user_id"], "ts", QUIET, _at("'2024-01-30 12:00:00'"))
    return temporal.without_agreement(e, agreed, postponed, ["scope"])


@query("SELECT user_id, CASE WHEN TIMESTAMP '2024-01-31 00:00:00' - t < INTERVAL 36 HOUR THEN t + INTERVAL 36 HOUR END AS wait_until FROM (SELECT user_id, coalesce(max(ts) FILTER (event_type = 'error'), max(ts) FILTER (event_type <> 'error')) AS t FROM events GROUP BY user_id)")
def run_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "events").withColumn("aborted", F.col("event_type") == "error")
    return temporal.run_gate(runs, ["user_id"], "ts", "aborted", _at("'2024-01-31 00:00:00'"), timedelta(hours=36))


@query("""
    WITH p AS (SELECT DISTINCT user_id, ts AS to_ts FROM events), g AS (SELECT user_id, lag(to_ts) OVER (PARTITION BY user_id ORDER BY to_ts) + INTERVAL 8 HOUR AS from_ts, to_ts FROM p)
    SELECT user_id, count(*) AS n FROM g WHERE to_ts - from_ts >= INTERVAL 16 HOUR GROUP BY user_id
""")
def quiet_by_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quiet period of an hour can't be told where times are known to eight hours: it becomes sixteen."""
    e, precision = table(spark, sf_dir, "events"), timedelta(hours=8)
    found = temporal.quiet_ranges(e, ["user_id"], "ts", _at("'1990-01-01 00:00:00'"), _at("'2090-01-01 00:00:00'"), temporal.quiet_for(timedelta(hours=1), precision), precision)
    inner = found.where(F.col("from_ts") > _at("'1990-01-01 00:00:00'")).where(F.col("to_ts") < _at("'2090-01-01 00:00:00'"))
    return inner.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


_TYPES = "SELECT DISTINCT 'p' || (p_size % 9) || '.T' || (p_partkey % 40) AS impl FROM part UNION ALL SELECT DISTINCT 'p' || (p_size % 9) || '.T' || (p_partkey % 40) || '$N' FROM part WHERE p_partkey % 3 = 0"
_REFS = "SELECT c_custkey AS ref_id, c_nationkey AS d, 'p' || (c_nationkey % 12) AS package, 'T' || (c_custkey % 50) AS f, CASE WHEN c_custkey % 4 = 0 THEN '$N' ELSE '' END AS rest FROM customer"


@query(f"""
    WITH t AS ({_TYPES}), k AS (SELECT impl, count(*) AS n FROM t GROUP BY impl), r AS ({_REFS}),
    f AS (SELECT r.*, CASE WHEN f = 'T' || d THEN 'p1.T' || d WHEN a.impl IS NOT NULL THEN a.impl WHEN b.impl IS NOT NULL THEN b.impl WHEN c.impl IS NOT NULL THEN c.impl END AS first,
            CASE WHEN f = 'T' || d THEN 'import' WHEN a.impl IS NOT NULL THEN 'package' WHEN b.impl IS NOT NULL OR c.impl IS NOT NULL THEN 'packages' END AS scope,
            f <> 'T' || d AND a.impl IS NULL AND b.impl IS NOT NULL AND c.impl IS NOT NULL AND b.impl <> c.impl AS many
        FROM r LEFT JOIN k a ON a.impl = package || '.' || f LEFT JOIN k b ON b.impl = 'p2.' || f LEFT JOIN k c ON c.impl = 'p' || (d % 9) || '.' || f)
    SELECT ref_id, CASE WHEN many THEN NULL ELSE replace(z.impl, '$', '.') END AS target, scope, CASE WHEN many THEN 'ambiguous' WHEN z.impl IS NULL THEN 'unresolved' ELSE 'resolved' END AS status
    FROM f LEFT JOIN k z ON z.impl = first || rest
""")
def resolve_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References from each customer's document: one named import, two packages imported whole, the own package."""
    p, c = table(spark, sf_dir, "part"), table(spark, sf_dir, "customer")
    impl = F.concat(F.lit("p"), (F.col("p_size") % 9).cast("string"), F.lit(".T"), (F.col("p_partkey") % 40).cast("string"))
    types = p.select(impl.alias("impl")).distinct().union(p.where("p_partkey % 3 = 0").select(F.concat(impl, F.lit("$N"))).distinct())
    types = types.withColumn("full", F.replace("impl", F.lit("$"), F.lit(".")))
    d = F.col("c_nationkey").cast("string")
    name = F.concat(F.lit("T"), (F.col("c_custkey") % 50).cast("string"), F.when(F.col("c_custkey") % 4 == 0, ".N").otherwise(""))
    refs = c.select(F.col("c_custkey").alias("ref_id"), d.alias("doc"), name.alias("name"), F.concat(F.lit("p"), (F.col("c_nationkey") % 12).cast("string")).alias("package"), F.array().cast("array<string>").alias("enclosing"))
    names = F.array(F.concat(F.lit("p1.T"), d), F.lit("p2.*"), F.concat(F.lit("p"), (F.col("c_nationkey") % 9).cast("string"), F.lit(".*")))
    imports = c.select(d.alias("doc"), F.explode(names).alias("name")).distinct()
    return snapshots.resolve_types(refs, types, imports)


@query("SELECT key, CASE WHEN w IS NULL THEN 'delete' WHEN h IS NULL THEN 'add' ELSE 'keep' END AS action FROM (SELECT DISTINCT 'k' || o_custkey AS key, 1 AS h FROM orders WHERE o_orderstatus = 'F') FULL JOIN (SELECT DISTINCT 'k' || o_custkey AS key, 1 AS w FROM orders WHERE o_orderstatus = 'O') USING (key)")
def keyed_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("k"), F.col("o_custkey").cast("string")).alias("key"), "o_orderstatus")
    return rules.keyed_changes(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"))


@query("SELECT 'c' || o_custkey || CASE WHEN count(*) OVER (PARTITION BY o_custkey) > 1 THEN '-' || row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) ELSE '' END || '.' AS key, o_orderkey FROM orders")
def insert_serials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several nodes inserted by one binding are numbered, a single one isn't."""
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("parent"), "o_orderkey")
    return rules.serial_ids(o, "parent", "o_orderkey").select("key", "o_orderkey")


@query("SELECT o_custkey AS parent, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)::INT AS place FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0)")
def due_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At the end of a cycle the orders of documents at rest are sorted; nations with suppliers in debt have just changed."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    rows = o.select(F.col("o_custkey").alias("parent"), F.col("c_nationkey").alias("doc"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("value"))
    changed = table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_nationkey").alias("doc"))
    return ordering.sort_by_value(rules.due_orders(rows, changed), "parent", F.col("value"), "id").select("parent", "id", "place")


@query("SELECT 'n' || n_nationkey || '.' AS key, unnest(['n' || n_nationkey, 'r' || n_regionkey]) AS doc FROM nation")
def binding_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bindings of nations, each a document of its own, with their regions rest on two documents."""
    f = region_forest(spark, sf_dir, "region", "nation")
    f = f.withColumn("doc", F.when(F.col("name") == "nation", F.col("id")).otherwise(F.col("doc")))
    # A reference by id across documents: the parent axis stays within one.
    bound = each(f, "n", "nation").join(each(f, "r", "region"), F.col("n.parent_id") == F.col("r.id"))
    return rules.dependencies(bound, F.concat(F.col("n.id"), F.lit(".")), ["n", "r"])


_SEQUENCES = "SELECT o_custkey AS k, string_agg(o_orderpriority, '/' ORDER BY o_orderkey) AS s FROM orders WHERE o_orderstatus = '{}' GROUP BY o_custkey"


@query(f"SELECT a.k AS a, b.k AS b FROM ({_SEQUENCES.format('F')}) a JOIN ({_SEQUENCES.format('P')}) b ON a.s = b.s")
def join_sequence_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers one of whom has, in finished orders, the sequence of priorities that the other has in pending ones; orders
    without a priority are passed over."""
    o = table(spark, sf_dir, "orders").where("o_orderpriority is not null")
    found = (bindings.sequences(o.where(F.col("o_orderstatus") == s), "o_custkey", "o_orderpriority", "o_orderkey").withColumnRenamed("o_custkey", k) for s, k in (("F", "a"), ("P", "b")))
    left, right = (f.withColumn("sequence", F.array_join("sequence", "/")) for f in found)
    return similarity.pairs_of_equals(left, right, "sequence", "a", "b")


_SIDES = ("SELECT c_custkey AS id, c_nationkey AS parent, c_mktsegment AS segment, c_acctbal AS balance FROM customer WHERE c_custkey % 5 <> 0", "SELECT c_custkey + 1000000 AS id, c_nationkey + 100 AS parent, c_mktsegment AS segment, c_acctbal AS balance FROM customer WHERE c_custkey % 7 <> 0")


@query(f"""
    WITH m AS (SELECT n_nationkey + 100 AS new_id, n_nationkey AS old_id FROM nation WHERE n_nationkey % 6 <> 0), b AS ({_SIDES[0]}), n AS (SELECT n.id, m.old_id AS parent, segment, balance FROM ({_SIDES[1]}) n JOIN m ON m.new_id = n.parent),
    b1 AS (SELECT *, count(*) OVER (PARTITION BY parent, segment, balance) AS c FROM b), n1 AS (SELECT *, count(*) OVER (PARTITION BY parent, segment, balance) AS c FROM n)
    SELECT n1.id AS new_id, b1.id AS old_id FROM n1 JOIN b1 USING (parent, segment, balance) WHERE n1.c = 1 AND b1.c = 1
""")
def identity_in_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations are matched by name, every sixth having got another; customers only below nations that are."""
    n, c = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    none = F.lit(None).cast("int")
    old = n.select(F.col("n_nationkey").alias("id"), none.alias("parent"), F.col("n_name").alias("name"))
    new = n.select((F.col("n_nationkey") + 100).alias("id"), none.alias("parent"), F.when(F.col("n_nationkey") % 6 == 0, F.concat("n_name", F.lit("!"))).otherwise(F.col("n_name")).alias("name"))
    c.createOrReplaceTempView("_customer")
    before, now = (spark.sql(s.replace("FROM customer", "FROM _customer")) for s in _SIDES)
    return snapshots.hierarchical_match([(old, new, [["name"]]), (before, now, [["segment", "balance"]])], "id", "parent")[1]


@query("SELECT 'k' || c_custkey AS key, CASE WHEN p = 0 THEN d ELSE d || '-' || p END AS doc FROM (SELECT c_custkey, 'doc-' || c_mktsegment || '.xml' AS d, row_number() OVER (PARTITION BY c_mktsegment ORDER BY 'k' || c_custkey) - CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE 1 END AS p FROM customer)")
def fresh_document_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' documents are named by segment; one such name is in use before."""
    rows = table(spark, sf_dir, "customer").select(F.concat(F.lit("k"), F.col("c_custkey").cast("string")).alias("key"), F.concat(F.lit("doc-"), "c_mktsegment", F.lit(".xml")).alias("doc"))
    taken = spark.range(1).select(F.lit("doc-BUILDING.xml").alias("doc"))
    return rules.fresh_documents(rows, "doc", "key", taken)
