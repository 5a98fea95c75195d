"""Text nodes, constructed mixed content, interesting ranges, single items: cases that a join or a gathered text gets wrong."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from grovewise.operators import axes, bindings, construct, temporal
from grovewise.operators.axes import each, step
from grovewise.sources import documents

E, A, T = construct.Element, construct.Attribute, construct.Text
MIXED = '<a k="1&lt;">one <b/>t<b>in</b>u<c>  v w </c> <d>x<e/>&amp;y </d></a>'


def test_mixed_content_comes_back_in_its_order(spark):
    rows = spark.createDataFrame([("m", MIXED), ("p", "<a><b/> <b>x</b></a>"), ("h", "<p id='k'>one<br>two</p>")], "doc string, text string")
    again = documents.shredded(rows.where("doc <> 'h'"), "doc", "text").where("error is null").drop("error")
    assert {r["doc"]: r["xml"] for r in documents.serialised(again).collect()} == {"m": MIXED.replace("  v w ", "v w").replace("</c> <d>", "</c><d>"), "p": "<a><b/><b>x</b></a>"}
    kids = step(each(again, "a", "a"), again, "a", "child", None, "x").where("a.doc = 'm'").orderBy("x.ord").select("x.kind", "x.name", "x.value").collect()
    assert [tuple(k) for k in kids[:4]] == [("text", "#text", "one "), ("element", "b", None), ("text", "#text", "t"), ("element", "b", "in")]
    assert step(each(again, "a", "a"), again, "a", "child", "*", "x").where("a.doc = 'm'").count() == 4
    html = {m: documents.shred_html("h", "<p id='k'>one<br>two</p>", m) for m in (False, True)}
    assert [(r[7], r[8], r[9]) for r in html[False]] == [("p", {"id": "k"}, "one two"), ("br", {}, None)]
    assert [(r[1], r[7], r[9]) for r in html[True]] == [("h#0", "p", None), ("h#0.0", "#text", "one"), ("h#0.1", "br", None), ("h#0.2", "#text", "two")]


def test_constructed_text_nodes_stand_where_they_are_written(spark):
    tree = E("p", A("k", (F.lit(1),)), T((F.lit("a"), F.lit("b"))), T((F.lit("c"),)), E("i", T((F.col("s"),))), T((F.lit(None).cast("string"),)), E("j", E("k"), T((F.col("s"),))))
    made = construct.constructed(spark.createDataFrame([("x",), (None,)], "s string"), F.coalesce("s", F.lit("none")), F.coalesce("s", F.lit("none")), tree, mixed=True)
    xml = {r["doc"]: r["xml"] for r in documents.serialised(made).collect()}
    assert xml == {"x": '<p k="1">a bc<i>x</i><j><k/>x</j></p>', "none": '<p k="1">a bc<i/><j><k/></j></p>'}
    assert sorted(r["id"] for r in made.where("doc = 'x'").collect()) == ["x", "x.0", "x.1", "x.1.0", "x.1.t1", "x.t0"]  # an empty text is none


def test_every_variable_of_a_declaration_is_a_field(spark):
    code = "class A {\n  private int a, b = f(1, 2), c[] ;\n  java.util.Map<String, int[]> m, n;\n  int one(int x, int y);\n}\n"
    got = documents.code_members(spark.createDataFrame([("A.java", code)], "doc string, text string")).where("kind <> 'class'").collect()
    assert [(r["kind"], r["name"], r["returns"]) for r in got] == [("field", "a", "int"), ("field", "b", "int"), ("field", "c", "int[]"), ("field", "m", "java.util.Map"), ("field", "n", "java.util.Map"), ("method", "one", "int")]
    assert got[1]["modifiers"] == ["private"] and got[0]["line"] == 2


def test_one_item_is_asked_for_only_by_bindings(spark):
    bound = spark.createDataFrame([(1, "a"), (2, "b"), (4, "d")], "k int, b string")
    items = spark.createDataFrame([(1, "x", None), (2, None, 5), (3, "y", 1), (3, "z", 2), (None, "n", 1), (None, "n", 2)], "k int, v string, w int")
    assert sorted(map(tuple, bindings.for_one(bound, items, ["k"]).collect())) == [(1, "a", "x", None), (2, "b", None, 5)]
    with pytest.raises(Exception, match="more than one item"):
        bindings.for_one(bound.union(spark.createDataFrame([(3, "c")], bound.schema)), items, ["k"]).collect()


def test_interesting_ranges_equal_their_definition(spark):
    at = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    ranges = [("a", 0, 5), ("a", 5, 9), ("a", 20, 30), ("b", 1, 2), ("c", 3, 4), ("c", 6, 7)]
    points, changes = [("a", 5), ("a", 9), ("c", 3), ("d", 3), ("a", None)], [("a", 4), ("b", 3), ("c", 3)]
    r = spark.createDataFrame([(k, at(a), at(b)) for k, a, b in ranges], "k string, from_ts timestamp_ntz, to_ts timestamp_ntz")
    p, c = (spark.createDataFrame([(k, None if t is None else at(t)) for k, t in rows], "k string, ts timestamp_ntz") for rows in (points, changes))
    got = {(x["k"], x["from_ts"]): x["interesting"] for x in temporal.interesting(r, p, c, ["k"], "ts").collect()}
    assert got == {("a", at(0)): False, ("a", at(5)): True, ("a", at(20)): True, ("b", at(1)): False, ("c", at(3)): True, ("c", at(6)): True}


def test_documents_and_roots(spark):
    rows = spark.createDataFrame([("d", "<a id='x'><b id='y'/></a>"), ("e", "<a id='x'/>")], "doc string, text string")
    f = documents.shredded(rows, "doc", "text").where("error is null").drop("error")
    bound = spark.createDataFrame([(1, "d"), (2, "e"), (3, "gone"), (4, None)], "k int, n string")
    assert sorted(map(tuple, axes.doc_available(bound, f, F.col("n")).select("k", "available").collect())) == [(1, True), (2, True), (3, False), (4, False)]
    assert sorted((r["k"], r["doc"]) for r in axes.opened(bound, f, F.col("n"), "r", "a").select("k", "r.doc").collect()) == [(1, "d"), (2, "e")]
    assert axes.opened(bound, f, F.col("n"), "r", "b", outer=True).where("r is null").count() == 4
    assert sorted(map(tuple, axes.root(each(f, "s"), f, "s").select("s.doc", "s.id", "root.doc", "root.id").collect())) == [("d", "x", "d", "x"), ("d", "y", "d", "x"), ("e", "x", "e", "x")]
