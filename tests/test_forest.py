"""Hand-made forests with hand-computed results: axes, positions, bindings, sets."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from grovewise.operators import axes, bindings
from grovewise.operators.axes import attr, each, step
from grovewise.sources.documents import shredded

XML = '<a id="A"><b id="B1" k="x"><c id="C1"/><c id="C2"/></b><d id="D"><b id="B2" k="y"><c id="C3"/></b></d><b id="B3"/></a>'


@pytest.fixture(scope="module")
def forest(spark):
    rows = spark.createDataFrame([("one", XML), ("two", '<a id="Z"><b id="B9"/></a>'), ("bad", "<a><b></a>")], "doc string, text string")
    return shredded(rows, "doc", "text").cache()


def ids(df, var="x"):
    return [r[0] for r in axes.in_document_order(df, var).select(f"{var}.id").collect()]


AXIS = {
    "self": ("B1", None, ["B1"]), "child": ("B1", "c", ["C1", "C2"]), "parent": ("B2", None, ["D"]), "descendant": ("A", "c", ["C1", "C2", "C3"]),
    "descendant-or-self": ("B2", None, ["B2", "C3"]), "ancestor": ("C3", None, ["A", "D", "B2"]), "ancestor-or-self": ("C3", "b", ["B2"]),
    "following-sibling": ("B1", None, ["D", "B3"]), "preceding-sibling": ("B3", None, ["B1", "D"]), "following": ("C1", None, ["C2", "D", "B2", "C3", "B3"]),
    "preceding": ("B3", None, ["B1", "C1", "C2", "D", "B2", "C3"]),
}


@pytest.mark.parametrize("axis", AXIS)
def test_axes(forest, axis):
    start, name, want = AXIS[axis]
    nodes = forest.where("error is null").drop("error")
    got = step(each(nodes, "s").where(F.col("s.id") == start), nodes, "s", axis, name, "x")
    assert ids(got) == want


def test_attribute_axis_and_unknown_axis(forest):
    b = each(forest, "b", "b")
    assert sorted(r[0] for r in step(b, forest, "b", "attribute", "k", "k").select("k").collect()) == ["x", "y"]
    assert step(b, forest, "b", "attribute", "k", "k", outer=True).count() == 4
    with pytest.raises(ValueError, match="unknown axis"):
        step(b, forest, "b", "sideways")


def test_a_bad_document_is_recorded_and_stops_nothing(forest):
    bad = forest.where("error is not null").collect()
    assert [r["doc"] for r in bad] == ["bad"] and forest.where("error is null").select("doc").distinct().count() == 2


def test_paths_have_no_duplicates_and_positions_count_per_context(forest):
    nodes = forest.where("error is null").drop("error")
    up = step(each(nodes, "c", "c"), nodes, "c", "ancestor", "a", "x")
    assert up.count() == 3 and ids(axes.distinct_nodes(up, "x")) == ["A"]
    inner = step(each(nodes, "a", "a").where("a.id = 'A'"), nodes, "a", "descendant", "c", "x").select(F.col("x.parent_id").alias("p"), "x")
    n = axes.numbered(inner, "x", ["p"], last="n")
    assert sorted((r["x"]["id"], r["position"], r["n"]) for r in n.collect()) == [("C1", 1, 2), ("C2", 2, 2), ("C3", 1, 1)]
    assert ids(axes.numbered(inner, "x", ["p"], reverse=True).where("position = 1")) == ["C2", "C3"]


def test_nearest_and_topmost(forest):
    nodes = forest.where("error is null").drop("error")
    got = axes.nearest(each(nodes, "c", "c"), nodes, "c", "k")
    assert sorted((r["c"]["id"], r["found"]["id"]) for r in got.collect()) == [("C1", "B1"), ("C2", "B1"), ("C3", "B2")]
    assert sorted(r["id"] for r in bindings.topmost(nodes.where("id in ('D', 'B2', 'C3', 'C1', 'B9')")).collect()) == ["B9", "C1", "D"]
    rank = axes.document_rank(nodes).where("doc = 'one'")
    assert [r["id"] for r in rank.orderBy("rank").collect()] == ["A", "B1", "C1", "C2", "D", "B2", "C3", "B3"]


def test_bindings(spark):
    items = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c"), (2, "c")], "k int, v string")
    keys = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    some = {r["k"]: r["all"] for r in bindings.with_some(keys, items, ["k"], "v", "all").collect()}
    every = {r["k"]: r["all"] for r in bindings.with_any(keys, items, ["k"], "v", "all").collect()}
    assert some == {1: ["a", "b"], 2: ["c", "c"]} and every == {**some, 3: []}
    assert bindings.with_distinct(keys, items, ["k"], "v").count() == 3
    one = items.where("v <> 'a'").dropDuplicates()
    assert bindings.for_one(keys, one, ["k"]).count() == 2
    with pytest.raises(Exception, match="more than one item"):
        bindings.for_one(keys, items, ["k"]).collect()
    assert bindings.for_all(items.limit(0), ["k"], "v", "all").count() == 0
    assert bindings.exactly_one(items, ["k"], "v").where("conflict").count() == 1


def test_winners_keep_ties(spark):
    rows = spark.createDataFrame([("k", 1, False, 5), ("k", 2, True, 1), ("k", 3, False, 2), ("k", 3, False, 2), ("k", 4, False, 1)], "key string, serial int, over boolean, spec int")
    got = bindings.winners(rows, "key", F.col("over"), "spec", "serial").collect()
    assert [(r["serial"], r["spec"]) for r in got] == [(3, 2), (3, 2)]


def test_every_of_nothing_holds_and_null_fails(spark):
    a = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    b = spark.createDataFrame([(1, 5), (2, None)], "p int, v int")
    got = axes.every(a, b, F.col("id") == F.col("p"), F.col("v") > 3)
    assert sorted(r["id"] for r in got.collect()) == [1, 3]


def test_attr_of_missing_is_null(forest):
    assert each(forest, "b", "b").where(attr("b", "nothing").isNull()).count() == 4
