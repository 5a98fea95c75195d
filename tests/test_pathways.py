"""Paths as values: what they yield and read, static errors, positions, filters, duplicates."""

from __future__ import annotations

import pytest

from grovewise.operators.axes import each, in_document_order
from grovewise.operators.pathways import path, union
from grovewise.sources.documents import shredded

XML = "<a id='a'><b id='b1' k='1'><c id='c1'/><c id='c2' k='x'><c id='c3'/></c></b><b id='b2'><d id='d1'><c id='c4' k='y'/></d></b><e id='e1'><b id='b3'><c id='c5'/><c id='c6'/></b></e></a>"


@pytest.fixture(scope="module")
def forest(spark):
    rows = spark.createDataFrame([("one", XML)], "doc string, text string")
    return shredded(rows, "doc", "text").where("error is null").drop("error").cache()


def found(forest, p, start="a"):
    return [r[0] for r in in_document_order(p.bind(each(forest, "s", start).where("s.doc = 'one'"), forest, "s", "x"), "x").select("x.id").collect()]


@pytest.mark.parametrize(("p", "want"), [
    (path().child("b").child("c"), ["c1", "c2"]),
    (path().descendant("c").ancestor("b"), ["b1", "b2", "b3"]),  # each once
    (path().descendant("c").descendant("c"), ["c3"]),
    (path().anywhere("c").at(2), ["c2", "c6"]),  # within each parent
    (path().descendant("c").at(2), ["c2"]),
    (path().descendant("c").at(-1), ["c6"]),
    (path().child("b").child("*").at(-1), ["c2", "d1"]),
    (path().descendant("c").where(path().attribute("k")), ["c2", "c4"]),
    (path().descendant("c").where(path().attribute("k")).at(2), ["c4"]),  # numbers what is left
    (path().descendant("c").ancestor("*").at(1), ["b1", "c2", "d1", "b3"]),  # the nearest is the first
    (path().child("b").where(path().descendant("c").where(lambda c: attr_of(c, "k") == "y")), ["b2"]),
    (path().descendant("*").where(lambda n: n["name"].isin("d", "e"), "name"), ["d1", "e1"]),
    (path(), ["a"]),
])
def test_paths(forest, p, want):
    assert found(forest, p) == want


def attr_of(node, name):
    return node["attrs"][name]


def test_attribute_values_and_unions(forest):
    one = each(forest, "s", "a").where("s.doc = 'one'")
    assert sorted(r[0] for r in path().descendant("c").attribute("k").bind(one, forest, "s", "x").select("x").collect()) == ["x", "y"]
    both = union(one, forest, "s", "x", path().child("b"), path().descendant("b"))
    assert sorted(r[0] for r in both.select("x.id").collect()) == ["b1", "b2", "b3"]
    with pytest.raises(TypeError, match="XPTY0018"):
        union(one, forest, "s", "x", path().child("b"), path().attribute("k"))


def test_what_a_path_yields_and_reads_is_known_beforehand():
    with pytest.raises(TypeError, match="XPTY0019"):
        path().attribute("k").child("b")
    with pytest.raises(ValueError, match="unknown axis"):
        path().step("sideways")
    with pytest.raises(ValueError, match="positions"):
        path().child("b").at(0)
    with pytest.raises(ValueError, match="follows a step"):
        path().where(lambda n: n["id"] == "x")
    p = path().child("b").where(path().child("d").where(lambda d: attr_of(d, "z") == "1", "z")).attribute("k")
    assert p.reads == (frozenset({"b", "d"}), frozenset({"k", "z"})) and path().child("*").reads[0] is None
    assert path().parent("b").single and path().child("b").at(1).single and not path().child("b").single and not path().anywhere("b").at(1).single
    assert path().child("b").descendant("c").distinct and path().descendant("b").child("c").distinct and path().parent().parent().distinct
    assert not path().descendant("b").descendant("c").distinct and not path().child("b").parent("a").distinct
