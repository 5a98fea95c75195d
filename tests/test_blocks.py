"""Rules as data: checked when compiled, run, maintained and sorted."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from grovewise.operators import blocks, rules
from grovewise.sources.documents import serialised, shredded

SHEETS = [
    {"id": "r1", "blocks": [{"for each": "plan", "name": "plan"}, {"create-doc": "concat('sheet-', plan.id, '.xml')", "root": "sheet", "attrs": {"of": "plan.id"}}]},
    {"id": "r2", "blocks": [{"for each": "item", "name": "item"}, {"for each": "t", "name": "sheet", "on": "t.attrs['of'] = item.parent_id", "target": True}, {"insert": "row", "value": "item.attrs['name']"}]},
]


def read(spark, **docs):
    return shredded(spark.createDataFrame(list(docs.items()), "doc string, text string"), "doc", "text").where("error is null").drop("error")


def xml(state, doc):
    return {r["doc"]: r["xml"] for r in serialised(state.nodes.withColumn("attrs", F.map_filter("attrs", lambda k, _: k != "id"))).collect()}.get(doc)


def test_documents_are_derived_and_follow_edits(spark):
    state = blocks.run(read(spark, d="<plan id='f'><item id='g' name='first'/></plan>"), SHEETS)
    assert xml(state, "sheet-f.xml") == '<sheet of="f"><row>first</row></sheet>' and state.counts["resolved"] == 2
    assert sorted((r["key"], r["affected"]) for r in state.mods.collect()) == [("_r1.f.", "_r1.f.r1."), ("_r2.g.-5f-r1-2e-f-2e-r1-2e-.", "_r2.g.-5f-r1-2e-f-2e-r1-2e-.r2.")]
    edited = read(spark, d="<plan id='f'><item id='g' name='second'/></plan>").where("id = 'g'")
    state = blocks.update(state, SHEETS, edited.select("id"), edited)
    assert xml(state, "sheet-f.xml") == '<sheet of="f"><row>second</row></sheet>'
    assert state.counts == {"resolved": 3, "withdrawn": 1, "verified": 1}  # the document stays


def test_sets_sequences_distinct_values_and_single_nodes(spark):
    text = "<root id='r'><c id='c1' k='x'><o id='o1' p='b'/><o id='o2' p='a'/><o id='o3' p='b'/></c><c id='c2' k='x'/><c id='c3' k='y'><o id='o4' p='c'/></c></root>"
    base = {"for each": "c", "name": "c", "target": True}
    kids = {"name": "o", "child of": "c", "value": "_node.attrs['p']"}
    specs = {
        "for all": ([{"for all": "s", "name": "o", "on": "_node.parent_id = c.id"}, {"insert": "out", "value": "concat_ws(' ', s)"}], {"c1": ["o1 o2 o3"], "c3": ["o4"]}),
        "with some": ([{"with some": "s", **kids}, {"insert": "out", "value": "concat_ws(' ', s)"}], {"c1": ["a b b"], "c3": ["c"]}),
        "with any": ([{"with any": "s", **kids}, {"insert": "out", "value": "concat('[', concat_ws(' ', s), ']')"}], {"c1": ["[a b b]"], "c2": ["[]"], "c3": ["[c]"]}),
        "with distinct": ([{"with distinct": "s", **kids}, {"insert": "out", "value": "s"}], {"c1": ["a", "b"], "c3": ["c"]}),
    }
    for kind, (more, want) in specs.items():
        state = blocks.run(read(spark, d=text), [{"id": "q", "blocks": [base, *more]}])
        got = {}
        for r in state.nodes.where("name = 'out'").collect():
            got.setdefault(r["parent_id"], []).append(r["value"])
        assert {k: sorted(v) for k, v in got.items()} == want, kind
    one = {"id": "one", "blocks": [base, {"for one": "o", "name": "o", "child of": "c", "where": "o.attrs['p'] = 'a' or o.attrs['p'] = 'c'"}, {"insert": "out", "value": "o.id"}]}
    state = blocks.run(read(spark, d=text), [one])
    assert sorted((r["parent_id"], r["value"]) for r in state.nodes.where("name = 'out'").collect()) == [("c1", "o2"), ("c3", "o4")]
    # A set that grows is another set: its outcome is withdrawn, and bound anew.
    added = read(spark, d=text.replace("<c id='c2' k='x'/>", "<c id='c2' k='x'><o id='o9' p='z'/></c>")).where("id = 'o9'")
    some = [{"id": "q", "blocks": [base, *specs["with some"][0]]}]
    state = blocks.run(read(spark, d=text), some)
    state = blocks.update(state, some, added.where("false").select("id"), added)
    assert sorted((r["parent_id"], r["value"]) for r in state.nodes.where("name = 'out'").collect()) == [("c1", "a b b"), ("c2", "z"), ("c3", "c")]
    with pytest.raises(Exception, match="more than one o"):
        blocks.run(read(spark, d=text), [{"id": "one", "blocks": [base, {"for one": "o", "name": "o", "child of": "c"}, {"insert": "out"}]}])


def test_a_sort_as_data(spark):
    sort = {"id": "s", "blocks": [{"for each": "b", "name": "row"}, {"sort": "b", "by": "lower(b.attrs['name'])"}]}
    state = blocks.run(read(spark, d="<plan id='f'><row id='b1' name='pear'/><row id='b2' name='Fig'/></plan>"), [sort])
    assert xml(state, "d") == '<plan><row name="Fig"/><row name="pear"/></plan>' and state.sorted["checked"] == 1


@pytest.mark.parametrize(("given", "message"), [
    ([{"for every": "x"}, {"insert": "y"}], "one type"),
    ([{"for each": "x", "color": "red"}, {"insert": "y", "under": "x"}], "takes no color"),
    ([{"for each": "x", "name": "a"}, {"for each": "x", "name": "b", "child of": "x"}, {"insert": "y", "under": "x"}], "cannot bind x again"),
    ([{"insert": "y"}, {"for each": "x"}], "come first"),
    ([{"for each": "x"}], "comes last"),
    ([{"for each": "x", "name": "a"}, {"insert": "y"}], "no block is a target"),
    ([{"for all": "x", "name": "a"}, {"sort": "x", "by": "1"}], "bound by for each"),
])
def test_wrong_rules_are_refused_when_compiled(given, message, spark):
    with pytest.raises(ValueError, match=message):
        blocks.compiled({"id": "bad", "blocks": given})


def test_what_changed_is_found_by_content_and_types_can_be_added(spark):
    before = blocks.compiled(SHEETS[1])
    again = blocks.compiled({"blocks": [dict(reversed(b.items())) for b in SHEETS[1]["blocks"]], "id": "r2"})
    other = blocks.compiled({"id": "r2", "blocks": [*SHEETS[1]["blocks"][:2], {"insert": "row", "value": "upper(item.attrs['name'])"}]})
    assert rules.first_difference(before, again) is None and rules.first_difference(before, other) == 2
    try:
        blocks.block("mark", binds=False)(lambda bound, scope, spec: blocks._made(bound, scope, {}, f"mark-{spec['mark']}", scope.target, None))
        state = blocks.run(read(spark, d="<a id='a'/>"), [{"id": "m", "blocks": [{"for each": "x", "name": "a", "target": True}, {"mark": "7"}]}])
        assert xml(state, "d") == "<a><mark-7/></a>"
    finally:
        del blocks.BLOCKS["mark"]
