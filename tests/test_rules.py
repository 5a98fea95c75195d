"""Rules maintained node by node: partial bindings, what an edit looks at, what a changed rule keeps."""

from __future__ import annotations

import functools
import random

import pytest
from pyspark.sql import functions as F

from grovewise.operators import rules
from grovewise.operators.axes import attr
from grovewise.sources.forest import NODE


def nodes_of(spark, items):
    """One document of a root with items (kind, link, v) and one of pages."""
    rows = [("d", "root", None, ["root"], [0], 0, "element", "root", {}, None)]
    rows += [("d", i, "root", ["root", i], [0, k], k, "element", kind, {"to": to, "v": v}, None) for k, (i, (kind, to, v)) in enumerate(sorted(items.items()))]
    return spark.createDataFrame(rows, NODE)


def helper(v):
    return F.upper(v)


def three_blocks(note=None):
    """a -> b -> c by links, a note under c, and a tag under each note."""
    on = lambda left, right: lambda bound, found: bound.join(found, attr(left, "to") == F.col(f"{right}.id"))
    blocks = [rules.For("a", "a"), rules.For("b", "b", on("a", "b")), rules.For("c", "c", on("b", "c"), target=True)]
    key = rules.binding_key("n", F.col("a.id"), F.col("b.id"), F.col("c.id"))
    refs = lambda: [F.col(f"{v}.id") for v in "abc"]
    note = note or (lambda b: rules.inserted(b, key, refs(), [F.col("a.doc")], F.col("c.id"), "note", value=F.concat(attr("a", "v"), attr("b", "v"), attr("c", "v"))))
    tag = lambda b: rules.inserted(b, rules.binding_key("t", F.col("n.id")), [F.col("n.id")], [F.col("n.doc")], F.col("n.id"), "tag", value=helper(F.col("n.value")))
    return [rules.rule("t", [rules.For("n", "note")], tag), rules.rule("n", blocks, note)]


def out(state):
    return sorted((r["name"], r["value"], r["parent_id"]) for r in state.nodes.where("name in ('note', 'tag')").collect())


def drawn(rnd, n=18):
    ids = [f"{k}{i}" for k in "abc" for i in range(n // 3)]
    to = {"a": [i for i in ids if i[0] == "b"], "b": [i for i in ids if i[0] == "c"], "c": ["x"]}
    return {i: (i[0], rnd.choice(to[i[0]]), str(rnd.randint(0, 3))) for i in ids if rnd.random() < 0.8}


def test_edits_of_three_block_rules_equal_runs_from_scratch(spark):
    rnd, both = random.Random(8), three_blocks()
    now = drawn(rnd)
    state = rules.run(rules.start(nodes_of(spark, now)), both)
    for _ in range(2):
        after = {i: (x if rnd.random() < 0.7 else drawn(rnd).get(i, x)) for i, x in (now | drawn(rnd)).items() if rnd.random() < 0.9}
        gone, came = [i for i in now if after.get(i) != now[i]], [i for i in after if now.get(i) != after[i]]
        state = rules.update(state, both, spark.createDataFrame([(i,) for i in gone], "id string"), nodes_of(spark, after).where(F.col("id").isin(came)))
        fresh = rules.run(rules.start(nodes_of(spark, after)), both)
        assert out(state) == out(fresh)
        # The stored bindings of the first two blocks are those of a run from scratch, one of each.
        pairs = lambda s: sorted(map(tuple, s.partial["n"][0][1].select("a.id", "b.id", attr("a", "v"), attr("b", "v")).collect()))
        assert pairs(state) == pairs(fresh) == sorted((a, x[1], x[2], after[x[1]][2]) for a, x in after.items() if x[0] == "a" and x[1] in after)
        now = after


def test_an_edit_looks_at_bindings_of_its_nodes_only(spark):
    items = {f"{k}{i}": (k, f"{chr(ord(k) + 1)}{i}", "v") for k in "abc" for i in range(40)}
    both = three_blocks()
    state = rules.run(rules.start(nodes_of(spark, items)), both)
    assert state.counts == {"resolved": 80, "withdrawn": 0, "verified": 0} and state.cycles == 3
    edited = nodes_of(spark, items | {"b7": ("b", "c7", "new"), "c9": ("c", "x", "new")}).where("id in ('b7', 'c9')")
    looked = rules.node_delta(both[1], state.nodes, edited, None, [d for _, d in state.partial["n"]])
    assert looked.count() == 2  # of 40, in the one document that all nodes lie in
    state = rules.update(state, both, spark.createDataFrame([("b7",), ("c9",)], "id string"), edited)
    # Two notes are verified and withdrawn with their tags, and resolved anew; tags of notes that stay aren't looked at.
    assert state.counts == {"resolved": 84, "withdrawn": 4, "verified": 2}
    same = nodes_of(spark, items).where("id = 'a3'")
    state = rules.update(state, both, same.select("id"), same)
    assert state.counts == {"resolved": 84, "withdrawn": 4, "verified": 3}  # bound again to the same outcome


def test_a_changed_rule_keeps_what_stays_the_same(spark):
    items = {f"{k}{i}": (k, f"{chr(ord(k) + 1)}{i}", str(i)) for k in "abc" for i in range(4)}
    before = three_blocks()
    state = rules.run(rules.start(nodes_of(spark, items)), before)
    first = state.partial["n"][0][1]
    key = rules.binding_key("n", F.col("a.id"), F.col("b.id"), F.col("c.id"))
    other = lambda b: rules.inserted(b, key, [F.col(f"{v}.id") for v in "abc"], [F.col("a.doc")], F.col("c.id"), "note", value=F.when(F.col("a.id") == "a2", "!").otherwise(F.concat(attr("a", "v"), attr("b", "v"), attr("c", "v"))))
    after = three_blocks(other)
    assert rules.first_difference(before[1], after[1]) == 3
    state = rules.changed_rules(state, before, after)
    assert state.counts["withdrawn"] == 2 and state.partial["n"][0][1] is first
    state = rules.run(state, after)
    assert out(state) == out(rules.run(rules.start(nodes_of(spark, items)), after)) and state.counts["resolved"] == 10
    assert rules.changed_rules(state, after, after[:1]).counts["withdrawn"] == 2 + 8  # a rule that is gone


def test_marks_follow_helpers_defaults_and_partials(monkeypatch):
    def first(b, k=1):
        return helper(b)

    def second(b, k=2):
        return helper(b)

    assert rules._mark(first) != rules._mark(second)
    second.__defaults__ = (1,)
    assert rules._mark(first) == rules._mark(second)
    mark = rules._mark(first)
    monkeypatch.setitem(globals(), "helper", lambda v: F.lower(v))
    assert rules._mark(first) != mark
    add = lambda a, b: a + b
    assert rules._mark(functools.partial(add, 1)) != rules._mark(functools.partial(add, 2)) == rules._mark(functools.partial(add, 2))


def test_ids_must_be_unique_and_can_be_made_so(spark):
    one = nodes_of(spark, {"a1": ("a", "b1", "x")})
    twice = one.unionByName(one.withColumn("doc", F.lit("e")))
    with pytest.raises(ValueError, match="in several documents"):
        rules.start(twice)
    state = rules.start(rules.qualified(twice))
    assert sorted((r["id"], r["parent_id"], r["path"]) for r in state.nodes.where("name = 'a'").collect()) == [(f"{d}#a1", f"{d}#root", [f"{d}#root", f"{d}#a1"]) for d in "de"]
