"""Order labels with gaps and sorts of rules: few nodes move, and what is below moves along."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from grovewise.operators import ordering, rules
from grovewise.operators.axes import attr
from grovewise.sources.forest import NODE


def bowl(spark, fruits, below=True):
    """A bowl with fruits (id, name, ord), in each of them a leaf, and a fixed child between."""
    rows = [("d", "f", None, ["f"], [0], 0, "element", "bowl", {}, None), ("d", "x", "f", ["f", "x"], [0, 1], 1, "element", "other", {}, None)]
    rows += [("d", i, "f", ["f", i], [0, o], o, "element", "fruit", {"name": n}, None) for i, n, o in fruits]
    rows += [("d", f"{i}.leaf", i, ["f", i, f"{i}.leaf"], [0, o, 0], 0, "element", "leaf", {}, None) for i, _, o in fruits if below]
    return spark.createDataFrame(rows, NODE)


def order(state):
    assert state.nodes.where("ord <> element_at(pos, -1)").count() == 0
    leaves = state.nodes.where("name = 'leaf'").select(F.col("parent_id").alias("id"), F.col("pos").alias("p"))
    assert state.nodes.where("name = 'fruit'").join(leaves, "id").where("slice(p, 1, 2) <> pos").count() == 0
    return [r["id"] for r in state.nodes.where("name = 'fruit'").orderBy("ord").collect()]


def test_a_sort_moves_what_changed_and_nothing_else(spark):
    by_name = rules.Sort("by-name", (rules.For("b", "fruit"),), F.lower(attr("b", "name")))
    state = rules.settle(rules.run(rules.start(bowl(spark, [("b1", "apple", 0), ("b2", "MELON", 2), ("b3", "Quince", 3)])), []), [by_name])
    assert order(state) == ["b1", "b2", "b3"] and state.sorted == {"checked": 1, "moved": 0}
    edited = bowl(spark, [("b3", "banana", 3)]).where("id = 'b3'")
    state = rules.settle(rules.update(state, [], edited.select("id"), edited), [by_name])
    assert order(state) == ["b1", "b3", "b2"] and state.sorted == {"checked": 2, "moved": 1}
    # The child that isn't sorted stays where it was, and no place is taken twice.
    assert [r["id"] for r in state.nodes.where("parent_id = 'f'").orderBy("ord").collect()] == ["b1", "b3", "x", "b2"]
    before = {r["id"]: r["ord"] for r in state.nodes.collect()}
    new = bowl(spark, [("b4", "apricot", 9)]).where("id like 'b4%'")
    state = rules.settle(rules.update(state, [], new.where("false").select("id"), new), [by_name])
    assert order(state) == ["b1", "b4", "b3", "b2"] and state.sorted == {"checked": 3, "moved": 1 + 1}
    assert {r["id"]: r["ord"] for r in state.nodes.where("id not like 'b4%'").collect()} == before  # there was a gap
    state = rules.settle(state, [by_name])
    assert state.sorted["checked"] == 3


def test_outputs_that_tell_a_place_follow_a_sort(spark):
    note = rules.rule("n", [rules.For("b", "fruit")], lambda b: rules.inserted(b, rules.binding_key("n", F.col("b.id")), [F.col("b.id")], [F.col("b.doc")], None, "note", value=F.col("b.ord").cast("string"), under="b"))
    down = rules.Sort("d", (rules.For("b", "fruit"),), attr("b", "name"), descending=True)
    state = rules.settle(rules.run(rules.start(bowl(spark, [("b1", "a", 0), ("b2", "b", 2)])), [note]), [down], [note])
    assert order(state) == ["b2", "b1"]
    ords = {r["id"]: str(r["ord"]) for r in state.nodes.where("name = 'fruit'").collect()}
    assert {r["parent_id"]: r["value"] for r in state.nodes.where("name = 'note'").collect()} == ords


def test_two_values_for_one_child_are_an_error(spark):
    twice = rules.Sort("t", (rules.For("x", "fruit"), rules.For("b", "fruit", lambda bound, found: bound.join(found, F.col("x.parent_id") == F.col("b.parent_id")))), attr("x", "name"))
    with pytest.raises(Exception, match="more than one value"):
        rules.settle(rules.run(rules.start(bowl(spark, [("b1", "a", 0), ("b2", "b", 2)])), []), [twice])


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_labels_order_and_touch_little(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for p in range(4):
        names = sorted(rnd.randint(0, 30) for _ in range(25))
        ords = sorted(rnd.sample(range(100_000), 25))
        for i, (v, o) in enumerate(zip(names, ords, strict=True)):
            fresh = rnd.random() < 0.2
            rows.append((p, f"{i:02}", rnd.choice(ords) if fresh and p else o, fresh, rnd.randint(0, 30) if fresh and p else v))
    df = spark.createDataFrame(rows, "parent int, id string, ord long, fresh boolean, v int")
    got = ordering.order_labels(df, "parent", [F.col("v")]).collect()
    assert len(got) == len(rows) and all(r["room"] for r in got)
    for p in range(4):
        mine = sorted((r["v"], r["id"], r["label"]) for r in got if r["parent"] == p)
        assert [m[2] for m in mine] == sorted(m[2] for m in mine) and len({m[2] for m in mine}) == 25
    assert all(r["label"] == r["ord"] for r in got if not r["fresh"] or r["parent"] == 0)
    dense = ordering.order_labels(spark.createDataFrame([(0, "a", 1, False, 1), (0, "b", 2, False, 3), (0, "c", 9, True, 2), (1, "d", 4, True, 1)], df.schema), "parent", [F.col("v")])
    assert {r["id"]: r["room"] for r in dense.collect()} == {"a": False, "b": False, "c": False, "d": True}


def test_running_extremes_equal_plain_ones(spark):
    rnd = random.Random(4)
    rows = [(rnd.randint(0, 1), n, rnd.choice([None, *range(20)])) for n in range(300)]
    got = ordering.running_extremes(spark.createDataFrame(rows, "p int, n int, v int"), "p", "n", "v", "hi", "lo").collect()
    for r in got:
        before, after = ([x[2] for x in rows if x[0] == r["p"] and x[2] is not None and (x[1] < r["n"] if past else x[1] > r["n"])] for past in (True, False))
        assert r["hi"] == max(before, default=None) and r["lo"] == min(after, default=None)
