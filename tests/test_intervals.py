"""Intervals and points, labels of trees, axes by labels: against plain counts on drawn cases."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from grovewise.operators import axes, bindings, intervals
from grovewise.operators.axes import each, step
from grovewise.sources.forest import NODE


def drawn_forest(seed, docs=3, n=40):
    """Rows of NODE: trees of random shape whose documents use the same ids, siblings of one position, several roots."""
    rnd, rows = random.Random(seed), []
    for d in range(docs):
        doc, made = f"d{d}", []
        for i in range(rnd.randint(1, n)):
            up = rnd.choice(made) if made and rnd.random() < 0.95 else None
            ord_ = rnd.randint(0, 6)
            path = [*(up["path"] if up else []), f"n{i:02}"]
            made.append({"doc": doc, "id": f"n{i:02}", "parent_id": up["id"] if up else None, "path": path, "pos": [*(up["pos"] if up else []), ord_], "ord": ord_, "kind": rnd.choice(["element", "element", "text"]), "name": rnd.choice("ab"), "attrs": {"k": str(i), "l": "x"} if i % 3 else {}, "value": None})
        rows += made
    return rows


def walked(rows):
    """(doc, id) to (pre, end, level) by a plain walk."""
    out, kids = {}, {}
    for r in rows:
        kids.setdefault((r["doc"], r["parent_id"]), []).append(r)

    def walk(doc, up, at, level):
        for r in sorted(kids.get((doc, up), []), key=lambda r: (r["ord"], r["id"])):
            end = walk(doc, r["id"], at + 1, level + 1)
            out[doc, r["id"]] = (at, end, level)
            at = end
        return at

    for doc in {r["doc"] for r in rows}:
        walk(doc, None, 0, 0)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_labels_equal_a_walk(spark, seed):
    rows = drawn_forest(seed)
    nodes = spark.createDataFrame([tuple(r.values()) for r in rows], NODE)
    want = walked(rows)
    assert {(r["doc"], r["id"]): (r["pre"], r["end"]) for r in intervals.labelled(nodes).collect()} == {k: v[:2] for k, v in want.items()}
    bare = nodes.select("doc", "id", "parent_id", "ord").unionByName(spark.createDataFrame([("d0", "lost", "nowhere", 0), ("d0", "below", "lost", 0), ("d9", "x", "y", 0), ("d9", "y", "x", 0)], "doc string, id string, parent_id string, ord long"))
    assert {(r["doc"], r["id"]): (r["pre"], r["end"], r["level"]) for r in intervals.labelled_by_parents(bare).collect()} == want
    assert intervals.labelled_by_parents(bare.limit(0)).count() == 0


def related(rows, axis):
    """Pairs of (doc, id, id) by the definition of an axis."""
    label = walked(rows)
    out = set()
    for a in rows:
        for b in rows:
            if a["doc"] != b["doc"]:
                continue
            (p, e, _), (q, f, _) = label[a["doc"], a["id"]], label[b["doc"], b["id"]]
            sibling = a["parent_id"] == b["parent_id"] and a["parent_id"] is not None
            holds = {
                "self": a is b, "child": b["parent_id"] == a["id"], "parent": a["parent_id"] == b["id"], "descendant": p < q < e, "descendant-or-self": p <= q < e, "ancestor": q < p < f, "ancestor-or-self": q <= p < f,
                "following": q >= e, "preceding": f <= p, "following-sibling": sibling and b["ord"] > a["ord"], "preceding-sibling": sibling and b["ord"] < a["ord"],
            }[axis]
            if holds:
                out.add((a["doc"], a["id"], b["id"]))
    return out


@pytest.mark.parametrize("axis", [a for a in axes.AXES if a != "attribute"])
def test_axes_of_documents_with_the_same_ids(spark, axis):
    rows = drawn_forest(7, n=14)
    nodes = spark.createDataFrame([tuple(r.values()) for r in rows], NODE)
    want = related(rows, axis)
    kinds, names = ({(r["doc"], r["id"]): r[k] for r in rows} for k in ("kind", "name"))
    labelled = intervals.checkpointed(intervals.labelled(nodes))
    # Without labels, siblings of one position have no order, so what follows isn't defined between them.
    plain = labelled if axis in ("following", "preceding") else nodes
    for forest, test, keeps in ((labelled, None, lambda k: True), (plain, "*", lambda k: kinds[k] == "element"), (labelled, "a", lambda k: names[k] == "a")):
        got = step(each(forest, "s"), forest, "s", axis, test, "x").select("s.doc", "s.id", "x.id", "x.doc").collect()
        assert all(r[0] == r[3] for r in got)
        assert sorted(tuple(r[:3]) for r in got) == sorted(p for p in want if keeps((p[0], p[2]))), (axis, test)
    outer = step(each(labelled, "s"), labelled, "s", axis, "a", "x", outer=True)
    assert outer.where("x is null").select("s.doc", "s.id").distinct().count() == len(rows) - len({p[:2] for p in want if names[p[0], p[2]] == "a"})


def test_all_attributes(spark):
    rows = drawn_forest(3, docs=1, n=6)
    nodes = spark.createDataFrame([tuple(r.values()) for r in rows], NODE)
    got = step(each(nodes, "s"), nodes, "s", "attribute", "*", "a").select("s.id", "a.name", "a.value").collect()
    assert sorted(map(tuple, got)) == sorted((r["id"], k, v) for r in rows for k, v in r["attrs"].items())
    assert step(each(nodes, "s"), nodes, "s", "attribute", "*", "a", outer=True).count() == len(got) + sum(not r["attrs"] for r in rows)


def test_node_sets_and_nearest_of_documents_with_the_same_ids(spark):
    rows = drawn_forest(5, docs=2, n=12)
    nodes = spark.createDataFrame([tuple(r.values()) for r in rows], NODE)
    d0 = nodes.where("doc = 'd0'")
    key = lambda df: sorted((r["doc"], r["id"]) for r in df.collect())
    assert key(bindings.union(d0, nodes)) == key(nodes) and key(bindings.intersect(d0, nodes)) == key(d0) and key(bindings.minus(nodes, d0)) == key(nodes.where("doc <> 'd0'"))
    some = nodes.where("doc = 'd0' and parent_id is not null or doc = 'd1' and parent_id is null")
    top = {(r["doc"], r["id"]) for r in rows if r["doc"] == "d1" and r["parent_id"] is None} | {(r["doc"], r["id"]) for r in rows if r["doc"] == "d0" and len(r["path"]) == 2}
    assert set(key(bindings.topmost(some))) == top
    near = axes.nearest(each(nodes, "s"), nodes, "s", "k").select("s.doc", "s.id", "found.doc", "found.id").collect()
    by = {(r["doc"], r["id"]): r for r in rows}
    assert all(a == c and by[a, d]["attrs"] for a, _, c, d in near) and len(near) == sum(any(by[r["doc"], i]["attrs"] for i in r["path"]) for r in rows)


@pytest.mark.parametrize("block", [2, 4096])
def test_stabbing_equals_all_pairs(spark, block):
    rnd = random.Random(block)
    spans = [(i, rnd.choice(["a", "b", None]), rnd.choice([None, *range(12)]), rnd.choice([None, *range(12)])) for i in range(60)]
    dots = [(i, rnd.choice(["a", "b", "b", None]), rnd.choice([None, *range(12)])) for i in range(80)]
    s, d = spark.createDataFrame(spans, "i int, k string, lo long, hi long"), spark.createDataFrame(dots, "p int, k string, at long")
    holds = lambda s, d: s[1] == d[1] is not None and d[2] is not None and (s[2] is None or s[2] <= d[2]) and (s[3] is None or d[2] < s[3])
    want = sorted((x[0], y[0]) for x in spans for y in dots if holds(x, y))
    got = intervals.inside(s, d, ["k"], F.col("lo"), F.col("hi"), F.col("at"), ["p"], block)
    assert sorted((r["i"], r["p"]) for r in got.collect()) == want
    n = {r["i"]: r["n"] for r in intervals.stabbed(s, d, ["k"], F.col("lo"), F.col("hi"), F.col("at")).collect()}
    assert n == {x[0]: sum(w[0] == x[0] for w in want) for x in spans}


def test_counts_along_axes_without_pairs(spark):
    rows = drawn_forest(11)
    nodes = intervals.checkpointed(intervals.labelled(spark.createDataFrame([tuple(r.values()) for r in rows], NODE)))
    for axis in ("descendant", "descendant-or-self", "following", "preceding"):
        got = intervals.structural_count(each(nodes, "s"), each(nodes, "x", "a"), "s", axis, "x")
        names = {(r["doc"], r["id"]): r["name"] for r in rows}
        want = [p[:2] for p in related(rows, axis) if names[p[0], p[2]] == "a"]
        assert {(r["s"]["doc"], r["s"]["id"]): r["n"] for r in got.collect()} == {(r["doc"], r["id"]): want.count((r["doc"], r["id"])) for r in rows}


def test_a_deep_chain(spark):
    """A hundred chains, a thousand levels deep: one list ranking of eleven rounds, no paths of a thousand ids."""
    n, depth = 100_000, 1_000
    ids = spark.range(n).select(F.floor(F.col("id") / depth).cast("string").alias("doc"), F.col("id").cast("string").alias("id"), F.when(F.col("id") % depth > 0, (F.col("id") - 1).cast("string")).alias("parent_id"), F.lit(0).cast("long").alias("ord"))
    found = intervals.labelled_by_parents(ids)
    wrong = found.where((F.col("pre") != F.col("id").cast("long") % depth) | (F.col("level") != F.col("pre")) | (F.col("end") != depth))
    assert found.count() == n and wrong.count() == 0


def test_one_key_with_very_many_points_is_swept_in_ranges(spark):
    ranges = spark.range(200).select(F.lit(1).alias("k"), (F.col("id") * 5000).alias("lo"), (F.col("id") * 5000 + 2500).alias("hi"))
    points = spark.range(1_000_000).select(F.lit(1).alias("k"), F.col("id").alias("at"))
    found = intervals.stabbed(ranges, points, ["k"], F.col("lo"), F.col("hi"), F.col("at"))
    assert found.where("n = 2500 and first = lo").count() == 200
