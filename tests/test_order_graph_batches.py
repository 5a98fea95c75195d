"""Parents whose children are ordered many in a batch."""

from __future__ import annotations

from grovewise.operators import ordering


def test_parents_are_ordered_without_a_call_for_each(spark, monkeypatch):
    monkeypatch.setattr(ordering, "PLACED", 7)
    kids = [(p, f"c{i}") for p in (*range(50), None) for i in range(p % 5 + 1 if p is not None else 3)]
    children = spark.createDataFrame(kids, "parent long, id string")
    edges = [(p, f"c{i + 1}", f"c{i}", 2) for p, i in ((p, int(c[1:])) for p, c in kids)] + [(p, f"c{i}", f"c{i + 1}", 1) for p, i in ((p, int(c[1:])) for p, c in kids)] + [(7, "c1", "c0", 0), (99, "c0", "c1", 3)]
    df = ordering.priority_order(children, spark.createDataFrame(edges, "parent long, a string, b string, priority int"), "parent")
    assert "MapInArrow" in df._jdf.queryExecution().toString() and "CoGroup" not in df._jdf.queryExecution().toString()
    got = {(r["parent"], r["id"]): r["place"] for r in df.collect()}
    sizes = {p: sum(q == p for q, _ in kids) for p, _ in kids}
    assert got == {(p, c): sizes[p] - int(c[1:]) for p, c in kids}
