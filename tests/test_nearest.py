"""The nearest node without whole rows meeting."""

from __future__ import annotations

from pyspark.sql import functions as F

from grovewise.operators import axes
from grovewise.sources.forest import NODE


def test_nearest_is_the_deepest_that_has_the_attribute(spark):
    rows = [("d", i, p[-2] if len(p) > 1 else None, p, [0] * len(p), 0, "element", "x", a, None) for i, p, a in (
        ("r", ["r"], {"k": "1"}), ("a", ["r", "a"], {}), ("b", ["r", "a", "b"], {"k": "2"}), ("c", ["r", "a", "b", "c"], {}))]
    rows += [("e", "r", None, ["r"], [0], 0, "element", "x", {}, None)]
    f = spark.createDataFrame(rows, NODE)
    found = axes.nearest(axes.each(f, "x"), f, "x", "k").select("x.doc", "x.id", F.col("found.id").alias("f"))
    assert sorted(map(tuple, found.collect())) == [("d", "a", "r"), ("d", "b", "b"), ("d", "c", "b"), ("d", "r", "r")]
    assert "max_by" not in found._jdf.queryExecution().optimizedPlan().toString()
