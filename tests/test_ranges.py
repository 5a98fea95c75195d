"""Ranges that hold a bounded number of rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from grovewise.operators import ordering


def test_more_rows_are_cut_into_more_ranges(spark, monkeypatch):
    monkeypatch.setattr(ordering, "RANGE", 100)
    rows = spark.range(3000).select(F.lit("p").alias("parent"), "id", (F.lit(3000) - F.col("id")).alias("by"), F.lit(1).alias("w"))
    sizes = [r["count"] for r in ordering.ranges(rows, "parent", "by").groupBy("_range").count().collect()]
    assert sum(sizes) == 3000 and len(sizes) > 20 and max(sizes) < 400
    placed = ordering.ranked_order(rows, "parent", [F.col("by")]).select("by", "place").collect()
    assert all(r["by"] == r["place"] for r in placed)
    totals = ordering.running_totals(rows, "parent", ["by"], {"t": "w"}).select("by", "t").collect()
    assert len(totals) == 3000 and all(r["by"] == r["t"] for r in totals)
