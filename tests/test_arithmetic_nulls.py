"""Arithmetic of a null."""

from __future__ import annotations

from grovewise.plans import REGISTERED
from grovewise.registry import QUERIES

assert REGISTERED


def test_arithmetic_leaves_out_a_null(spark, tmp_path):
    spark.createDataFrame([(1, 12), (1, None)], "user_id long, event_id long").write.parquet(f"{tmp_path}/events.parquet")
    rows = QUERIES["fn_arithmetic"](spark, str(tmp_path)).collect()
    assert [(r["event_id"], r["whole"], r["negated"]) for r in rows] == [(12, 0, -4.0)]
