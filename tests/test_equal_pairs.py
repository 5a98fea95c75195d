"""Pairs of equal keys by arrays of copies."""

from __future__ import annotations

from pyspark.sql import functions as F

from grovewise.operators import similarity
from grovewise.plans import REGISTERED
from grovewise.registry import QUERIES

assert REGISTERED


def test_a_frequent_key_is_dealt_to_many_tasks(spark):
    n = 4 * similarity.COPIES + 3
    left = spark.range(n).select(F.when(F.col("id") % 50 < 48, "x").when(F.col("id") % 50 == 48, "y").alias("k"), F.col("id").alias("a"))
    right = spark.range(n).select(F.when(F.col("id") % 9 > 0, "x").alias("k"), (-F.col("id")).alias("b"))
    got = similarity.pairs_of_equals(left, right, "k", "a", "b")
    want = left.join(right, "k").select("a", "b")
    assert got.count() == want.count() > n * n / 2 and got.exceptAll(want).isEmpty()
    assert got.select(F.spark_partition_id()).distinct().count() > 1


def test_sequences_pass_over_orders_without_priority(spark, tmp_path):
    rows = [(1, 1, "F", "a"), (2, 1, "F", None), (3, 1, "F", "b"), (4, 2, "P", "a"), (5, 2, "P", "b"), (6, 3, "F", None), (7, 4, "P", None), (8, 5, "P", "a/b")]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    found = QUERIES["join_sequence_keys"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found)) == [(1, 2), (1, 5)]
