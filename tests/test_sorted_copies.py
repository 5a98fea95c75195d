"""Arrays of copies in sorted runs, pairs of chosen classes, and shares of rows that repeat each other."""

from __future__ import annotations

from pyspark.sql import functions as F

from grovewise.operators import similarity
from grovewise.plans import REGISTERED
from grovewise.registry import QUERIES

assert REGISTERED


def test_arrays_of_a_class_are_short_and_do_not_overlap(spark):
    n = 20 * similarity.COPIES
    rows = spark.range(n).select("id", (F.col("id") % 2).alias("k"))
    for k in (0, 1):
        got = sorted(sorted(r["ids"]) for r in similarity.copies(rows, ["k"], F.col("id"), "id", "ids").where(F.col("k") == k).collect())
        assert [i for ids in got for i in ids] == list(range(k, n, 2)) and max(map(len, got)) <= similarity.COPIES


def test_only_chosen_classes_meet(spark):
    rows = spark.range(300).select("id", F.lit("g").alias("k"), (F.col("id") % 3).alias("size"))
    got = similarity.pairs_of_copies(rows, ["k"], "id", ["size"], {"cost": F.lit(1.0)}, only=F.col("x.size") != F.col("y.size"))
    found = sorted((r["a"], r["b"]) for r in got.collect())
    assert found == sorted((a, b) for a in range(300) for b in range(a) if a % 3 != b % 3)


def test_parts_of_other_sizes_have_the_cost_of_unlike_ones(spark, tmp_path):
    rows = [(i, "ab", "Brand#1", "X Y", size) for i, size in enumerate([1, 1, 11, 11, 2, None])] + [(6, "ab", None, "X Y", 1)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    other = [(2, 0, 100.0), (2, 1, 100.0), (3, 0, 100.0), (3, 1, 100.0)]
    for query, cost in (("pair_cost", -400.0), ("package_cost", -500.0)):
        got = QUERIES[query](spark, str(tmp_path))
        assert sorted(map(tuple, got.collect())) == sorted([(1, 0, cost), (3, 2, cost), *other])


def test_rows_that_repeat_each_other_share_once(spark):
    rows = [(i, v, i % 2) for i in range(8) for v in range(10) if (i * v) % 3 != 1]
    once, twice = (spark.createDataFrame(r, "id long, v int, k int") for r in (rows, rows + rows[::2]))
    got, want = (sorted(similarity.common_share_within(h, "id", "v", ["k"]).collect()) for h in (twice, once))
    assert got == want and len(want) > 5
