"""Sharding of large groups: exact sizes by default, rounded ones where there would be too many."""

from __future__ import annotations

from collections import defaultdict

import pytest

from grovewise.llm import sharding


@pytest.mark.parametrize("classes", [1 << 20, 3])
def test_large_groups_are_packed_by_exact_sizes(spark, monkeypatch, classes):
    monkeypatch.setattr(sharding, "CLASSES", classes)
    # Above 16 bits, two sizes that only differ in their last bits fill a bin to the byte.
    sizes = [100_003, 99_997, 100_001, 99_999, 120_000, 80_000]
    docs = spark.createDataFrame([(i, chr(97 + i) * (s - 8)) for i, s in enumerate(sizes)], "doc_id long, text string")
    if classes > 3:
        got = sharding.shard_documents(docs, shards=None, capacity=200_000).collect()
        loads = defaultdict(int)
        for r in got:
            loads[r["shard"]] += r["size"]
        assert sorted(loads.values()) == [200_000] * 3
    got = sharding.shard_documents(docs, shards=3).collect()
    assert sorted(r["size"] for r in got) == sorted(sizes) and {r["shard"] for r in got} == {0, 1, 2}
    loads = [sum(r["size"] for r in got if r["shard"] == s) for s in range(3)]
    assert max(loads) - min(loads) <= 200_000 / 1000 and sum(loads) == sum(sizes)
