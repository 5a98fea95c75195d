"""Documents are rendered as they come in order: none has a group of its own, none is cut where a batch ends."""

import pyarrow as pa
from pyspark.sql import functions as F

from grovewise.plans.trees import mixed_content
from grovewise.sources import documents
from grovewise.sources.forest import NODE

WRITTEN = pa.schema([("doc", pa.string()), ("id", pa.string()), ("parent_id", pa.string()), ("kind", pa.string()), ("name", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("value", pa.string())])


def test_documents_that_go_on_in_the_next_batch_stay_whole(monkeypatch):
    rows = []
    for doc in (None, "a", "b", "c"):
        rows += [(doc, "r", None, "element", "p", [("k", '<"')], None), (doc, "t", "r", "text", "#text", [], "x & "), (doc, "e", "r", "element", "b", [], doc)]
    want = [(d, f'<p k="&lt;&quot;">x &amp; {f"<b>{d}</b>" if d else "<b/>"}</p>') for d in (None, "a", "b", "c")]
    for at_once, most in ((1, 1), (2, 3), (100, 4096)):
        monkeypatch.setattr(documents, "SHREDDED", most)
        batches = [pa.RecordBatch.from_pylist([dict(zip(WRITTEN.names, r, strict=True)) for r in rows[i : i + at_once]], WRITTEN) for i in range(0, len(rows), at_once)]
        got = [b.to_pylist() for b in documents.rendered_batches(iter(batches))]
        assert [(r["doc"], r["xml"]) for b in got for r in b] == want and all(len(b) <= most for b in got)
    assert list(documents.rendered_batches(iter([]))) == []


def test_no_document_is_a_group_of_its_own(spark):
    nodes = spark.createDataFrame([("d", "r", None, ["r"], [0], 0, "element", "p", {}, None), ("d", "x", "r", ["r", "x"], [0, 1], 1, "element", "b", {}, "2"), ("d", "w", "r", ["r", "w"], [0, 0], 0, "element", "a", {}, "1")], NODE)
    out = documents.serialised(nodes)
    assert [tuple(r) for r in out.collect()] == [("d", "<p><a>1</a><b>2</b></p>")]
    assert "FlatMapGroups" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert documents.serialised(nodes.limit(0)).count() == 0
    found = mixed_content(spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" not in plan and "MapInArrow" not in plan  # written once, read twice
    assert found.where(F.col("after") == ". End").count() == found.count() > 0
