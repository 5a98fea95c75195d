"""The quality rules stay out of the plan: hundreds of them as one expression take the driver hundreds of MB to compile."""

import numpy as np
from pyspark.sql import functions as F

from grovewise.llm import quality
from grovewise.llm.quality import STATS, RuleModel, statistics


def _many(x: np.ndarray) -> RuleModel:
    rng = np.random.default_rng(7)
    edges = np.quantile(x, np.linspace(0.1, 0.9, 9), axis=0)
    pick = lambda: (int(s := rng.integers(len(STATS))), bool(rng.integers(2)), float(edges[rng.integers(9), s]))
    return RuleModel(-0.3, tuple(((pick(), pick()), float(w)) for w in rng.normal(size=60)))


def test_rules_are_summed_outside_of_the_plan_with_the_same_scores(spark, monkeypatch):
    rng = np.random.default_rng(1)
    texts = ["", None, *(" ".join(rng.choice(["the", "A", "9", "##", "x.", "!"], n)) for n in rng.integers(1, 80, 200))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    x = statistics(docs.toArrow().column("text").combine_chunks().fill_null(""))
    model = _many(x)
    measured = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{s} double" for s in STATS))
    want = [r[0] for r in measured.select(model.column()).collect()]
    monkeypatch.setattr(quality, "fit_rules", lambda *_: model)
    labels = spark.createDataFrame([(i, i % 2) for i in range(len(texts))], "doc_id long, quality int")
    got = quality.quality(docs, labels)
    assert [r["score"] for r in sorted(got.collect(), key=lambda r: r["doc_id"])] == want
    kept = quality.good_documents(docs.withColumn("log_odds", F.lit("own")), labels)
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i, s in enumerate(want) if s >= 0.3]
    for df in (got, kept):
        assert len(df._jdf.queryExecution().optimizedPlan().toString()) < 4000
