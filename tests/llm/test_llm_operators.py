"""Small tests of the ten operators: brute force, round trips, and the defined results of odd inputs."""

from __future__ import annotations

import random
import struct
import zlib
from collections import Counter, defaultdict
from math import log10

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None, "en", "a", 0), (2, "", "en", None, 0), (4, "   \n\t", None, "b", 5), (None, "one word", "en", "b", 8), (5, "same text here now", "en", "a", 18), (5, "same text here now", "en", "a", 18), (7, "x" * 3000 + " y" * 3000, "en", "a", 9000)]


def rows_of(df):
    return [r.asDict() for r in df.collect()]


@pytest.fixture(scope="module")
def words():
    rnd = random.Random(4)
    return ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7))) for _ in range(400)]


@pytest.fixture(scope="module")
def corpus(words):
    """160 texts, half of them near copies of an earlier one, some exact."""
    rnd, out = random.Random(5), []
    for i in range(160):
        if i % 2 and i > 10:
            ws = out[rnd.randrange(i)][1].split()
            for _ in range(rnd.choice((0, 1, 2, 4))):
                ws[rnd.randrange(len(ws))] = rnd.choice(words)
            text = " ".join(ws)
        else:
            text = " ".join(rnd.choice(words) for _ in range(rnd.randint(20, 120)))
        out.append((i * 3, text, "en", "s%d" % (i % 5 if i % 3 else 0), len(text)))
    return out


# ---- quality and toxicity


def test_statistics_of_odd_texts():
    from grovewise.llm.quality import STATS, statistics

    x = statistics(pa.array([None, "", "  ", "A b a A a", "hé||!!"]))
    assert x.shape == (5, len(STATS)) and np.isfinite(x).all()
    assert (x[:3, STATS.index("n_words")] == 0).all()
    assert x[3, STATS.index("distinct")] == 2 / 5 and x[3, STATS.index("common")] == 4 / 5
    assert x[4, STATS.index("pipe")] == 2 and x[4, STATS.index("bang")] == 2


@given(st.lists(st.text(alphabet="aAbB9 é\t\n|!.,#'", max_size=50), min_size=1, max_size=5))
@settings(max_examples=60, deadline=None)
def test_statistics_equal_plain_counts(texts):
    from grovewise.llm.quality import CLASSES, STATS, statistics

    x = statistics(pa.array(texts))
    for text, row in zip(texts, x, strict=True):
        raw = text.encode()
        ws = [w for w in __import__("re").split(rb"[\x20\x09-\x0d]+", bytes(c + 32 if 65 <= c <= 90 else c for c in raw)) if w]
        n, size, c = max(len(ws), 1), max(len(raw), 1), {k: sum(b in v for b in raw) for k, v in CLASSES.items()}
        letters = max(c["upper"] + c["lower"] + c["high"] // 2, 1)
        want = {
            "n_words": len(ws), "word_bytes": len(raw) / n, "upper": c["upper"] / letters, "digit": c["digit"] / size, "high": c["high"] / size, "distinct": len(set(ws)) / n,
            "repeated": sum(a == b for a, b in zip(ws, ws[1:], strict=False)) / n, "common": max(Counter(ws).values(), default=0) / n,
        } | {k: c[k] / n for k in ("mark", "pipe", "bang", "stop", "comma", "line", "quote")}
        assert np.allclose(row, [want[s] for s in STATS])


def test_rules_learn_a_conjunction_and_compile_to_the_same_scores(spark):
    from grovewise.llm.quality import STATS, fit_rules, holds

    rng = np.random.default_rng(0)
    x = rng.random((2000, len(STATS)))
    y = ((x[:, 2] > 0.6) & (x[:, 5] <= 0.5)).astype(int)
    model = fit_rules(x, y)
    total = model.bias + sum(w * holds(r, x) for r, w in model.rules)
    assert (((total > 0).astype(int)) == y).mean() > 0.98 and len(model.rules) < 120
    df = spark.createDataFrame([tuple(map(float, r)) for r in x[:50]], ", ".join(f"{s} double" for s in STATS))
    got = [r[0] for r in df.select(model.column()).collect()]
    assert np.allclose(got, 1 / (1 + np.exp(-total[:50])))
    assert fit_rules(x[:0], y[:0]).rules == () and fit_rules(x, np.ones(2000)).rules == ()


def test_quality_keeps_rows_and_defines_odd_ones(spark, corpus):
    from grovewise.llm.quality import good_documents, quality

    bad = [(10_000 + i, "### $$$ " * 20, "en", "a", 1) for i in range(60)]
    docs = spark.createDataFrame(corpus + bad + ODD, DOCS)
    labels = spark.createDataFrame([(d[0], 1, 0) for d in corpus] + [(d[0], 0, 0) for d in bad], "doc_id long, quality int, toxic int")
    got = rows_of(quality(docs, labels))
    assert len(got) == len(corpus) + len(bad) + len(ODD)
    for r in got:
        assert r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    assert all(r["predicted"] == 0 for r in got if (r["doc_id"] or 0) >= 10_000)
    clash = docs.withColumn("_n_words", F.lit(7)).withColumn("y", F.lit(1))
    kept = good_documents(clash, labels)
    assert kept.columns == clash.columns and kept.where("doc_id >= 10000").count() == 0 and kept.where("doc_id < 480").count() >= len(corpus)
    assert quality(docs.limit(0), labels).count() == 0
    assert {r["score"] for r in rows_of(quality(docs, labels.limit(0)))} == {0.5}


def test_folding_undoes_disguises():
    from grovewise.llm.toxicity import fold

    assert fold("1d10t") == fold("IDIOT") == fold("ⅰdіоt") == fold("id​iot")
    assert fold("$tup1d") == fold("stupid") and fold("idiot!!") == fold("idiot") + "!!"
    assert fold("idiot$$$ x").startswith(fold("idiot"))


def test_lexicon_matches_words_stems_and_exceptions():
    from grovewise.llm.toxicity import Lexicon, weigh

    lexicon = Lexicon({"scum": 2.0, "clown": 1.0}, {"idio": 3.0}, ("clown fish",))
    m = lexicon.matcher()
    assert weigh(m, "such scum")[0] == 2.0 and weigh(m, "scumble scums")[0] == 0.0
    assert weigh(m, "idi0tic")[0] == 3.0 and weigh(m, "video idol")[0] == 0.0
    assert weigh(m, "a clown fish")[0] == 0.0 and weigh(m, "a clown")[0] == 1.0
    assert weigh(m, "scum scum scum")[0] == 3.0
    assert weigh(Lexicon({}, {}).matcher(), "scum")[0] == 0.0


def test_exception_phrases_are_learned_and_change_scores(spark, words):
    from grovewise.llm.toxicity import fit, learn_exceptions, score_toxicity

    rnd, docs = random.Random(18), []
    for i in range(600):
        ws = [rnd.choice(words) for _ in range(30)]
        if i % 3 == 0:
            for k in (3, 17, 26):
                ws[k] = rnd.choice(("vermin", "dolt"))
        elif i % 20 == 1:
            ws[9:11] = ["vermin", "control"]
        docs.append((i, " ".join(ws), int(i % 3 == 0)))
    sample = spark.createDataFrame(docs, "doc_id long, text string, y int")
    lexicon = fit(sample)
    assert "vermin" in lexicon.words and set(lexicon.exceptions) == {"vermin contro" + "i"}
    new = spark.createDataFrame([(1, "call V3rmin control on monday"), (2, "call vermin on monday")], "doc_id long, text string")
    weight = {r["doc_id"]: r["weight"] for r in rows_of(score_toxicity(new, lexicon))}
    assert weight[1] == 0 and weight[2] > 0
    # The phrases equal a plain count of the neighbours of each hit.
    seen = defaultdict(lambda: (set(), set()))
    for _, text, y in docs:
        ws = ["", *text.replace("l", "i").replace("1", "i").split(), ""]
        for k in range(1, len(ws) - 1):
            if any(ws[k] == w for w in lexicon.words) or any(ws[k].startswith(w) for w in lexicon.stems):
                if k > 1:
                    seen[ws[k - 1] + " " + ws[k]][y].add(ws[k + 1])
                if k < len(ws) - 2:
                    seen[ws[k] + " " + ws[k + 1]][y].add(ws[k - 1])
    bare = type(lexicon)(lexicon.words, lexicon.stems)
    assert learn_exceptions(sample, bare, 1) == tuple(sorted(p for p, (clean, toxic) in seen.items() if clean and not toxic))


@given(st.lists(st.sampled_from(["scum", "clown", "clown fish", "idiots", "a", "fish", "scum.", "xclown", "idio"]), max_size=12))
@settings(max_examples=60, deadline=None)
def test_matching_equals_a_plain_scan(ws):
    from grovewise.llm.toxicity import Lexicon, fold, weigh

    lexicon = Lexicon({"scum": 2.0, "clown": 1.0}, {"idio": 3.0}, ("clown fish",))
    text = fold(" ".join(ws))
    covered = {k for k in range(len(text)) if text[k:].startswith("ciown fish".replace("ci", fold("cl"))) and text[k + 10 : k + 11] in ("", " ", ".") and text[k - 1 : k] in ("", " ")}
    found = Counter()
    for m in __import__("re").finditer(r"\w+", text):
        if m.start() in covered:
            continue
        for term, w in ((fold("scum"), 2.0), (fold("clown"), 1.0)):
            if m.group() == term:
                found[term, w] += 1
        if m.group().startswith(fold("idio")):
            found[fold("idio"), 3.0] += 1
    assert abs(weigh(lexicon.matcher(), " ".join(ws))[0] - sum(w * (1.5 if n > 1 else 1.0) for (_, w), n in found.items())) < 1e-9


def test_odd_labels_are_ignored(spark, corpus):
    from grovewise.llm.labelled import labelled_sample

    docs = spark.createDataFrame(corpus, DOCS)
    labels = spark.createDataFrame([(d[0], (0, 1, 2, None)[i % 4]) for i, d in enumerate(corpus)], "doc_id long, toxic int")
    assert {r["y"] for r in rows_of(labelled_sample(docs, labels, "toxic"))} == {0, 1}


def test_toxicity_learns_and_catches_disguises(spark, words):
    from grovewise.llm.toxicity import clean_documents, fit, score_toxicity, toxicity
    from grovewise.llm.labelled import labelled_sample

    rnd, docs, labels = random.Random(8), [], []
    for i in range(400):
        ws = [rnd.choice(words) for _ in range(40)]
        if i % 4 == 0:
            for k in (3, 17, 30):
                ws[k] = rnd.choice(("vermin", "dolt"))
        docs.append((i, " ".join(ws), "en", "a", 1))
        labels.append((i, 1, int(i % 4 == 0)))
    d, lab = spark.createDataFrame(docs + ODD, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    lexicon = fit(labelled_sample(d.where("n_chars = 1"), lab, "toxic"))
    assert {"vermin", "doit"} <= set(lexicon.words)
    new = spark.createDataFrame([(1, "you v3rm1n and d0lt are here"), (2, "a calm text of plain words"), (3, None)], "doc_id long, text string")
    assert {r["doc_id"]: r["predicted"] for r in rows_of(score_toxicity(new, lexicon))} == {1: 1, 2: 0, 3: 0}
    got = rows_of(toxicity(d, lab))
    held = [r for r in got if r["held_out"] and r["doc_id"] < 400 and r["doc_id"] > 7]
    assert all(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in held) and len(got) == 400 + len(ODD)
    kept = clean_documents(d, lab)
    assert kept.columns == d.columns and kept.where("doc_id % 4 = 0 and doc_id > 7").count() == 0 and kept.where("doc_id % 4 <> 0 and n_chars = 1").count() == 300
    assert toxicity(d.limit(0), lab.limit(0)).count() == 0


# ---- sharding


@given(st.lists(st.integers(1, 60), max_size=60))
@settings(max_examples=60, deadline=None)
def test_best_fit_decreasing_is_the_one_by_one_packing(sizes):
    from grovewise.llm.sharding import best_fit_decreasing

    capacity, plain = 64, []
    for s in sorted(sizes, reverse=True):
        fits = [(r, i) for i, r in enumerate(plain) if r >= s]
        if fits:
            plain[min(fits)[1]] -= s
        else:
            plain.append(capacity - s)
    runs = best_fit_decreasing(Counter(sizes).items(), capacity)
    left = defaultdict(lambda: capacity)
    for size, a, b, bin_ in runs:
        left[bin_] -= size * (b - a)
    assert sorted(left.values()) == sorted(plain)


@given(st.lists(st.integers(1, 200), min_size=6, max_size=40), st.integers(2, 5))
@settings(max_examples=40, deadline=None)
def test_even_capacity_places_every_group_and_is_near_the_least(sizes, bins):
    from grovewise.llm.sharding import best_fit_decreasing, even_capacity

    runs = even_capacity(list(Counter(sizes).items()), bins)
    loads, ranks = Counter(), defaultdict(list)
    for size, a, b, bin_ in runs:
        loads[bin_] += size * (b - a)
        ranks[size] += range(a, b)
    assert {s: sorted(r) for s, r in ranks.items()} == {s: list(range(n)) for s, n in Counter(sizes).items()} and set(loads) <= set(range(bins))
    least = next(c for c in range(max(max(sizes), -(-sum(sizes) // bins)), sum(sizes) + 1) if best_fit_decreasing(Counter(sizes).items(), c, bins))
    assert max(loads.values()) <= max(least, max(sizes)) * 1.1


def test_shards_are_even_gapless_and_keep_equal_texts_together(spark, corpus):
    from grovewise.llm.sharding import shard_documents

    docs = spark.createDataFrame(corpus + ODD + [(900 + i, "copy of one", "en", "a", 1) for i in range(20)], DOCS)
    got = rows_of(shard_documents(docs.withColumn("key", F.lit(1)).withColumn("shard", F.lit(2)), shards=6))
    assert len(got) == len(corpus) + len(ODD) + 20
    by, text = defaultdict(list), {d[0]: d[1] for d in corpus + ODD}
    for r in got:
        by[r["shard"]].append(r)
    for rs in by.values():
        assert sorted(r["slot"] for r in rs) == list(range(len(rs)))
    assert len({r["shard"] for r in got if r["doc_id"] and r["doc_id"] >= 900}) == 1
    assert {r["text_crc32"] for r in got if r["doc_id"] == 1} == {None} and {r["size"] for r in got if r["doc_id"] == 1} == {8}
    total = [sum(r["size"] for r in rs) for rs in by.values()]
    rest = sorted(total)[:-1]  # the 9 kB text has a shard of its own
    assert len(by) == 6 and max(rest) - min(rest) < 0.1 * max(rest)
    few = rows_of(shard_documents(docs, shards=None, capacity=20_000))
    assert max(Counter((r["shard"]) for r in few).values()) > 1 and max(sum(r["size"] for r in few if r["shard"] == s) for s in {r["shard"] for r in few}) <= 20_000
    assert shard_documents(docs.limit(0)).count() == 0
    assert text[7].startswith("xxx")


# ---- exact search and near-duplicate vectors


def test_maxscore_is_exact(spark):
    from grovewise.llm.maxscore import quantised, top_k

    rng = np.random.default_rng(3)
    x = np.concatenate((rng.normal(size=(300, 16)), np.round(rng.normal(size=(60, 16)))))
    x[:, 3:6] *= rng.random((360, 3)) < 0.2
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)] + [(1000, None, 0), (1001, [1.0, float("nan")] + [0.0] * 14, 0), (1002, [None] + [0.0] * 15, 0), (None, [1.0] * 16, 0)]
    # Repeated ids stay, as candidates and as queries; other widths are compared among themselves only.
    rows += [(5, [9.0] * 16, 0)] * 2 + [(20, [-3.0] * 16, 0), (40, [1.0, 2.0], 0), (41, [3.0, 2.0], 0), (60, [], 0)]
    vectors = quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>, width int")).cache()
    assert vectors.count() == 366
    got = rows_of(top_k(vectors.withColumn("width", F.lit(1)).withColumn("shard", F.lit(1)), vectors.where("id % 20 = 0"), k=5, shard_rows=90, query_rows=7))
    all_rows = [(r["id"], np.array(r["v"])) for r in rows_of(vectors)]
    for q in {i for i, _ in all_rows if i % 20 == 0}:
        want = sorted((-(v @ w), i) for k, v in all_rows if k == q for i, w in all_rows if i != q and len(v) == len(w))[:5]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [(i, -s) for s, i in want] == [(i, s) for _, i, s in mine]
    assert Counter(r["vec_id"] for r in got)[5] > 2 and 41 in {r["vec_id"] for r in got if r["query_id"] == 40}
    assert len(rows_of(top_k(vectors.where("id < 3"), vectors.where("id = 0"), k=5))) == 2
    assert top_k(vectors.limit(0), vectors.limit(0)).count() == 0


def test_hadamard_keeps_lengths():
    from grovewise.llm.crosspolytope import hadamard

    x = np.random.default_rng(1).normal(size=(5, 32))
    assert np.allclose(np.linalg.norm(hadamard(x), axis=1), np.sqrt(32) * np.linalg.norm(x, axis=1))


@pytest.mark.parametrize("cell_rows", [2048, 8])
def test_near_vectors_against_brute_force(spark, cell_rows):
    from grovewise.llm.crosspolytope import near_vectors

    rng = np.random.default_rng(2)
    rows, centre = [], rng.normal(size=(12, 20))
    for i in range(150):
        c = centre[i % 12]
        rows.append((i * 2, [float(v) for v in c + rng.normal(size=20) * rng.choice((0.0, 0.1, 0.35, 2.0))], int(i % 3) if i % 7 else None))
    rows += [(1001, None, 1), (1003, [0.0] * 20, 1), (1005, [float("inf")] + [1.0] * 19, 1)]
    got = {r["vec_id"]: r for r in rows_of(near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), cell_rows=cell_rows))}
    parent = {r[0]: r[0] for r in rows}
    n = Counter()

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ok = [r for r in rows if r[2] is not None and r[0] < 1000]
    for k, a in enumerate(ok):
        for b in ok[:k]:
            x, y = np.array(a[1]), np.array(b[1])
            if a[2] == b[2] and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
                n[a[0]] += 1
                n[b[0]] += 1
                p, q = sorted((root(a[0]), root(b[0])))
                parent[q] = p
    assert len(got) == len(rows) and sum(n.values()) > 100
    for r in rows:
        assert (got[r[0]]["n_links"], got[r[0]]["component_id"], got[r[0]]["kept"]) == (n[r[0]], root(r[0]), root(r[0]) == r[0])


def test_near_vectors_of_far_labels_many_widths_and_repeated_ids(spark):
    from grovewise.llm.crosspolytope import near_vectors

    rows = [(1, [1.0, 2.0, 0.0], 0), (2, [1.0, 2.01, 0.0], 2**18), (3, [1.0, 2.0], 0), (4, [1.0, 2.01], 0), (5, [1.0, 2.0, -0.0], 0)]
    rows += [(7, [5.0, 0.0, 1.0], 3), (7, [0.0, 9.0, 1.0], 3), (8, [5.0, 0.0, 1.1], 3), (9, [0.0, 9.0, 1.1], 3), (None, [5.0, 0.0, 1.0], 3)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label long, node int")
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in near_vectors(docs).collect())
    assert got == [(0, 0, None, True), (1, 1, 1, True), (2, 0, 2, True), (3, 1, 3, True), (4, 1, 3, False), (5, 1, 1, False), (7, 1, 7, True), (7, 1, 7, True), (8, 1, 7, False), (9, 1, 7, False)]
    assert near_vectors(docs.limit(0)).count() == 0


def test_near_vectors_in_large_cells(spark):
    from grovewise.llm.crosspolytope import near_vectors

    rng = np.random.default_rng(4)
    x = rng.normal(size=16) + rng.normal(size=(300, 16)) * 0.3
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    got = {r["vec_id"]: r["n_links"] for r in near_vectors(spark.createDataFrame([(i, r.tolist(), "one") for i, r in enumerate(x)], "vec_id long, embedding array<float>, label string"), cell_rows=100).collect()}
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    want = (np.einsum("id,jd->ij", y, y) >= 0.93).sum(axis=1) - 1
    assert 1000 < want.sum() < 300 * 299 and sum(got.values()) > 0.998 * want.sum() and all(got[i] <= want[i] for i in got)


@pytest.mark.parametrize("hubs", (1000, 5))
def test_components_of_a_long_path_and_a_hub(spark, monkeypatch, hubs):
    from grovewise.llm import components
    from grovewise.llm.components import connected_components

    monkeypatch.setattr(components, "HUBS", hubs)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(200, 260)] + [(3, 3)]
    random.Random(1).shuffle(edges)
    got = {r["node"]: r["component"] for r in rows_of(connected_components(spark.createDataFrame(edges, "a long, b long")))}
    assert got == {**{i: 100 for i in range(100, 161)}, 7: 7, **{k: 7 for k in range(200, 260)}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- near-duplicate documents


def brute_sets(text, width):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} - {()}


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_documents_against_brute_force(spark, corpus, width, percent, monkeypatch):
    from grovewise.llm import components
    from grovewise.llm.minhash import distinct_documents, near_documents

    monkeypatch.setattr(components, "HUBS", 5)
    docs = [*corpus, *ODD, *((1000 + i, corpus[3][1], "en", "a", 1) for i in range(80))]
    df = spark.createDataFrame(docs, DOCS)
    got = rows_of(near_documents(df, width, percent))
    sets = [(d[0], brute_sets(d[1], width)) for d in docs if d[0] is not None]
    parent = {i: i for i, _ in sets}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for k, (a, s) in enumerate(sets):
        for b, t in sets[:k]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    assert len(got) == len(docs)
    size = dict(sets)
    for r in got:
        if r["doc_id"] is None:
            assert r["kept"] and r["component_id"] is None
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(size[r["doc_id"]]), root(r["doc_id"]), root(r["doc_id"]) == r["doc_id"])
    assert len({root(i) for i in parent}) < len(parent) - 10
    kept = rows_of(distinct_documents(df, width, percent))
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == sorted({root(i) for i in parent})
    assert near_documents(df.limit(0)).count() == 0


def test_near_documents_of_one_id_with_two_texts(spark, words):
    from grovewise.llm.minhash import distinct_documents, near_documents

    rnd = random.Random(9)
    a, b, c = ([rnd.choice(words) for _ in range(60)] for _ in range(3))
    near = lambda ws: " ".join([*ws[:-1], "changed"])
    rows = [(5, " ".join(a)), (5, " ".join(b)), (5, None), (9, near(a)), (10, near(b)), (12, " ".join(c)), (None, " ".join(c)), (None, " ".join(c)), (13, "")]
    docs = spark.createDataFrame([(x, t, 1, 2) for x, t in rows], "doc_id long, text string, row int, bands int")
    for n in (1, 7):  # whatever the partitions
        got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"], r["kept"]) for r in near_documents(docs.repartition(n)).collect())
        assert got == [(0, 56, None, True), (0, 56, None, True), (5, 0, 5, True), (5, 56, 5, True), (5, 56, 5, True), (9, 56, 5, False), (10, 56, 5, False), (12, 56, 12, True), (13, 0, 13, True)]
        kept = distinct_documents(docs.repartition(n))
        assert kept.columns == docs.columns
        assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([rows[0], rows[1], rows[2], rows[5], rows[8]], key=str)
    assert distinct_documents(docs.limit(0)).count() == 0


def test_large_group_of_near_copies_is_one_component_without_all_pairs(spark, words):
    from grovewise.llm.minhash import near_documents

    rnd = random.Random(3)
    base, docs = [rnd.choice(words) for _ in range(150)], []
    for i in range(300):
        ws = list(base)
        for _ in range(rnd.choice((2, 3, 5))):
            ws[rnd.randrange(150)] = rnd.choice(words)
        docs.append((i, " ".join(ws)))
    got = rows_of(near_documents(spark.createDataFrame(docs, "doc_id long, text string"), 3, 85, cell_rows=64))
    sets = [brute_sets(t, 3) for _, t in docs]
    seen, todo = {0}, [0]
    while todo:
        a = todo.pop()
        for b in range(300):
            if b not in seen and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                seen.add(b)
                todo.append(b)
    assert {r["doc_id"] for r in got if r["component_id"] == 0} == seen and len(seen) > 150


@given(st.lists(st.text(alphabet="aAbB é\t\n\x0b .", max_size=40), max_size=8))
@settings(max_examples=60, deadline=None)
def test_shingles_equal_plain_sets(texts):
    from grovewise.llm.shingles import shared, shingles_of

    found = shingles_of(pa.array(texts, pa.string()), 2)
    plain = [brute_sets(t, 2) for t in texts]
    assert [len(f) for f in found] == [len(p) for p in plain]
    for a, x in zip(found, plain, strict=True):
        for b, y in zip(found, plain, strict=True):
            assert shared(a, b) == len(x & y)


# ---- tokens, packing


TEXT = st.text(alphabet=st.sampled_from("aZé'sdt 12²\n\t\xa0\x1c.,!|<>漢🙂Σİ€́_-"), max_size=80)


@given(st.lists(TEXT, max_size=5), st.integers(4, 40), st.integers(1, 8))
@settings(max_examples=80, deadline=None)
def test_token_counts_and_ids_equal_the_library(texts, chunk, overlap):
    from tokenizers import Tokenizer

    from grovewise.llm.tokens import byte_tokens, count_spliced, vocabulary_path, word_tokens

    texts = [*texts, *(t + "<|endoftext|>" + t for t in texts[:1])]
    path = vocabulary_path("byte_bpe_50k.json")
    tokens, library = byte_tokens(path), _library(path, Tokenizer)
    for t in texts:
        want = library.encode(t, add_special_tokens=False).ids
        assert tokens.ids(t) == want and count_spliced(tokens, t, chunk, overlap) == len(want)
    path = vocabulary_path("word_bpe_49k.json")
    library = _library(path, Tokenizer)
    ids, cuts = word_tokens(path).ids(texts)
    assert [ids[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:], strict=True)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


_LIBRARIES = {}


def _library(path, kind):
    return _LIBRARIES.setdefault(path, kind.from_file(path))


def test_count_tokens_of_odd_rows(spark):
    from grovewise.llm.tokencount import count_tokens
    from grovewise.llm.tokens import vocabulary_path

    long = "word " * 40_000 + "z" * 100_000 + " end"
    docs = spark.createDataFrame([*ODD, (9, long, "en", "a", 1)], DOCS)
    got = rows_of(count_tokens(docs, vocabulary_path("byte_bpe_50k.json"), chunk=20_000, overlap=64))
    from tokenizers import Tokenizer

    want = len(_library(vocabulary_path("byte_bpe_50k.json"), Tokenizer).encode(long).ids)
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(ODD) + 1 and by[9]["n_tokens"] == want and by[9]["over_limit"]
    assert by[1]["n_tokens"] == 0 and by[1]["n_bytes"] == 0 and by[2]["n_tokens"] == 0
    assert count_tokens(docs.limit(0), vocabulary_path("byte_bpe_50k.json")).count() == 0


def test_packing_covers_every_id_once(spark, corpus):
    from tokenizers import Tokenizer

    from grovewise.llm.packing import pack_documents
    from grovewise.llm.tokens import vocabulary_path

    path = vocabulary_path("word_bpe_49k.json")
    docs = [*corpus, *ODD]
    got = rows_of(pack_documents(spark.createDataFrame(docs, DOCS), path, capacity=256))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for doc, text, *_ in docs:
        ids = np.array([*_library(path, Tokenizer).encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        pieces = sorted(by_doc[doc], key=lambda r: r["start"])
        copies = sum(d[0] == doc for d in docs)
        assert sum(p["length"] for p in pieces) == copies * len(ids)
        for p in pieces:
            part = ids[p["start"] : p["start"] + p["length"]]
            assert zlib.crc32(part.tobytes()) == p["ids_crc32"] and p["doc_tokens"] == len(ids)
    for rs in by_sequence.values():
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 256
    total = sum(r["length"] for r in got)
    assert len(by_sequence) * 256 < 1.1 * total + 256
    assert pack_documents(spark.createDataFrame([], DOCS), path).count() == 0


@given(st.lists(st.integers(1, 16), max_size=40))
@settings(max_examples=60, deadline=None)
def test_assignment_takes_the_cheapest_sequence_with_room(lengths):
    from grovewise.llm.packing import assign

    lengths = np.array(sorted(lengths, reverse=True), dtype=np.int64)
    sequence, offset = assign(lengths, 16, 1.0, 0.125)
    n = max(1, -(-int(lengths.sum()) // 16))
    load, cost = [0] * n, [0.0] * n
    for size, s, at in zip(lengths.tolist(), sequence.tolist(), offset.tolist(), strict=True):
        fits = [(cost[k], k) for k in range(len(load)) if load[k] + size <= 16]
        want = min(fits)[1] if fits else len(load)
        if not fits:
            load.append(0)
            cost.append(0.0)
        assert (s, at) == (want, load[want])
        load[want] += size
        cost[want] += size + 0.125 * size * size


@given(st.lists(st.text(alphabet="ab \n", max_size=30), max_size=6), st.integers(1, 9))
@settings(max_examples=60, deadline=None)
def test_words_dont_depend_on_blocks(texts, block):
    from grovewise.llm import shingles

    whole, size = shingles.words_of(pa.array(texts, pa.string())), shingles.BLOCK
    try:
        shingles.BLOCK = block
        parts = shingles.words_of(pa.array(texts, pa.string()))
    finally:
        shingles.BLOCK = size
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))


# ---- language model


@pytest.mark.parametrize("order", (2, 3))
def test_kneser_ney_against_brute_force(spark, corpus, order):
    from grovewise.llm.kneserney import discounts, language_model_scores

    docs = [*corpus, *ODD]
    got = rows_of(language_model_scores(spark.createDataFrame(docs, DOCS), order=order))
    tok = lambda t: [*(t or "").encode().lower().split(), "END"]
    learn = [tok(d[1]) for d in docs if d[0] is not None and zlib.crc32(str(d[0]).encode()) % 7 != 2]
    c = Counter(w for ws in learn for w in ws)
    raw = Counter(p for ws in learn for p in zip(["START", *ws[:-1]], ws, strict=True))
    triples = Counter(p for ws in learn for p in zip(["START", *ws], ws, ws[1:], strict=False))
    # In a model of order 3 a bigram's count is how many words come before it; those that start a text keep theirs.
    after = Counter((v, w) for _, v, w in triples)
    pairs = raw if order == 2 else Counter({**after, **{(u, w): n for (u, w), n in raw.items() if u == "START"}})
    n, v = sum(c.values()), len(c)
    times, before, times3 = Counter(pairs.values()), Counter(w for _, w in pairs), Counter(triples.values())
    d2, d1 = discounts([times[k] for k in (1, 2, 3, 4)]), discounts([Counter(before.values())[k] for k in (1, 2, 3, 4)])
    d3 = discounts([times3[k] for k in (1, 2, 3, 4)])
    follow, follow3 = defaultdict(Counter), defaultdict(Counter)
    for (u, w), k in pairs.items():
        follow[u][w] = k
    for (t, u, w), k in triples.items():
        follow3[t, u][w] = k
    cut = lambda d, k: d[min(k, 3) - 1] if k else 0.0
    spare = sum(cut(d1, k) for k in before.values()) / len(pairs)
    low = lambda w: max(before[w] - cut(d1, before[w]), 0) / len(pairs) + spare / (v + 1)

    def mixed(f, d, w, rest):
        return max(f[w] - cut(d, f[w]), 0) / sum(f.values()) + sum(cut(d, k) for k in f.values()) / sum(f.values()) * rest if f else rest

    def p(t, u, w):
        two = mixed(follow.get(u), d2, w, low(w))
        return mixed(follow3.get((t, u)), d3, w, two) if order == 3 and t is not None else two

    assert abs(sum(p(None, "START", w) for w in c) + p(None, "START", "unknown") - 1) < 1e-9
    first = learn[0]
    assert abs(sum(p("START", first[0], w) for w in c) + p("START", first[0], "unknown") - 1) < 1e-9
    want = {d[0]: tok(d[1]) for d in docs}
    assert len(got) == len(docs)
    for r in got:
        ws = want[r["doc_id"]]
        assert r["n_tokens"] == len(ws) and r["n_known"] == sum(c[w] > 0 for w in ws) and r["train_tokens"] == n
        assert abs(r["base_score"] - sum(log10((c[w] + 1) / (n + v + 1)) for w in ws)) < 1e-6 * max(1, len(ws))
        assert abs(r["score"] - sum(log10(p(t, u, w)) for t, u, w in zip([None, "START", *ws], ["START", *ws], ws, strict=False))) < 1e-6 * max(1, len(ws))


def test_frequent_first_words_are_split_over_parts(spark, corpus):
    from grovewise.llm.kneserney import score_documents, train

    docs = spark.createDataFrame(corpus, DOCS)
    whole, parts = train(docs, 3), train(docs, 3, part_words=64)
    assert parts.parts > 50 and parts.trigram_parts > 50 and len(parts.hot) > 3
    a = {r["doc_id"]: r["score"] for r in rows_of(score_documents(docs, whole))}
    b = {r["doc_id"]: r["score"] for r in rows_of(score_documents(docs, parts))}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 * abs(a[k]) for k in a)
    empty = train(docs.limit(0))
    assert all(np.isfinite(r["score"]) for r in rows_of(score_documents(docs.limit(3), empty)))


# ---- mixing


def test_targets_stop_at_the_limit_and_share_the_rest(spark):
    from grovewise.llm.mixing import targets

    sizes = {"a": 10, "b": 1000, "c": 50, None: 400, "d": 0}
    got = {r["source"]: r for r in rows_of(targets(spark.createDataFrame(list(sizes.items()), "source string, size long")))}
    order = sorted(k for k in sizes if k is not None) + [None]
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(order)}
    want, open_, left = {}, set(order), float(sum(sizes.values()))
    while True:
        share = {k: left * weight[k] / sum(weight[j] for j in open_) for k in open_}
        over = {k for k in open_ if share[k] > 3 * sizes[k]}
        if not over:
            want |= share
            break
        for k in over:
            want[k] = 3.0 * sizes[k]
            left -= want[k]
        open_ -= over
    for k in order:
        assert got[k]["weight"] == weight[k] and abs(got[k]["target"] - want[k]) < 1e-6


def test_mix_comes_near_its_targets_and_repeats(spark, corpus):
    from grovewise.llm.mixing import mix_sources, mixed_documents

    docs = spark.createDataFrame(corpus + ODD, DOCS).withColumn("size", F.lit("clash")).withColumn("block", F.lit(0))
    mix = mix_sources(docs, block_words=16)
    got = rows_of(mix.documents)
    assert len(got) == len(corpus) + len(ODD)
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
    for s in rows_of(mix.sources):
        taken = sum(r["taken"] for r in got if r["source_no"] == s["source_no"])
        assert abs(taken - s["target"]) <= 16 + 0.02 * s["target"]
        slots = rows_of(mix.slots.where(F.col("source_no") == s["source_no"]))
        uses = Counter(r["block"] for r in slots)
        assert len(slots) == s["n_slots"] and (not uses or max(uses.values()) - (min(uses.values()) if len(uses) == s["blocks"] else 0) <= 1)
    again = rows_of(mix_sources(docs.repartition(7), block_words=16).documents)
    key = lambda r: (str(r["doc_id"]), r["size"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert mixed_documents(docs).columns == docs.columns
    empty = mix_sources(docs.limit(0))
    assert empty.documents.count() == 0 and empty.slots.count() == 0


def _hash(seed, *values):
    """Spark's xxhash64 of longs and ints (given as (value,))."""
    for v in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<i", v[0]) if isinstance(v, tuple) else struct.pack("<q", v), seed=seed)
    return seed - 2**64 if seed >= 2**63 else seed


@pytest.mark.parametrize("words", (300, 900))
def test_slots_are_multinomial_draws_corrected_to_their_totals(spark, words):
    from grovewise.llm.mixing import mix_sources

    docs = spark.range(20).selectExpr("id AS doc_id", f"repeat('w ', {words} + 13 * int(id)) AS text", "'en' AS lang", "concat('s', id) AS source", "0L AS n_chars")
    mix = mix_sources(docs, block_words=1, shard_slots=256, seed=42)
    slots = sorted((r["shard"], r["slot"], r["drawn"], r["source_no"], r["k"]) for r in mix.slots.collect())
    n = len(slots)
    assert [(a, b) for a, b, *_ in slots] == [(i // 256, i % 256) for i in range(n)]
    asked = {r["source_no"]: r["n_slots"] for r in mix.sources.collect()}
    assert n == sum(asked.values())
    # Draws, one by one: the source in whose share the slot's hash falls.
    ends, at = [], 0
    for s in sorted(asked):
        at += asked[s]
        ends.append((at, s))
    for shard, slot, drawn, _, _ in slots[:: max(1, n // 300)]:
        u = _hash(42, shard, slot, (44,)) % n
        assert drawn == next(s for end, s in ends if u < end)
    # Counts of shards have the multinomial variance, far more evenly drawn ones would not.
    full = n // 256
    got = Counter((a, s) for a, _, s, _, _ in slots if a < full)
    ratio = sum((got[a, s] - 256 * m / n) ** 2 / (256 * m / n * (1 - m / n)) for a in range(full) for s, m in asked.items()) / (full * len(asked))
    assert 0.8 < ratio < 1.25
    # Totals are as asked for, every number once, and few slots were corrected: about the root of their number.
    for s, m in asked.items():
        assert sorted(k for *_, x, k in slots if x == s) == list(range(m))
    assert sum(d != s for _, _, d, s, _ in slots) < 2 * len(asked) * n**0.5


def test_words_taken_are_those_of_the_blocks_that_slots_read(spark, corpus):
    from grovewise.llm.mixing import PRIMES, mix_sources

    docs = spark.createDataFrame(corpus + ODD, DOCS)
    mix = mix_sources(docs, block_words=16, shard_slots=32)
    got, taken = rows_of(mix.documents), Counter()
    source = {r["source_no"]: r for r in rows_of(mix.sources)}
    stream, first = defaultdict(list), {}
    for r in sorted(rows_of(mix.documents), key=lambda r: (r["source_no"], r["start"])):
        assert r["start"] == len(stream[r["source_no"]]) or not r["size"]
        stream[r["source_no"]] += [(r["doc_id"], r["source_no"], r["start"])] * r["size"]
    for r in rows_of(mix.slots):
        s, no = source[r["source_no"]], r["source_no"]
        prime, n = PRIMES[_hash(42, (no,), (42,)) % 4], s["blocks"]
        assert r["block"] == (prime % n * (r["k"] % n) + _hash(42, (no,), (43,)) % n) % n
        for word in stream[no][16 * r["block"] : 16 * r["block"] + 16]:
            taken[word] += 1
            first[word] = min(first.get(word, r["shard"]), r["shard"])
    for r in got:
        key = (r["doc_id"], r["source_no"], r["start"])
        assert r["taken"] == (taken[key] if r["size"] else 0) and r["first_shard"] == (first.get(key) if r["size"] else None)


def test_mixing_stage_keeps_null_ids_and_columns_of_any_name(spark, corpus):
    from grovewise.llm.mixing import mixed_documents

    rows = [(*d, 7, 8, 9) for d in corpus] + [(None, "nobody knows this id " * 9, "en", "a", 1, 7, 8, 9)] * 2 + [(3, "another text of id three " * 9, "en", "a", 1, 7, 8, 9)]
    docs = spark.createDataFrame(rows, DOCS + ", _n int, _taken int, size int")
    got = rows_of(mixed_documents(docs, weights=(1.0,), block_words=4, limit=3))
    assert got and all((r["_n"], r["_taken"], r["size"]) == (7, 8, 9) for r in got)
    assert {r["text"] for r in got} <= {d[1] for d in rows} and any(r["doc_id"] is None for r in got)
    n = Counter(r["doc_id"] for r in got)
    assert n[None] % 2 == 0 and max(Counter((r["doc_id"], r["text"]) for r in got if r["doc_id"] is not None).values()) <= 4
    assert mixed_documents(docs.limit(0)).columns == docs.columns and mixed_documents(docs.limit(0)).count() == 0


def test_pipeline_stages_on_odd_tables(spark, corpus, tmp_path):
    """Null ids, null and empty texts, repeated rows, unusual columns and empty tables pass every stage."""
    import corpus_pipeline

    extra = "_n int, key string, row long, `a.b` int, taken int, signature string"
    rows = [(*d, 1, "k", 2, 3, 4, "s") for d in corpus + ODD]
    docs = spark.createDataFrame(rows, f"{DOCS}, {extra}")
    labels = spark.createDataFrame([(d[0], i % 7 and 1, int(i % 9 == 0)) for i, d in enumerate(corpus)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    key = lambda r: str((r["doc_id"], r["text"]))
    given = {key(r) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, docs, str(tmp_path)).collect()
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        if name == "packing":
            assert {r["doc_id"] for r in kept} == {r["doc_id"] for r in docs.collect()} and sum(r["doc_id"] == 5 for r in kept) == 2
            continue
        assert {key(r) for r in kept} <= given and all((r["_n"], r["key"], r["a.b"]) == (1, "k", 3) for r in kept)
        ids = Counter(r["doc_id"] for r in kept)
        assert ids[None] == 1 or name in ("quality", "toxicity", "mixing")
        if name == "near_duplicates":
            assert ids[1] == ids[2] == ids[4] == ids[7] == 1 and ids[5] == 1
        if name == "mixing":
            assert ids[1] == ids[2] == ids[4] == 0 and ids[5] in (0, 2, 4, 6, 8)


def test_pipeline_stages_keep_columns_and_take_effect(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = corpus_pipeline.stored(stage(spark, docs, d), name)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count()
        assert out.join(docs, docs.columns, "left_anti").count() == 0
        docs = out
    assert docs.count() < n
    mixed = corpus_pipeline.stored(corpus_pipeline.mixing_stage(spark, docs, d), "mixed")
    assert mixed.columns == docs.columns and mixed.count() > 0
    packed = corpus_pipeline.packing_stage(spark, mixed, d)
    assert packed.count() >= mixed.count()
