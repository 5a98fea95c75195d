"""Tests of values, constructed trees, functions by name, rules of blocks, and type resolution."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from grovewise.functions import registry, values
from grovewise.operators import axes, construct, rules, snapshots, temporal
from grovewise.operators.axes import attr, each
from grovewise.sources import documents
from grovewise.sources.forest import FIELDS, NODE


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def forest(spark, *rows):
    """Nodes of documents of depth two from (doc, id, parent, name, attrs)."""
    parents = {i: p for _, i, p, *_ in rows}

    def path(i):
        return [*(path(parents[i]) if parents[i] else []), i]

    data = [(d, i, p, path(i), [n] * len(path(i)), n, "element", name, attrs, attrs.get("v")) for n, (d, i, p, name, attrs) in enumerate(rows)]
    return spark.createDataFrame(data, NODE)


def test_general_comparison_equals_all_pairs(spark):
    sets, coerced = ([], ["a"], ["b", "a"], ["c", "d"]), ([], [1.0], [2.0, 7.0])
    ops = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
    rows = [(a, b) for a in sets for b in sets]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    for op, holds in ops.items():
        for r in df.select("a", "b", values.general_comparison(F.col("a"), op, F.col("b")).alias("x")).collect():
            assert r.x == any(holds(x, y) for x in r.a for y in r.b), (op, r)
    texts = (["7"], ["x"], ["1", "x"], [])
    nan = float("nan")
    number = lambda t: float(t) if t != "x" else nan
    df = spark.createDataFrame([(a, b) for a in coerced for b in texts], "a array<double>, b array<string>")
    for op, holds in ops.items():
        for r in df.select("a", "b", values.general_comparison(F.col("a"), op, F.col("b"), numeric=True).alias("x")).collect():
            assert r.x == any(holds(x, number(y)) for x in r.a for y in r.b), (op, r)
    with pytest.raises(ValueError, match="unknown comparison"):
        values.general_comparison(F.col("a"), "==", F.col("b"))


def test_general_comparison_of_relations(spark):
    bound = spark.createDataFrame([(i,) for i in range(4)], "id int")
    left = spark.createDataFrame([(0, 5), (0, 6), (1, 5), (2, 5)], "id int, v int")
    right = spark.createDataFrame([(0, 6), (1, 5), (3, 5)], "id int, v int")
    got = {op: sorted(r.id for r in axes.general(bound, left, right, "id", "v", op).collect()) for op in values.OPERATORS}
    assert got == {"=": [0, 1], "!=": [0], "<": [0], "<=": [0, 1], ">": [], ">=": [0, 1]}


def test_truth_of_sequences(spark):
    rows = [("node", None, 3, True), (None, None, 0, False), ("boolean", "false", 1, False), ("string", "", 1, False), ("string", "x", 1, True), ("number", "0", 1, False), ("number", "NaN", 1, False), ("number", "-2", 1, True)]
    df = spark.createDataFrame(rows, "k string, v string, n int, want boolean")
    assert all(r.want == r.got for r in df.withColumn("got", values.effective_boolean(F.col("k"), F.col("v"), F.col("n"))).collect())
    with pytest.raises(Exception, match="FORG0006"):
        one(spark, values.effective_boolean(F.lit("string"), F.lit("x"), F.lit(2)))


def test_casts_names_and_acronyms(spark):
    got = one(spark, values.cast_as(F.lit(" 12 "), "xs:integer").alias("i"), values.castable(F.lit("1.5"), "xs:integer").alias("c"), values.cast_as(F.lit("2024-01-02T03:04:05"), "xs:dateTime").cast("string").alias("t"), values.castable(F.lit("2024-02-31"), "xs:date").alias("d"), values.cast_as(F.lit(None).cast("string"), "xs:double").alias("n"))
    assert (got.i, got.c, got.t, got.d, got.n) == (12, False, "2024-01-02 03:04:05", False, None)
    with pytest.raises(Exception, match="FORG0001"):
        one(spark, values.cast_as(F.lit("x"), "xs:integer"))
    with pytest.raises(ValueError, match="unknown type"):
        values.constructor("xs:nothing")
    prefixes = F.create_map(F.lit("a"), F.lit("urn:a"))
    assert tuple(one(spark, values.expanded_name(F.lit("a:b"), prefixes).alias("x")).x) == ("urn:a", "b")
    with pytest.raises(Exception, match="XPST0081"):
        one(spark, values.expanded_name(F.lit("z:b"), prefixes))
    for name, want in (("java to uml", "jtu"), ("camelCaseName", "ccn"), ("ManyCapitalLettersHereToo", "mclh"), ("lower", "low"), ("x", "x"), ("9-lives_of.cats", "loc"), ("42nd", "nd")):
        assert one(spark, values.acronym(F.lit(name)).alias("x")).x == want, name


def test_functions_check_their_arguments(spark):
    fn = registry.builtin()
    assert one(spark, fn.call("string-length", context=F.lit("abc")).alias("x")).x == 3
    assert one(spark, fn.call("index-of", F.array(*map(F.lit, "aba")), F.lit("a")).alias("x")).x == [1, 3]
    assert one(spark, fn.call("string-join", F.array(*map(F.lit, "abc")), F.lit("-")).alias("x")).x == "a-b-c"
    for call, error in ((lambda: fn.call("nothing"), "XPST0017"), (lambda: fn.call("count"), "takes 1"), (lambda: fn.define("count", [], F.size), "defined already")):
        with pytest.raises(ValueError, match=error):
            call()
    with pytest.raises(Exception, match="not a number"):
        one(spark, fn.call("subsequence", F.array(F.lit("a")), F.lit("x"), F.lit("1")))
    fn.define("repeat", [registry.Param("string"), registry.Param("item", "optional")], lambda s, n: s if n is None else F.concat(s, s))
    assert fn.bound_names({"f": frozenset({"a"}), "g": None}, ["f"]) == {"a"} and fn.bound_names({"g": None}, ["g"]) is None


def test_constructed_trees(spark):
    f = forest(spark, ("d", "a", None, "a", {"k": "1"}), ("d", "b", "a", "b", {"v": "text"}))
    E, A, T = construct.Element, construct.Attribute, construct.Text
    tree = E("page", A("x", (F.lit("p"), F.lit(None).cast("string"), F.lit("q"))), A("none", (F.lit(None).cast("string"),)), T((F.lit("one"), F.lit(2))), E("inner", T((F.lit("t"),))), construct.Copy("n"), T((F.lit("!"),)))
    got = {r["id"]: r for r in construct.constructed(each(f, "n", "a"), F.lit("k"), F.lit("new"), tree, f).collect()}
    assert {i: (r["name"], r["parent_id"], r["value"]) for i, r in got.items()} == {"k": ("page", None, "one 2!"), "k.0": ("inner", "k", "t"), "k.1.a": ("a", "k", None), "k.1.b": ("b", "k.1.a", "text")}
    assert got["k"]["attrs"] == {"x": "p q"} and got["k.1.b"]["path"] == ["k", "k.1.a", "k.1.b"] and got["k.1.b"]["attrs"] == {"v": "text"} and len(got["k.1.b"]["pos"]) == 3
    assert construct.constructed(each(f, "n", "zzz"), F.lit("k"), F.lit("new"), tree, f).count() == 0
    with pytest.raises(ValueError, match="XQDY0025"):
        E("e", A("x", ()), A("x", ()))
    with pytest.raises(ValueError, match="XQTY0024"):
        E("e", T(()), A("x", ()))
    page = construct.direct("<a b='{n}-{n}'>is {n}<c/>, ok</a>", {"n": F.lit(7)})
    got = sorted(tuple(r[c] for c in ("id", "name", "value")) for r in construct.constructed(spark.range(1), F.lit("k"), F.lit("d"), page).collect())
    assert got == [("k", "a", "is 7, ok"), ("k.0", "c", None)]
    assert sorted(map(tuple, construct.atomised(f).collect())) == [("a", ""), ("b", "text")]


def counted_rules():
    """Two stages: a note for each item in the page of its kind, and a tag under each note."""
    items = rules.For("x", "item")
    page = rules.For("p", "page", lambda b, found: b.join(found, attr("x", "kind") == attr("p", "kind")), target=True)
    note = lambda b: rules.inserted(b, rules.binding_key("note", F.col("x.id"), F.col("p.id")), [F.col("x.id"), F.col("p.id")], [F.col("x.doc"), F.col("p.doc")], F.col("p.id"), "note", value=attr("x", "v"))
    tag = lambda b: rules.inserted(b, rules.binding_key("tag", F.col("n.id")), [F.col("n.id")], [F.col("n.doc")], F.col("n.id"), "tag", value=F.upper("n.value"))
    return [rules.rule("tag", [rules.For("n", "note")], tag), rules.rule("note", [items, page], note)]


def world(spark, items):
    rows = [(f"pages-{k}", f"p{k}", None, "page", {"kind": k}) for k in "ab"] + [(f"doc-{i}", i, None, "item", {"kind": k, "v": v}) for i, (k, v) in items.items()]
    return forest(spark, *rows)


def out(state):
    return sorted((r["name"], r["value"], r["doc"], r["id"]) for r in state.nodes.where("name in ('note', 'tag')").collect())


@pytest.mark.parametrize("after", ({"i1": ("a", "x"), "i2": ("b", "changed"), "i4": ("a", "new")}, {}, {"i1": ("b", "x"), "i2": ("b", "y"), "i3": ("a", "z")}))
def test_updates_by_difference_equal_a_run_from_scratch(spark, after):
    before = {"i1": ("a", "x"), "i2": ("b", "y"), "i3": ("a", "z")}
    both = counted_rules()
    state = rules.run(rules.start(world(spark, before)), both)
    assert len(out(state)) == 6
    new = world(spark, after)
    gone = [i for i in before if after.get(i) != before[i]]
    came = [i for i in after if before.get(i) != after[i]]
    state = rules.update(state, both, spark.createDataFrame([(i,) for i in gone], "id string"), new.where(F.col("id").isin(came)))
    assert out(state) == out(rules.run(rules.start(new), both))
    assert state.mods.count() == 2 * len(after)


def test_only_what_rests_on_changed_documents_is_verified(spark):
    both = counted_rules()
    items = {f"i{k}": ("ab"[k % 2], f"v{k}") for k in range(8)}
    state = rules.run(rules.start(world(spark, items)), both)
    none = spark.createDataFrame([], "id string")
    # A new item touches its own document only, on which nothing rests; its note changes one page.
    state = rules.update(state, both, none, forest(spark, ("doc-n", "n", None, "item", {"kind": "a", "v": "n"})))
    assert state.counts["verified"] == 0 and state.counts["resolved"] == 18
    docs = spark.createDataFrame([("doc-i0",)], "doc string")
    assert rules.delta(both[1], state.nodes, docs).count() == 1 and rules.delta(both[1], state.nodes, docs, frozenset({"page"})).count() == 0


def test_rules_are_known_by_the_code_of_their_stages(spark):
    one_, two = counted_rules(), counted_rules()
    assert [rules.first_difference(a, b) for a, b in zip(one_, two, strict=True)] == [None, None]
    assert one_[1].reads == {"item", "page"} and rules.nearest_target(one_[1].blocks) == "p"
    other = rules.rule("note", [one_[1].blocks[0], rules.For("p", "page", lambda b, found: b.join(found, attr("x", "kind") != attr("p", "kind")), target=True)], one_[1].output)
    longer = rules.rule("note", one_[1].blocks, lambda b: one_[1].output(b).limit(1))
    assert rules.first_difference(one_[1], other) == 1 and rules.first_difference(one_[1], longer) == 2
    state = rules.run(rules.start(world(spark, {"i1": ("a", "x")})), one_)
    state = rules.run(rules.changed_rules(state, one_, [one_[0], other]), [one_[0], other])
    assert [(n, v, d) for n, v, d, _ in out(state)] == [("note", "x", "pages-b"), ("tag", "X", "pages-b")]
    with pytest.raises(ValueError, match="target"):
        rules.nearest_target(one_[0].blocks)
    with pytest.raises(ValueError, match="first block"):
        rules.rule("bad", [rules.For("a", "item"), rules.For("b", "item")], one_[0].output).bindings(state.nodes)


def test_undo_redo_vanished_gate_revert_and_ids(spark):
    both = counted_rules()
    state = rules.run(rules.start(world(spark, {"i1": ("a", "x")})), both)
    want = out(state)
    action = forest(spark, ("doc-act", "act", None, "item", {"kind": "b", "v": "w"}))
    state = rules.toggled(state, both, action, True)
    done = out(state)
    assert len(done) == 4
    state = rules.toggled(state, both, action, False)
    assert out(state) == want
    assert out(rules.toggled(state, both, action, True)) == done
    state.nodes = state.nodes.where("doc <> 'doc-i1'")
    assert out(rules.vanished(state)) == [x for x in done if "w" in x[1].lower()]
    assert rules.gated(state, action, "2", "1")[1] and rules.gated(state, action, "1", None)[1] and rules.gated(state, action, "1", "1") == (state, False)
    bad = rules.rule("bad", [rules.For("x", "item", lambda _, found: found.where("no_such_column"))], both[0].output)
    kept, good = rules.run_or_revert(world(spark, {"i1": ("a", "x")}), [bad], both)
    assert out(kept) == want and not good and rules.run_or_revert(world(spark, {}), both, [])[1]
    short = lambda d: "".join(w[0] for w in d.split())
    before = {"r-ab": ("alpha beta", ("old name",)), "r-x": ("same", ()), "r-y": ("same", ())}
    assert rules.assigned_ids([("new name", ("alpha beta",)), ("old name", ()), ("same", ()), ("any body", ())], before, short) == ["r-ab", "r-ab", "r-s", "r-ab-2"]


def test_serials_and_single_roots(spark):
    rows = spark.createDataFrame([("k", 2), ("k", 1), ("m", 5)], "parent string, o int")
    assert sorted((r.key, r.o) for r in rules.serial_ids(rows, "parent", "o").collect()) == [("k-1.", 1), ("k-2.", 2), ("m.", 5)]
    assert rules.single_roots(spark.createDataFrame([("a",), ("b",)], "doc string")).count() == 2
    with pytest.raises(Exception, match="more than one root"):
        rules.single_roots(spark.createDataFrame([("a",), ("a",)], "doc string")).collect()


@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 12), st.integers(0, 12), st.booleans()), min_size=1, max_size=9))
@settings(max_examples=12, deadline=None)
def test_mediation_equals_its_definition(spark, drawn):
    at = lambda n: f"2024-01-01 {n:02d}:30:00"
    ranges = [(1, p, min(a, b), max(a, b), i) for p, a, b, i in drawn if a != b]
    df = spark.createDataFrame([(s, p, at(a), at(b), i) for s, p, a, b, i in ranges], "s int, p int, f string, t string, interesting boolean")
    df = df.select("s", "p", F.to_timestamp_ntz("f").alias("from_ts"), F.to_timestamp_ntz("t").alias("to_ts"), "interesting")
    got = temporal.mediate(df, ["s"], "p", F.to_timestamp_ntz(F.lit(at(2))), F.to_timestamp_ntz(F.lit(at(11)))).collect()
    clipped = [(max(a, 2), min(b, 11)) for _, _, a, b, i in ranges if i and max(a, 2) < min(b, 11)]
    bounds = {(a, True) for _, _, a, _, _ in ranges} | {(b, False) for _, _, _, b, _ in ranges}
    marks = {(b, low) for b, low in bounds for x, y in clipped if (x <= b < y if low else x < b <= y)} | {(x, True) for x, _ in clipped} | {(y, False) for _, y in clipped}
    held = lambda b, low, a, z: a <= b < z if low else a < b <= z
    everyone = {p for _, p, *_ in ranges}
    agreed = [b for b, low in marks if {p for _, p, a, z, _ in ranges if held(b, low, a, z)} == everyone]
    assert [str(r.checkpoint) for r in got] == ([at(min(agreed))] if agreed else [])


def test_code_and_type_resolution(spark):
    code = """package p.q; import java.util.List; import r.*;
    /* class Not { } */ public class A<T> extends Base implements I, J<K> {
      private int[] x = {1, 2}; static { int y; }
      @Ann("}") public A(final String s, int... n) throws E1, r.E2 { String t = "class Z {"; }
      <X> List<Map<String, X>> f(Map<K, V> m, B b[]) { for (;;) { g(); } }
      class B { void g(); }
      enum C { ONE, TWO; C next() { return null; } }
    }"""
    got = documents.code_members(spark.createDataFrame([("A.java", code), ("none", None)], "doc string, text string")).collect()
    seen = {(r["kind"], r["type"], r["name"]): r for r in got}
    assert {("import", "", "java.util.List"), ("import", "", "r.*"), ("class", "A", "A"), ("field", "A", "x"), ("constructor", "A", "A"), ("method", "A", "f"), ("class", "A$B", "B"), ("method", "A$B", "g"), ("enum", "A$C", "C"), ("method", "A$C", "next")} == set(seen)
    assert seen["class", "A", "A"]["extends"] == ["Base", "I", "J"] and seen["constructor", "A", "A"]["throws"] == ["E1", "r.E2"]
    assert seen["field", "A", "x"]["returns"] == "int[]" and seen["method", "A", "f"]["returns"] == "List" and seen["method", "A", "f"]["params"] == ["Map", "B[]"]
    types = spark.createDataFrame([(x, x.replace("$", ".")) for x in ("p.q.A", "p.q.A$B", "p.q.D", "r.D", "r.E", "s.E", "u.v.W", "u.v.W$X", "dup.D", "dup.D")], "impl string, full string")
    imports = spark.createDataFrame([("f", "r.*"), ("f", "s.*"), ("f", "java.util.List"), ("f", "x.D")], "doc string, name string")
    refs = [("int", "primitive", "int", "resolved"), ("A", "defined", "p.q.A", "resolved"), ("B", "member", "p.q.A.B", "resolved"), ("D", "import", None, "unresolved"), ("E", "packages", None, "ambiguous"), ("A.B", "defined", "p.q.A.B", "resolved"), ("u.v.W.X", "path", "u.v.W.X", "resolved"), ("zz", None, None, "unresolved"), ("dup.D", "path", None, "ambiguous")]
    df = spark.createDataFrame([(n, "f", n, "p.q", ["p.q.A"]) for n, *_ in refs], "ref_id string, doc string, name string, package string, enclosing array<string>")
    got = {r.ref_id: (r.scope, r.target, r.status) for r in snapshots.resolve_types(df, types, imports).collect()}
    assert got == {n: (scope, target, status) for n, scope, target, status in refs}


def test_revision_logs_and_globs(spark, tmp_path):
    entry = "\nRCS file: /a/b.txt,v\nWorking file: b.txt\n----------------------------\nrevision 1.2\ndate: 2024/01/02 03:04:05;  author: ann;  state: Exp;  commitid: c9;\nfirst\r\nline\r\n----------------------------\nrevision 1.1\ndate: bad;  author: ann;\nx\n"
    got = documents.revision_log(spark.createDataFrame([(entry,), ("nothing",)], "value string")).collect()
    assert [(r["file"], r["name"], r["author"], str(r["date"]), r["commit_id"], r["message"]) for r in got] == [("/a/b.txt", "1.2", "ann", "2024-01-02 03:04:05", "c9", "first\nline")]
    for name in ("x/a.txt", "x/CVS/Entries", "x/.svn/deep/e", "x/a.txt~"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("t")
    assert sorted(r["doc"] for r in documents.load_files(spark, str(tmp_path)).collect()) == ["x/a.txt"]
    assert len(documents.load_files(spark, str(tmp_path), default_excludes=False).collect()) == 3  # Spark's readers leave out what begins with a dot
    assert set(FIELDS) >= {"doc", "id"}


def test_exports_fill_templates_and_side_tables(spark, tmp_path):
    entities = spark.createDataFrame([("d1", "One"), ("d2", None)], "diagram string, title string")
    side = spark.createDataFrame([("d1", 2, "b"), ("d1", 1, "a")], "diagram string, ord int, line string")
    documents.exported(entities, "diagram", "<#{title}>\n#{members}\n#{other}", {"members": side}, str(tmp_path / "out"))
    got = {r["diagram"]: r["value"] for r in spark.read.option("lineSep", "\0").text(str(tmp_path / "out")).collect()}
    assert got == {"d1": "<One>\na\nb\n#{other}\n", "d2": "<>\n\n#{other}\n"}
