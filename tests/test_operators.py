"""Rules, order, time, snapshots, similarity, graphs, stores: small cases with known results."""

from __future__ import annotations

import time
import uuid
from datetime import datetime, timedelta
from math import expm1, isnan
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from grovewise.functions import scalars as S
from grovewise.operators import graph, ordering, rules, similarity, snapshots, temporal
from grovewise.operators.axes import attr, each
from grovewise.sources import documents
from grovewise.sources.forest import FIELDS, NODE
from grovewise.sources.store import VersionedTable, shared_folder


def base(spark, items):
    rows = [("d", "root", None, ["root"], [0], 0, "element", "foo", {}, None)]
    rows += [("d", i, "root", ["root", i], [0, k], k, "element", "item", {"name": n}, None) for k, (i, n) in enumerate(items.items())]
    return spark.createDataFrame(rows, NODE)


def chain():
    def bars(n):
        b = each(n, "x", "item").crossJoin(each(n, "r", "foo"))
        return rules.inserted(b, rules.binding_key("bar", F.col("x.id")), [F.col("x.id")], [F.col("x.doc")], F.col("r.id"), "bar", value=attr("x", "name"))

    def bazs(n):
        return rules.inserted(each(n, "b", "bar"), rules.binding_key("baz", F.col("b.id")), [F.col("b.id")], [F.col("b.doc")], F.col("b.id"), "baz", value=F.upper("b.value"))

    return [rules.Rule("baz", bazs, frozenset({"bar"})), rules.Rule("bar", bars, frozenset({"item", "foo"}))]


def out(state):
    return sorted((r["name"], r["value"]) for r in state.nodes.where("name in ('bar', 'baz')").collect())


def test_fixpoint_doesnt_depend_on_rule_order_and_repeats(spark):
    b = base(spark, {"i1": "p", "i2": "q"})
    want = [("bar", "p"), ("bar", "q"), ("baz", "P"), ("baz", "Q")]
    inverse, straight = rules.run(rules.start(b), chain()), rules.run(rules.start(b), chain()[::-1])
    assert out(inverse) == out(straight) == want and straight.cycles < inverse.cycles
    n = inverse.counts["resolved"]
    assert out(rules.run(inverse, chain())) == want and inverse.counts["resolved"] == n == 4


def test_updates_equal_a_run_from_scratch_and_touch_little(spark):
    state = rules.run(rules.start(base(spark, {"i1": "p", "i2": "q", "i3": "r"})), chain())
    now = {"i1": "p", "i2": "changed", "i4": "new"}
    added = base(spark, now).where("id in ('i2', 'i4')")
    state = rules.update(state, chain(), spark.createDataFrame([("i2",), ("i3",)], "id string"), added)
    fresh = rules.run(rules.start(base(spark, now)), chain())
    assert out(state) == out(fresh)
    assert state.counts["withdrawn"] == 4 and state.counts["resolved"] == 6 + 4
    ids = lambda s: sorted(r["id"] for r in s.nodes.where("name in ('bar', 'baz')").collect())
    assert ids(state) == ids(fresh) and state.mods.count() == 6


def test_withdrawal_follows_references_and_changed_rules(spark):
    state = rules.run(rules.start(base(spark, {"i1": "p"})), chain())
    again = chain()
    again[1] = rules.Rule("bar", again[1].bindings, again[1].reads, version="2")
    state = rules.changed_rules(state, chain(), again)
    assert out(state) == [] and state.mods.count() == 0
    assert out(rules.run(state, again)) == [("bar", "p"), ("baz", "P")]


def test_document_names(spark):
    df = spark.createDataFrame([(" a/b.xml ",), (None,)], "t string")
    assert [r[0] for r in df.select(rules.document_name(F.col("t"), F.lit("_k."))).collect()] == ["a/b.xml", "_k.xml"]
    for bad in ("", "/x", "x/"):
        with pytest.raises(Exception, match="bad document name"):
            spark.createDataFrame([(bad,)], "t string").select(rules.document_name(F.col("t"), F.lit("k"))).collect()


def test_greedy_order_breaks_conflicts_and_cycles():
    assert ordering.greedy_order(["c", "a", "b"], {}) == ["a", "b", "c"]
    assert ordering.greedy_order(["a", "b", "c"], {("c", "a"): 1, ("a", "b"): 1}) == ["c", "a", "b"]
    assert ordering.greedy_order(["a", "b"], {("a", "b"): 1, ("b", "a"): 2}) == ["b", "a"]
    assert ordering.greedy_order(["a", "b", "c"], {("a", "b"): 3, ("b", "c"): 2, ("c", "a"): 1}) == ["a", "b", "c"]


@given(st.permutations("abcdef"))
@settings(max_examples=40, deadline=None)
def test_greedy_order_keeps_a_total_order(order):
    assert ordering.greedy_order(sorted(order), {e: 1 for e in zip(order, order[1:], strict=False)}) == list(order)


def plain_greedy(ids, edges):
    """The greedy order by its definition, each step looking at all."""
    left, out = sorted(ids), []
    while left:
        best = min(left, key=lambda i: (max((p for (a, b), p in edges.items() if b == i and a != b and a in left), default=float("-inf")), i))
        left.remove(best)
        out.append(best)
    return out


@given(st.dictionaries(st.tuples(st.sampled_from("abcdefg"), st.sampled_from("abcdefg")), st.integers(0, 4)))
@settings(max_examples=200, deadline=None)
def test_greedy_order_equals_its_definition(edges):
    assert ordering.greedy_order(list("gfedcba"), edges) == plain_greedy("abcdefg", edges)


def test_greedy_order_of_many_children_is_quick():
    ids = [f"{i:05}" for i in range(20_000)]
    began = time.perf_counter()
    assert ordering.greedy_order(ids, {e: 1 for e in zip(ids[1:], ids, strict=False)}) == ids[::-1]
    assert time.perf_counter() - began < 10


def test_ranked_order_equals_the_constraint_graph_and_cuts_a_large_parent(spark):
    rows = [(None if i % 50 == 0 else "big" if i % 3 else f"p{i % 7}", f"x{i * 7919 % 1000}", i % 11 == 0, i * 31 % 13) for i in range(600)]
    df = spark.createDataFrame(rows, "parent string, id string, urgent boolean, day int")
    got = ordering.ranked_order(df, "parent", [~F.col("urgent"), F.when(~F.col("urgent"), F.col("day"))])
    assert got.columns == [*df.columns, "place"]
    want = {}
    for parent in {r[0] for r in rows}:
        kids = [r for r in rows if r[0] == parent]
        days = sorted({k[3] for k in kids if not k[2]})
        edges = {(a[1], b[1]): 9 if a[2] else 1 for a in kids for b in kids if not b[2] and (a[2] or days.index(a[3]) + 1 == days.index(b[3]))}
        want |= {(parent, i): k for k, i in enumerate(ordering.greedy_order([k[1] for k in kids], edges), 1)}
    assert {(r["parent"], r["id"]): r["place"] for r in got.collect()} == want


def same_as_sql(spark, name, d="/root/testdata/sf0.001"):
    """The rows of a query, which are those of its SQL."""
    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    for p in Path(d).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    got = entry.queries()[name](spark, d)
    want = con.sql(entry.oracle_sql()[name])
    rows = sorted(tuple(r) for r in got.collect())
    assert got.columns == want.columns and rows == sorted(want.fetchall())
    return rows


def test_order_graph_priority_takes_every_order(spark):
    rows = same_as_sql(spark, "order_graph_priority")
    assert len(rows) == spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count()


def test_whole_graph_has_an_arc_for_each_customer_and_order(spark):
    d = "/root/testdata/sf0.001"
    n = {t: spark.read.parquet(f"{d}/{t}.parquet").count() for t in ("customer", "orders")}
    degrees = {r[0]: r[1:] for r in same_as_sql(spark, "graph_degrees")}
    assert sum(o for i, (_, o) in degrees.items() if i[0] == "o") == n["orders"]
    assert sum(i for k, (i, _) in degrees.items() if k[0] == "c") == n["customer"]
    for name in ("reach_fwd", "reach_rev", "neighbors", "contract", "visible"):
        assert same_as_sql(spark, f"graph_{name}"), name
    for name in ("isolated", "complement"):  # of few suppliers, none is in debt
        assert same_as_sql(spark, f"graph_{name}", "/root/testdata/sf0.01"), name


def test_reconcile_takes_every_key_and_finds_all_states(spark):
    rows = same_as_sql(spark, "reconcile_keys")
    assert {state for _, state in rows} == {"added", "deleted", "matched"}
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count()
    assert sum(state != "added" for _, state in rows) == orders


def test_sequence_and_moved(spark):
    kids = spark.createDataFrame([("p", "x", 2), ("p", "y", 1), ("p", "z", 3)], "parent string, id string, pos int")
    edges = ordering.sequence_edges(kids, "parent", "pos", 1)
    got = ordering.priority_order(kids, edges, "parent")
    assert [r["id"] for r in got.orderBy("place").collect()] == ["y", "x", "z"]
    before = kids.select("parent", "id", F.col("pos").alias("place"))
    assert ordering.moved(before.withColumn("place", F.lit(1)), got, "parent").count() == 2


T0 = datetime(2024, 1, 1)


def at(hours):
    return T0 + timedelta(hours=hours)


def test_quiet_ranges_shift_by_precision(spark):
    e = spark.createDataFrame([("a", at(1)), ("a", at(1)), ("a", at(10))], "k string, ts timestamp_ntz")
    lit = lambda t: F.lit(t).cast("timestamp_ntz")
    got = temporal.quiet_ranges(e, ["k"], "ts", lit(at(0)), lit(at(24)), timedelta(hours=5), timedelta(hours=1))
    assert sorted((r["from_ts"], r["to_ts"]) for r in got.collect()) == [(at(2), at(10)), (at(11), at(24))]


def test_mediation_wants_all_proposals(spark):
    lit = lambda t: F.lit(t).cast("timestamp_ntz")
    schema = "s string, p string, from_ts timestamp_ntz, to_ts timestamp_ntz, interesting boolean"

    def agreed(*ranges):
        r = spark.createDataFrame([("s", *x) for x in ranges], schema)
        return [x["checkpoint"] for x in temporal.mediate(r, ["s"], "p", lit(at(0)), lit(at(20))).collect()]

    assert agreed(("a", at(5), at(10), True), ("b", at(7), at(12), False)) == [at(7)]
    assert agreed(("a", at(5), at(10), True), ("b", at(11), at(12), False)) == []
    assert agreed(("a", at(5), at(10), False)) == []
    assert agreed(("a", at(20), at(30), True)) == []


def test_commit_sessions_split_repeated_files(spark):
    rows = [("u", "m", "f", at(0)), ("u", "m", "g", at(1)), ("u", "m", "f", at(2)), ("u", "m", "g", at(9))]
    got = temporal.commit_sessions(spark.createDataFrame(rows, "author string, message string, file string, date timestamp_ntz"), timedelta(hours=5))
    assert sorted((r["date"], r["stretch"], r["part"]) for r in got.collect()) == [(at(0), 1, 0), (at(1), 1, 0), (at(2), 1, 1), (at(9), 2, 0)]


def test_snapshot_identity_and_names(spark):
    before = spark.createDataFrame([("a", 1, False), ("b", 1, False), ("d", 1, True)], "f string, s int, dir boolean")
    now = spark.createDataFrame([("a", 2, False), ("c", 1, False), ("d", 9, True)], "f string, s int, dir boolean")
    got = {r["f"]: r["action"] for r in snapshots.snapshot_diff(before, now, "f", "s", "dir").collect()}
    assert got == {"a": "edit", "b": "delete", "c": "add", "d": "same"}
    old = spark.createDataFrame([(1, "x", 1), (2, "y", 2), (3, "w", 3)], "id int, name string, size int")
    new = spark.createDataFrame([(11, "x", 5), (12, "z", 2), (13, "w", 3), (14, "w", 4)], "id int, name string, size int")
    m = snapshots.identity_match(old, new, [["name"], ["size"]], "id")
    assert sorted(map(tuple, m.collect())) == [(11, 1), (12, 2), (13, 3)]
    names = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, "a-1"), (5, None), (6, "a")], "id int, name string")
    got = {r["id"]: r["unique_name"] for r in snapshots.dispense_names(names, "name", "id", F.lit("n")).collect()}
    assert got[1] == "a" and got[4] == "a-1" and len(set(got.values())) == 6 and got[2] == "a-2" and got[3] == "n-1"


def test_similarity_values(spark):
    df = spark.createDataFrame([("a.b.c", "a.b.d", "kitten", "sitting"), ("a", "b", "", ""), ("a.b", "a.b.c", "x", "")], "p string, q string, x string, y string")
    got = [tuple(r) for r in df.select(similarity.common_prefix(F.col("p"), F.col("q")), similarity.name_commonality(F.col("x"), F.col("y"))).collect()]
    assert got[0] == pytest.approx((2 / 3, 1 - 3 / 7)) and got[1] == (0.0, 1.0) and got[2] == (1.0, 0.0)
    row = spark.range(1).select(similarity.saturating(F.lit(250.0)), similarity.crowding(F.lit(12))).first()
    assert tuple(row) == pytest.approx((0.5, 50 * expm1(2)))


def test_annealing_separates_what_clashes(spark):
    pairs = [(1, a, b, 100.0 if (a < 3) != (b < 3) else -100.0) for a in range(6) for b in range(a)]
    got = similarity.anneal(spark.createDataFrame(pairs, "k long, a int, b int, cost double"), "k", 2, steps=60).collect()
    assert len({r["group"] for r in got if r["id"] < 3}) == 1 and len({r["group"] for r in got}) == 2 and {r["cost"] for r in got} == {-600.0}


def test_anneal_assignment_searches_with_the_operators_steps(spark, monkeypatch):
    from grovewise.plans import relations

    asked, anneal = [], similarity.anneal
    monkeypatch.setattr(similarity, "anneal", lambda *a, **how: asked.append(how) or anneal(*a, **how))
    got = relations.anneal_assignment(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == 25 and "steps" not in asked[0]


def test_graph_operators(spark):
    arcs = spark.createDataFrame([("a", "b", "k"), ("b", "c", "k"), ("c", "a", "k"), ("c", "d", "l"), ("e", "d", "l")], "src string, dst string, kind string")
    nodes = spark.createDataFrame([(x, "n") for x in "abcdef"], "id string, kind string")
    start = spark.createDataFrame([("a",)], "id string")
    assert {r["id"]: r["depth"] for r in graph.reachable(arcs, start).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}
    assert {r["id"] for r in graph.reachable(arcs, spark.createDataFrame([("d",)], "id string"), reverse=True).collect()} == set("abcde")
    assert [r["id"] for r in graph.isolated(nodes, arcs).collect()] == ["f"]
    members = spark.createDataFrame([("a", "g"), ("b", "g"), ("c", "g")], "id string, group string")
    got = {(r["src"], r["dst"]): (r["composite"], r["n_arcs"]) for r in graph.contract(arcs, members).collect()}
    assert got == {("g", "d"): (True, 1), ("e", "d"): (False, 1)}
    assert graph.expand(members, arcs, "g").count() == 5


def test_versioned_store_and_wipe(spark):
    t = VersionedTable(spark, f"{shared_folder(spark)}/t-{uuid.uuid4().hex}")
    t.commit(t.stage(spark.range(3)))
    t.abort(t.stage(spark.range(99)))
    t.commit(t.stage(spark.range(5)))
    assert t.versions() == [1, 2] and t.read().count() == 5 and t.read(1).count() == 3
    with pytest.raises(ValueError, match="no version"):
        t.read(7)
    assert not t.wipe_if(False) and t.wipe_if(True) and t.versions() == []


def test_files_patterns_logs_and_code(spark, tmp_path):
    for name, text in {"a.xml": "<a/>", "sub/b.xml": "<b/>", "sub/skip.txt": "x"}.items():
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_text(text)
    found = documents.load_files(spark, str(tmp_path), ["**/*.xml"], ["**/b*"])
    assert [(r["doc"], r["text"]) for r in found.collect()] == [("a.xml", "<a/>")]
    load, same = documents.inherit_unchanged(documents.load_files(spark, str(tmp_path)), found)
    assert sorted(r["doc"] for r in load.collect()) == ["sub/b.xml", "sub/skip.txt"] and same.count() == 1
    lines = spark.createDataFrame([("M 2024-01-02 03:04 u 1.1 f",), ("T 2024-01-02 03:05 u 1.1 f",), ("X 2024-01-02 03:04 u 1 f",), ("M bad",)], "value string")
    assert sorted((r["code"], r["interest"]) for r in documents.history_log(lines).collect()) == [("M", False), ("T", True)]
    code = "package p.q;\npublic class A {\n  private int x;\n  class B {\n    public String f(int a) { return null; }\n  }\n  static void g() {\n    int local;\n  }\n}\n"
    got = documents.code_members(spark.createDataFrame([("A.java", code)], "doc string, text string")).collect()
    assert [(r["type"], r["kind"], r["name"]) for r in got] == [("A", "class", "A"), ("A", "field", "x"), ("A$B", "class", "B"), ("A$B", "method", "f"), ("A", "method", "g")]
    assert got[1]["modifiers"] == ["private"] and got[3]["returns"] == "String" and {r["package"] for r in got} == {"p.q"}


def test_gxl_by_line_and_over_lines(spark, tmp_path):
    nodes = spark.createDataFrame([("n1", "A"), ("n2", "B&C")], "id string, kind string")
    arcs = spark.createDataFrame([("n1", "n2", "in")], "src string, dst string, kind string")
    documents.gxl_lines(nodes, arcs).write.text(str(tmp_path / "lines"))
    (tmp_path / "whole.gxl").write_text(
        '<gxl><graph id="g">\n<node id="n1">\n<type xmlns:xlink="http://www.w3.org/1999/xlink" xlink:href="A"/>\n</node>\n'
        '<node id="n2"><type xmlns:xlink="http://www.w3.org/1999/xlink"\n xlink:href="B&amp;C"/></node>\n'
        '<edge from="n1" to="n2">\n<type xmlns:xlink="http://www.w3.org/1999/xlink" xlink:href="in"/></edge>\n</graph></gxl>'
    )
    for path, by_line in ((tmp_path / "lines", True), (tmp_path / "whole.gxl", False)):
        n, a = documents.read_gxl(spark, str(path), by_line)
        assert sorted(map(tuple, n.collect())) == [("n1", "A"), ("n2", "B&C")] and list(map(tuple, a.collect())) == [("n1", "n2", "in")]


def test_html_is_read_tolerantly(spark):
    rows = documents.shred_html("d", "<p>one<br>two<p>three</div><b>x")
    assert [r[7] for r in rows] == ["p", "br", "p", "b"] and rows[0][9] == "one two"
    assert FIELDS[7] == "name"


def test_scalars(spark):
    one = spark.createDataFrame([("é-a b", "x<&\">")], "s string, h string")
    r = one.select(S.sanitize_key(F.col("s")), S.escape_html(F.col("h")), S.md5_base64(F.col("s")), S.hmac_md5("k")(F.col("s")), S.strip(F.lit(" \t a \r\n")), S.expand("#{a}#{b}#{", {"a": F.lit("#{b}")}), S.cardinal(F.lit(11))).first()
    assert r[0] == "é--a-20-b" and r[1] == "x&lt;&amp;&quot;&gt;" and r[4] == "a" and r[5] == "#{b}#{b}#{" and r[6] == "11"
    d = spark.range(1).select(S.divide(F.lit(1), F.lit(0)), S.divide(F.lit(0), F.lit(0)), S.integer_divide(F.lit(-7), F.lit(2)), S.remainder(F.lit(-7), F.lit(2)), S.integer_divide(F.lit(1), F.lit(0))).first()
    assert d[0] == float("inf") and isnan(d[1]) and d[2] == -3 and d[3] == -1 and d[4] is None
