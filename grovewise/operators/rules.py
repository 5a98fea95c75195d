"""Declarative rules over a forest, run to a fixpoint with provenance, and maintained when nodes change.

A rule is a chain of blocks, each binding one more variable to nodes, and an output: a DataFrame whose ``key`` names each
binding, ``refs`` lists the ids of the nodes that it rests on, ``docs`` their documents, and whose other columns describe
what to insert. Blocks say which element names they read, so a change elsewhere doesn't run their rule.

Evaluation is by difference, node by node: when nodes have been added, a rule is evaluated once for each of its blocks
with that block's nodes taken from the new ones only, the blocks before it from stored partial bindings. When nodes go,
the bindings and partial bindings that rest on them are found by their ids. A binding is a tuple of nodes, so there is
one of each and what remains of it needs no counts. A rule may also be one function of all nodes (``bindings``); it is then
evaluated in full.

Outputs have deterministic ids, made of rule and key: running again changes nothing, and two runs agree. Keys and
references are made of ids, so these must be unique over the forest, which ``start`` checks. Each cycle is a set of
anti-joins against what is known, so only new bindings are written; what a write added is observed while it runs. The
loop ends when a cycle adds none.
"""

from __future__ import annotations

import functools
import hashlib
import types
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grovewise.functions.scalars import md5_base64, sanitize_ascii
from grovewise.operators.axes import each
from grovewise.operators.ordering import GAP, order_labels, ranked_order
from grovewise.operators.snapshots import dispense_names
from grovewise.sources.forest import FIELDS
from grovewise.sources.store import checkpointed, observed

MODS = "rule string, key string, refs array<string>, docs array<string>, affected string, checksum string"


def binding_key(rule: str, *ids: Column) -> Column:
    """``_rule.id.id.``: reproducible from the bound nodes alone."""
    return F.concat(F.lit(f"_{rule}."), *[x for i in ids for x in (sanitize_ascii(i.cast("string")), F.lit("."))])


def inserted(bound: DataFrame, key: Column, refs: Sequence[Column], docs: Sequence[Column], target: Column | None, name: str, attrs: Column | None = None, value: Column | None = None, ord_: Column | None = None, doc: Column | None = None, under: str | None = None) -> DataFrame:
    """Bindings in the shape that the engine takes. ``target`` is the id of the node to insert under, null for a new
    document of path ``doc``. ``under`` names the variable that holds this node instead: its place is then known from the
    binding, and the forest needn't be searched for it."""
    null = F.lit(None).cast("string")
    target = F.col(under)["id"] if under else target
    place = [F.struct(*[F.col(under)[c].alias(c) for c in ("doc", "path", "pos")]).alias("at")] if under else []
    return bound.select(
        *place,
        key.alias("key"), F.array(*refs).alias("refs"), F.array_distinct(F.array(*docs)).alias("docs"),
        (null if target is None else target).alias("target"), F.lit(name).alias("name"),
        (F.create_map().cast("map<string,string>") if attrs is None else attrs).alias("attrs"), (null if value is None else value.cast("string")).alias("value"),
        (F.lit(0) if ord_ is None else ord_).cast("long").alias("ord"), (null if doc is None else doc).alias("doc"),
    )


def document_name(text: Column, fallback: Column) -> Column:
    """A new document's path: trimmed; empty ones and those with a slash at an end are errors; by default the key."""
    name = F.trim(text)
    bad = (name == "") | name.startswith("/") | name.endswith("/")
    return F.when(name.isNull(), F.concat(fallback, F.lit("xml"))).when(bad, F.raise_error(F.concat(F.lit("bad document name: "), name))).otherwise(name)


def _first(bound: DataFrame | None, found: DataFrame) -> DataFrame:
    if bound is not None:
        raise ValueError("only a rule's first block may go without a join")
    return found


@dataclass(frozen=True)
class For:
    """A block: binds ``var`` to elements of ``name`` (None: any). ``bind`` takes what is bound so far (None at first) and
    the candidates, a DataFrame of the one variable, and must look at no other nodes. ``target``: outputs go under it."""

    var: str
    name: str | None
    bind: Callable[[DataFrame | None, DataFrame], DataFrame] = _first
    target: bool = False


@dataclass(frozen=True)
class Rule:
    """``reads``: element names whose change can alter the bindings; empty for all."""

    id: str
    bindings: Callable[[DataFrame], DataFrame]
    reads: frozenset[str] = frozenset()
    version: str = "1"
    blocks: tuple[For, ...] = ()
    output: Callable[[DataFrame], DataFrame] | None = None


def rule(id_: str, blocks: Sequence[For], output: Callable[[DataFrame], DataFrame]) -> Rule:
    """A rule of blocks: what it reads follows from them, its version from their code."""
    blocks = tuple(blocks)
    names = [b.name for b in blocks]
    reads = frozenset() if None in names else frozenset(names)
    return Rule(id_, lambda nodes: output(_chain(blocks, nodes)), reads, ".".join(stage_marks(blocks, output)), blocks, output)


def _chain(blocks: Sequence[For], nodes: DataFrame) -> DataFrame:
    bound = None
    for b in blocks:
        bound = b.bind(bound, each(nodes, b.var, b.name))
    return bound


def _nothing(of: Rule, nodes: DataFrame) -> DataFrame:
    return of.bindings(nodes.limit(0))


def node_delta(of: Rule, nodes: DataFrame, added: DataFrame, names: frozenset[str] | None = None, partial: Sequence[DataFrame] = ()) -> DataFrame:
    """The outputs of bindings that hold a node of ``added``, rows of ``nodes``: the union over the blocks of the chains in
    which that block takes its nodes from ``added``. ``names``: element names in it, where known; ``partial``: the bindings
    of the first two, three .. blocks, where stored."""
    if not of.blocks:
        return of.bindings(nodes)
    found = []
    for i, b in enumerate(of.blocks):
        if names is None or b.name is None or b.name in names:
            known = min(i - 1, len(partial)) if i > 1 else 0  # stored bindings of known + 1 blocks
            bound, start = (partial[known - 1], known + 1) if known else (None, 0)
            for j, c in enumerate(of.blocks[start:], start):
                bound = c.bind(bound, each(added if j == i else nodes, c.var, c.name))
            found.append(of.output(bound))
    return reduce(DataFrame.unionByName, found) if found else _nothing(of, nodes)


def delta(of: Rule, nodes: DataFrame, docs: DataFrame, names: frozenset[str] | None = None) -> DataFrame:
    """``node_delta`` for all nodes of some documents (doc)."""
    return node_delta(of, nodes, nodes.join(docs, "doc", "left_semi"), names)


def _mark(f: Callable, seen: frozenset = frozenset()) -> str:
    """A digest of a function: its code, the values that it closes over, its defaults, and the functions and plain values
    of its module that it names. Functions count by their own digests, those of Spark and Python by their names."""
    if isinstance(f, functools.partial):
        inner = [_mark(f.func, seen), [_held(a, seen) for a in f.args], [(k, _held(v, seen)) for k, v in sorted(f.keywords.items())]]
        return hashlib.md5(repr(inner).encode()).hexdigest()[:12]
    code = getattr(f, "__code__", None)
    if code is None or f in seen:
        return f"{getattr(f, '__module__', '')}.{getattr(f, '__qualname__', type(f).__qualname__)}"
    seen = seen | {f}

    def parts(c) -> list:
        return [c.co_code, c.co_names, [parts(x) if hasattr(x, "co_code") else repr(x) for x in c.co_consts]]

    def named(c) -> set[str]:
        return set(c.co_names).union(*(named(x) for x in c.co_consts if hasattr(x, "co_code")))

    names = sorted(named(code))
    world = [(n, _held(f.__globals__[n], seen)) for n in names if n in f.__globals__]
    # Functions of modules that it names, such as helpers that are called through them.
    modules = [f.__globals__[n] for n in names if isinstance(f.__globals__.get(n), types.ModuleType) and _own(f.__globals__[n].__name__)]
    called = [(m.__name__, n, _mark(getattr(m, n), seen)) for m in modules for n in names if isinstance(getattr(m, n, None), types.FunctionType)]
    held = [_held(c.cell_contents, seen) for c in f.__closure__ or ()]
    defaults = [_held(d, seen) for d in (*(f.__defaults__ or ()), *(v for _, v in sorted((f.__kwdefaults__ or {}).items())))]
    return hashlib.md5(repr([parts(code), held, defaults, world, called]).encode()).hexdigest()[:12]


def _own(module: str) -> bool:
    return module.split(".")[0] not in ("pyspark", "py4j", "builtins", "functools", "re", "math")


def _held(value: object, seen: frozenset) -> str:
    if isinstance(value, types.ModuleType):
        return value.__name__
    if isinstance(value, (types.FunctionType, functools.partial)):
        return _mark(value, seen) if _own(getattr(value, "__module__", None) or "") else f"{value.__module__}.{value.__qualname__}"
    if isinstance(value, (tuple, list)):
        return repr([_held(v, seen) for v in value])
    if isinstance(value, dict):
        return repr(sorted((repr(k), _held(v, seen)) for k, v in value.items()))
    return repr(value) if isinstance(value, (str, bytes, int, float, bool, frozenset, set, type(None), Column)) else f"{type(value).__module__}.{type(value).__qualname__}"


def stage_marks(blocks: Sequence[For], output: Callable) -> list[str]:
    """One mark for each stage: equal marks mean equal blocks, the functions that they use included."""
    return [hashlib.md5(f"{b.var} {b.name} {b.target} {_mark(b.bind)}".encode()).hexdigest()[:12] for b in blocks] + [_mark(output)]


def first_difference(before: Rule, now: Rule) -> int | None:
    """The first stage in which two forms of a rule differ, None if none does: what earlier stages bind stays valid."""
    a, b = before.version.split("."), now.version.split(".")
    return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), None if len(a) == len(b) else min(len(a), len(b)))


def nearest_target(blocks: Sequence[For]) -> str:
    """The variable that outputs go under: the last block's that is a target; other blocks are skipped."""
    found = [b.var for b in blocks if b.target]
    if not found:
        raise ValueError("no block is a target")
    return found[-1]


def dependencies(bound: DataFrame, key: Column, variables: Sequence[str]) -> DataFrame:
    """(key, doc): the documents of the nodes that each binding's variables hold, which it must be verified against."""
    docs = F.array_distinct(F.array(*[F.col(v)["doc"] for v in variables]))
    return bound.select(key.alias("key"), F.explode(docs).alias("doc")).distinct()


def serial_ids(rows: DataFrame, parent_key: str, order: str, into: str = "key") -> DataFrame:
    """Keys for what one binding inserts: the parent's key, with ``-1``, ``-2`` .. only where there are several."""
    n = F.count(F.lit(1)).over(Window.partitionBy(parent_key))
    serial = F.row_number().over(Window.partitionBy(parent_key).orderBy(order))
    return rows.withColumn(into, F.concat(F.col(parent_key), F.when(n > 1, F.concat(F.lit("-"), serial.cast("string"))).otherwise(""), F.lit(".")))


def fresh_documents(rows: DataFrame, doc: str, key: str, taken: DataFrame) -> DataFrame:
    """New documents under names that no document of ``taken`` (doc) and no other new one has: a name that is in use gets
    a number, in the order of keys."""
    old = taken.select(F.col("doc").alias(doc)).distinct().withColumn("_new", F.lit(False)).withColumn("_key", F.lit(""))
    both = rows.select(doc, F.col(key).alias("_key")).withColumn("_new", F.lit(True)).unionByName(old.select(doc, "_key", "_new"))
    named = dispense_names(both, doc, "_key", F.col("_key")).where("_new").select(F.col("_key").alias(key), "unique_name")
    return rows.drop(doc).join(named, key).withColumnRenamed("unique_name", doc)


def single_roots(rows: DataFrame, doc: str = "doc") -> DataFrame:
    """New documents' roots; a document that would get several is an error."""
    n = F.count(F.lit(1)).over(Window.partitionBy(doc))
    error = F.raise_error(F.concat(F.lit("more than one root for document "), F.col(doc))).cast("boolean")
    return rows.withColumn("_one", F.when(n > 1, error).otherwise(F.lit(True))).where("_one").drop("_one")


@dataclass(frozen=True)
class Sort:
    """Children of a parent are kept in the order of a value: of each binding of ``blocks`` the node that the last one
    binds is placed by ``by``, a column of the binding. Children that aren't bound stay where they are."""

    id: str
    blocks: tuple[For, ...]
    by: Column
    descending: bool = False


@dataclass
class State:
    """``partial``: for each rule of three blocks or more, the digest and the bindings of its first two, three .. blocks;
    ``known``: the rules that ran last; ``orders``: what each sort has ordered by, (doc, id, by)."""

    nodes: DataFrame
    mods: DataFrame
    cycles: int = 0
    counts: dict[str, int] = field(default_factory=lambda: {"resolved": 0, "withdrawn": 0, "verified": 0})
    sorted: dict[str, int] = field(default_factory=lambda: {"checked": 0, "moved": 0})
    partial: dict[str, list[tuple[str, DataFrame]]] = field(default_factory=dict)
    known: Sequence[Rule] = ()
    orders: dict[str, DataFrame] = field(default_factory=dict)


def start(base: DataFrame, unique: bool = False) -> State:
    """The base forest, stored once for all rules. An id that two documents have is an error, see ``qualified``; this is
    checked unless ids are known to be ``unique``."""
    base = checkpointed(base.select(*FIELDS))
    twice = None if unique else base.groupBy("id").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a <> b").first()
    if twice is not None:
        raise ValueError(f"id {twice['id']!r} is in several documents ({twice['a']!r}, {twice['b']!r}); rules need ids of their own")
    # Known to be empty, unlike a DataFrame of no Python rows: joins with it can be broadcast.
    none = base.sparkSession.range(0).select(*[F.lit(None).cast(k).alias(n) for n, k in (c.split(" ") for c in MODS.split(", "))])
    return State(base, none)


def qualified(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ids that begin with their document's path, so that documents may use the same ones."""
    own = lambda i: F.concat(F.col("doc"), F.lit("#"), i)
    return nodes.withColumns({"id": own(F.col("id")), "parent_id": own(F.col("parent_id")), "path": F.transform("path", own)})


def _checksum(rows: DataFrame) -> DataFrame:
    text = F.concat_ws("\x01", F.coalesce("target", F.lit("")), "name", F.to_json("attrs"), F.coalesce("value", F.lit("")), F.col("ord").cast("string"), F.coalesce("doc", F.lit("")))
    return rows.withColumn("checksum", md5_base64(text))


def _written(nodes: DataFrame, rows: DataFrame, rule: str) -> tuple[DataFrame, DataFrame, int, frozenset[str]]:
    """(nodes to add, their mods, their number and names) for bindings; a binding whose target is gone waits for it."""
    # What a binding inserts under is something that it rests on.
    refs = F.when(F.col("target").isNull(), F.col("refs")).otherwise(F.array_union("refs", F.array("target")))
    own = rows.withColumn("own", F.concat("key", F.lit(rule), F.lit("."))).withColumn("refs", refs)
    if "at" in rows.columns:
        under = own.where("target is not null").select("*", F.col("at.doc").alias("_doc"), F.col("at.path").alias("_path"), F.col("at.pos").alias("_pos"))
    else:
        at = nodes.select(F.col("id").alias("target"), F.col("doc").alias("_doc"), F.col("path").alias("_path"), F.col("pos").alias("_pos"))
        under = own.where("target is not null").join(at, "target")
    fresh = own.where("target is null")
    columns = {
        "id": F.col("own"), "ord": F.col("ord"), "kind": F.lit("element"), "name": F.col("name"), "attrs": F.col("attrs"), "value": F.col("value"),
    }
    inner = under.select(F.col("_doc").alias("doc"), F.col("own").alias("id"), F.col("target").alias("parent_id"), F.concat("_path", F.array("own")).alias("path"), F.concat("_pos", F.array("ord")).alias("pos"), *[v.alias(k) for k, v in columns.items() if k != "id"], "key", "refs", "docs", "checksum")
    roots = fresh.select("doc", F.col("own").alias("id"), F.lit(None).cast("string").alias("parent_id"), F.array("own").alias("path"), F.array("ord").alias("pos"), *[v.alias(k) for k, v in columns.items() if k != "id"], "key", "refs", "docs", "checksum")
    made, seen = observed(inner.unionByName(roots), n=F.count(F.lit(1)), names=F.collect_set("name"))
    return made.select(*FIELDS), made.select(F.lit(rule).alias("rule"), "key", "refs", "docs", F.col("id").alias("affected"), "checksum"), seen["n"], frozenset(seen["names"])


def _tuples(bound: DataFrame, blocks: Sequence[For]) -> DataFrame:
    """One of each tuple of nodes."""
    ids = {f"_id{i}": F.col(f"{b.var}.id") for i, b in enumerate(blocks)}
    return bound.withColumns(ids).dropDuplicates(list(ids)).drop(*ids)


def _all(state: State, of: Rule) -> DataFrame:
    """A rule's outputs from all nodes; partial bindings are kept, and those of unchanged first blocks used."""
    if not of.blocks:
        return of.bindings(state.nodes)
    marks = stage_marks(of.blocks, of.output)
    chained = ["".join(marks[: i + 2]) for i in range(max(len(of.blocks) - 2, 0))]
    kept = [(m, d) for (m, d), now in zip(state.partial.get(of.id, []), chained, strict=False) if m == now]
    bound = kept[-1][1] if kept else None
    for i, b in enumerate(of.blocks[len(kept) + 1 if kept else 0 :], len(kept) + 1 if kept else 0):
        bound = b.bind(bound, each(state.nodes, b.var, b.name))
        if 1 <= i < len(of.blocks) - 1:
            bound = checkpointed(_tuples(bound, of.blocks[: i + 1]))
            kept.append((chained[i - 1], bound))
    if kept:
        state.partial[of.id] = kept
    return of.output(bound)


def _more(state: State, of: Rule, added: DataFrame, names: frozenset[str] | None) -> DataFrame:
    """A rule's outputs that hold an added node; its partial bindings are brought up to date first."""
    kept = state.partial.get(of.id, [])
    for i in range(len(kept)):
        blocks = of.blocks[: i + 2]
        if names is None or any(b.name is None or b.name in names for b in blocks):
            bindings_of = Rule(of.id, lambda n, blocks=blocks: _chain(blocks, n), blocks=tuple(blocks), output=lambda bound: bound)
            fresh = node_delta(bindings_of, state.nodes, added, names, [d for _, d in kept[:i]])
            kept[i] = (kept[i][0], checkpointed(_tuples(kept[i][1].unionByName(fresh), blocks)))
    return node_delta(of, state.nodes, added, names, [d for _, d in kept])


def _forget(state: State, rules: Sequence[Rule], gone: DataFrame, names: frozenset[str]) -> None:
    """Drop partial bindings that hold one of some nodes (id), which have these names."""
    reads = {r.id: r.reads for r in rules}
    for id_, kept in state.partial.items():
        if kept and reads.get(id_) and not reads[id_] & names:
            continue
        for i, (mark, bound) in enumerate(kept):
            for var in [f.name for f in bound.schema.fields if f.dataType.typeName() == "struct" and "path" in f.dataType.fieldNames()]:
                bound = bound.join(gone.select(F.col("id").alias("_gone")), F.col(f"{var}.id") == F.col("_gone"), "left_anti")
            kept[i] = (mark, checkpointed(bound))


def run(state: State, rules: Sequence[Rule], limit: int = 50, changed: DataFrame | None = None, added: DataFrame | None = None, names: frozenset[str] | None = None) -> State:
    """Cycles over the rules until one adds nothing; later rules of a cycle see what earlier ones added.

    A rule runs again only when a node of a name that it reads has been added since it ran last, and then looks for
    bindings that hold one of these nodes. ``added`` (rows of the forest, of ``names`` where these are known): start with
    these nodes in place of all; ``changed`` (doc): with all nodes of these documents.
    """
    state.known = tuple(rules)
    if changed is not None:
        added = state.nodes.join(changed, "doc", "left_semi")
    fresh = [r for r in rules if added is None or names is None or not r.reads or r.reads & names]
    due: dict[str, list[tuple[DataFrame, frozenset[str] | None]] | None] = {r.id: None if added is None else [(added, names)] for r in fresh}
    for _ in range(limit):
        state.cycles += 1
        if not due:
            return state
        for r in rules:
            if r.id not in due:
                continue
            since = due.pop(r.id)
            if since is None:
                bound = _all(state, r)
            else:
                some = None if any(n is None for _, n in since) else frozenset().union(*(n for _, n in since))
                bound = _more(state, r, reduce(DataFrame.unionByName, [d.select(*FIELDS) for d, _ in since]), some)
            known = state.mods.where(F.col("rule") == r.id).select("key")
            found = _checksum(bound.dropDuplicates(["key"])).join(known, "key", "left_anti")
            nodes, mods, n, made = _written(state.nodes, found, r.id)
            if n:
                # What was added is stored already: the state is a union of stored tables, without lineage.
                state.nodes = state.nodes.select(*FIELDS).unionByName(nodes)
                state.mods = state.mods.unionByName(mods)
                state.counts["resolved"] += n
                for x in rules:
                    if not x.reads or x.reads & made:
                        due[x.id] = None if x.id in due and due[x.id] is None else [*(due.get(x.id) or []), (nodes, made)]
    raise RuntimeError(f"no fixpoint in {limit} cycles")


def withdraw(state: State, obsolete: DataFrame, limit: int = 100) -> State:
    """Delete bindings (rule, key) and, transitively, those that rest on anything inside what they had inserted.

    Each round joins the ids inside the subtrees of newly doomed outputs with the references of the remaining mods.
    """
    count = {"n": F.count(F.lit(1))}
    doomed, seen = observed(state.mods.join(obsolete.select("rule", "key").distinct(), ["rule", "key"], "left_semi"), **count)
    if not seen["n"]:
        return state
    front, total = doomed, seen["n"]
    for _ in range(limit):
        roots = front.select(F.col("affected").alias("_top"))
        held = state.nodes.join(roots.withColumnRenamed("_top", "id"), "id", "left_semi").select("doc").distinct()
        inside = state.nodes.join(held, "doc", "left_semi").select("id", F.explode("path").alias("_top")).join(roots, "_top", "left_semi").select(F.col("id").alias("ref")).distinct()
        resting = state.mods.select("rule", "key", "affected", F.explode("refs").alias("ref")).join(inside, "ref", "left_semi").select("rule", "key").distinct()
        within = state.mods.join(inside.withColumnRenamed("ref", "affected"), "affected", "left_semi").select("rule", "key")
        keys = resting.unionByName(within).distinct().join(doomed.select("rule", "key"), ["rule", "key"], "left_anti")
        front, seen = observed(state.mods.join(keys, ["rule", "key"], "left_semi"), **count)
        if not seen["n"]:
            break
        doomed, total = doomed.unionByName(front), total + seen["n"]
    else:
        raise RuntimeError(f"withdrawal didn't settle in {limit} rounds")
    gone, seen = observed(state.nodes.select("id", "name", F.explode("path").alias("affected")).join(doomed.select("affected"), "affected", "left_semi").select("id", "name").distinct(), names=F.collect_set("name"))
    state.counts["withdrawn"] += total
    state.nodes = checkpointed(state.nodes.join(gone, "id", "left_anti").select(*FIELDS))
    state.mods = checkpointed(state.mods.join(doomed.select("rule", "key"), ["rule", "key"], "left_anti"))
    _forget(state, state.known, gone, frozenset(seen["names"]))
    return state


def _alive(state: State, bound: DataFrame) -> DataFrame:
    """(key, checksum) of what is bound now and has a place to go to."""
    now = _checksum(bound.dropDuplicates(["key"]))
    if "at" in bound.columns:
        return now.select("key", "checksum")
    return now.join(state.nodes.select(F.col("id").alias("target")), "target", "left_semi").unionByName(now.where("target is null").select(*now.columns)).select("key", "checksum")


def update(state: State, rules: Sequence[Rule], removed: DataFrame, added: DataFrame, limit: int = 50) -> State:
    """Apply changed base nodes (``removed`` (id), ``added`` nodes) and bring the outputs up to date.

    Mods that rest on a removed node are verified against the bindings that hold an added one: what isn't bound again to
    the same outcome is withdrawn, with all that rests on it. Rules that are one function of all nodes are verified in
    full, until nothing more goes. Then rules look for bindings that hold an added node, and run to a fixpoint. The result
    is that of a run from scratch.
    """
    gone = checkpointed(state.nodes.join(removed.select("id").distinct(), "id", "left_semi").select("id", "name"))
    added, came = observed(added.select(*FIELDS), names=F.collect_set("name"))
    state.nodes = checkpointed(state.nodes.join(gone, "id", "left_anti").select(*FIELDS).unionByName(added))
    names = frozenset(came["names"]) | frozenset(r["name"] for r in gone.select("name").distinct().collect())
    _forget(state, rules, gone, names)
    by_blocks, whole = [r for r in rules if r.blocks], [r for r in rules if not r.blocks]
    # One look at the references finds what rests on removed nodes, for all rules of blocks.
    keys = state.mods.where(F.col("rule").isin([r.id for r in by_blocks])).select("rule", "key", F.explode("refs").alias("id")).join(gone, "id", "left_semi").select("rule", "key").distinct()
    had, seen = observed(state.mods.join(keys, ["rule", "key"], "left_semi"), n=F.count(F.lit(1)), rules=F.collect_set("rule"))
    state.counts["verified"] += seen["n"]
    lost = []
    for r in by_blocks:
        if r.id in seen["rules"]:
            alive = _alive(state, node_delta(r, state.nodes, added, frozenset(came["names"]), [d for _, d in state.partial.get(r.id, [])]))
            lost.append(had.where(F.col("rule") == r.id).join(alive, ["key", "checksum"], "left_anti").select("rule", "key"))
    for _ in range(limit):
        for r in whole:
            if not r.reads or r.reads & names:
                had = state.mods.where(F.col("rule") == r.id)
                had, seen = observed(had, n=F.count(F.lit(1)))
                state.counts["verified"] += seen["n"]
                if seen["n"]:
                    lost.append(had.join(_alive(state, r.bindings(state.nodes)), ["key", "checksum"], "left_anti").select("rule", "key"))
        if not lost:
            break
        before, withdrawn = state.nodes, state.counts["withdrawn"]
        state, lost = withdraw(state, reduce(DataFrame.unionByName, lost)), []
        if state.counts["withdrawn"] == withdrawn or not whole:
            break
        names = frozenset(r["name"] for r in before.join(state.nodes.select("id"), "id", "left_anti").select("name").distinct().collect())
    else:
        raise RuntimeError(f"verification didn't settle in {limit} rounds")
    return run(state, rules, limit, added=added, names=frozenset(came["names"]))


def changed_rules(state: State, before: Sequence[Rule], now: Sequence[Rule]) -> State:
    """Withdraw the mods of rules that are gone, and of changed ones those that aren't bound to the same outcome any more.

    The bindings of blocks before the first that differs stay stored and aren't computed again. A rule without blocks is
    known by its version only, so all its mods go.
    """
    versions = {r.id: r for r in now}
    lost = []
    for r in before:
        new = versions.get(r.id)
        if new is not None and new.version == r.version:
            continue
        had = state.mods.where(F.col("rule") == r.id)
        if new is not None and new.blocks and r.blocks:
            had = had.join(_alive(state, _all(state, new)), ["key", "checksum"], "left_anti")
        lost.append(had.select("rule", "key"))
    return withdraw(state, reduce(DataFrame.unionByName, lost)) if lost else state


def _with_labels(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """``nodes`` with new places among their siblings (doc, id, label), of themselves and of what lies below them. Only
    documents in which something moves are looked through."""
    docs = labels.select("doc").distinct()
    held = nodes.join(docs, "doc", "left_semi").select("doc", "id", F.posexplode("path").alias("_depth", "_up"))
    steps = held.join(labels.select("doc", F.col("id").alias("_up"), "label"), ["doc", "_up"]).groupBy("doc", "id").agg(F.map_from_entries(F.collect_list(F.struct("_depth", "label"))).alias("_new"))
    found = nodes.join(steps, ["doc", "id"], "left")
    pos = F.when(F.col("_new").isNull(), F.col("pos")).otherwise(F.transform("pos", lambda p, i: F.coalesce(F.try_element_at("_new", i), p)))
    return found.withColumn("pos", pos).withColumn("ord", F.element_at("pos", -1)).select(*FIELDS)


def _siblings(nodes: DataFrame, parents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All children of some parents (_p), numbered, and what is beside each: (doc, id, precedes, follows, last)."""
    kids = nodes.withColumn("_family", F.struct("doc", "parent_id")).join(parents, F.col("_family").eqNullSafe(F.col("_p")), "left_semi").select("doc", "id", "ord", "_family")
    kids = checkpointed(ranked_order(kids, "_family", [F.col("ord")], "id", "_n").withColumn("_n", F.col("_n").cast("long")))
    beside = lambda name, n: kids.select(F.col("_family").alias(f"_{name}"), (F.col("_n") + n).alias(f"_n_{name}"), F.col("ord").alias(name))
    last = kids.groupBy(F.col("_family").alias("_l")).agg(F.max("ord").alias("last"))
    found = kids
    for name, n in (("precedes", 1), ("follows", -1)):
        found = found.join(beside(name, n), F.col("_family").eqNullSafe(F.col(f"_{name}")) & (F.col("_n") == F.col(f"_n_{name}")), "left")
    return kids, found.join(last, F.col("_family").eqNullSafe(F.col("_l"))).select("doc", "id", "precedes", "follows", "last")


def _settle(state: State, sort: Sort) -> DataFrame | None:
    """Order the children of the parents under which something that ``sort`` binds is new or has another value than before;
    the nodes that moved, None if none did."""
    last = sort.blocks[-1].var
    now = _chain(sort.blocks, state.nodes).select(F.col(f"{last}.doc").alias("doc"), F.col(f"{last}.id").alias("id"), F.col(f"{last}.parent_id").alias("parent_id"), F.col(f"{last}.ord").alias("ord"), sort.by.alias("by"))
    several = F.raise_error(F.concat(F.lit(f"{sort.id}: more than one value for "), F.col("id"))).cast("boolean")
    now = now.dropDuplicates(["doc", "id", "by"]).groupBy("doc", "id", "parent_id", "ord").agg(F.any_value("by").alias("by"), F.count(F.lit(1)).alias("_n"))
    now = checkpointed(now.withColumn("_one", F.when(F.col("_n") > 1, several).otherwise(F.lit(True))).where("_one").drop("_n", "_one"))
    before = state.orders.get(sort.id)
    old = now.limit(0) if before is None else before
    same = (F.col("doc") == F.col("_d")) & (F.col("id") == F.col("_i")) & F.col("by").eqNullSafe(F.col("_b")) & (F.col("ord") == F.col("_o"))
    kept = old.select(F.col("doc").alias("_d"), F.col("id").alias("_i"), F.col("by").alias("_b"), F.col("ord").alias("_o"), F.lit(False).alias("fresh"))
    now = now.join(kept, same, "left").withColumn("fresh", F.coalesce("fresh", F.lit(True))).select("doc", "id", "parent_id", "ord", "by", "fresh").withColumn("parent", F.struct("doc", "parent_id"))
    now = checkpointed(now)
    due, seen = observed(now.where("fresh").select(F.col("parent").alias("_p")).distinct(), n=F.count(F.lit(1)))
    state.orders[sort.id] = now.select("doc", "id", "ord", "by")
    if not seen["n"]:
        return None
    state.sorted["checked"] += seen["n"]
    rows = now.join(due, F.col("parent").eqNullSafe(F.col("_p")), "left_semi")
    kids, places = _siblings(state.nodes, due)
    placed, seen = observed(order_labels(rows.join(places, ["doc", "id"]), "parent", [F.col("by")], sort.descending), tight=F.count_if(~F.col("room")), moved=F.count_if(F.col("label") != F.col("ord")))
    if not seen["moved"]:
        return None
    state.sorted["moved"] += seen["moved"]
    if seen["tight"]:
        # All children of these parents are numbered anew, with gaps, in the order that they have; then there is room.
        tight = placed.where("not room").select(F.col("parent").alias("_p")).distinct()
        wide = checkpointed(kids.join(tight, F.col("_family").eqNullSafe(F.col("_p")), "left_semi").select("doc", "id", (F.col("_n") * GAP).alias("label")))
        state.nodes = checkpointed(_with_labels(state.nodes, wide))
        rows = rows.drop("ord").join(state.nodes.select("doc", "id", "ord"), ["doc", "id"])
        placed = order_labels(rows.join(_siblings(state.nodes, due)[1], ["doc", "id"]), "parent", [F.col("by")], sort.descending)
    labels = checkpointed(placed.where("label <> ord").select("doc", "id", "label"))
    state.nodes = checkpointed(_with_labels(state.nodes, labels))
    state.orders[sort.id] = checkpointed(now.select("doc", "id", "by").join(state.nodes.select("doc", "id", "ord"), ["doc", "id"]))
    return state.nodes.join(labels.select("doc", "id"), ["doc", "id"], "left_semi")


def settle(state: State, sorts: Sequence[Sort], rules: Sequence[Rule] = (), limit: int = 10) -> State:
    """Once no rule adds anything, and so every document is at rest: bring siblings into their orders. Bindings that rest on
    a node that moved are verified, since an output may tell its place; this goes on until nothing moves."""
    for _ in range(limit):
        moved = [m for m in (_settle(state, s) for s in sorts) if m is not None]
        if not moved:
            return state
        state.cycles += 1
        if rules:
            nodes = checkpointed(reduce(DataFrame.unionByName, moved).dropDuplicates(["doc", "id"]))
            state = update(state, rules, nodes.select("id"), nodes)
    raise RuntimeError(f"orders didn't settle in {limit} rounds")


def vanished(state: State) -> State:
    """Withdraw mods that rest on a document which isn't there any more, as found at start-up."""
    there = state.nodes.select("doc").distinct()
    gone = state.mods.select("rule", "key", F.explode("docs").alias("doc")).join(there, "doc", "left_anti").select("rule", "key").distinct()
    return withdraw(state, gone)


def gated(state: State, base: DataFrame, engine: str, last_engine: str | None) -> tuple[State, bool]:
    """(state, run from scratch?): outputs of another version of the engine, or of none, are wiped."""
    return (state, False) if engine == last_engine else (start(base), True)


def assigned_ids(rules: Sequence[tuple[str, tuple[str, ...]]], before: Mapping[str, tuple[str, tuple[str, ...]]], short: Callable[[str], str]) -> list[str]:
    """Ids of rules (description, earlier descriptions): that of the one rule of ``before`` (id to the same) which had one
    of these descriptions, else a fresh one from the description's short form. Rules are few, so this is driver's work."""
    out: list[str] = []
    for desc, aliases in rules:
        same = [i for i, (d, a) in before.items() if {d, *a} & {desc, *aliases}]
        name, n = f"r-{short(desc)}", 1
        while len(same) != 1 and name in {*before, *out}:
            n += 1
            name = f"r-{short(desc)}-{n}"
        out.append(same[0] if len(same) == 1 else name)
    return out


def toggled(state: State, rules: Sequence[Rule], action: DataFrame, enabled: bool) -> State:
    """Undo or redo an action, given as the base nodes that it adds: they are taken out, or put in again, and outputs
    follow."""
    none = action.limit(0)
    return update(state, rules, none.select("id"), action) if enabled else update(state, rules, action.select("id"), none)


def run_or_revert(base: DataFrame, rules: Sequence[Rule], last_good: Sequence[Rule]) -> tuple[State, bool]:
    """(state, were they good?): the outputs of ``rules`` or, where these fail, of the last rules that didn't."""
    try:
        return run(start(base), rules), True
    except (AnalysisException, RuntimeError, PySparkException):
        return run(start(base), last_good), False


def keyed_changes(had: DataFrame, now: DataFrame, key: str = "key") -> DataFrame:
    """(key, action) that bring what was inserted to what is bound now: delete, add or keep. One full outer join."""
    both = had.select(key, F.lit(True).alias("_h")).distinct().join(now.select(key, F.lit(True).alias("_n")).distinct(), key, "full_outer")
    return both.select(key, F.when(F.col("_n").isNull(), "delete").when(F.col("_h").isNull(), "add").otherwise("keep").alias("action"))


def due_orders(sorts: DataFrame, changed: DataFrame) -> DataFrame:
    """Orders (parent, doc, ..) to settle at the end of a cycle: those in documents that it didn't change; the others wait
    until their document is at rest."""
    return sorts.join(changed.select("doc").distinct(), "doc", "left_anti")
