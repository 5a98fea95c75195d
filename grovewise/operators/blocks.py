"""Rules as data: blocks are mappings, their conditions and values Spark SQL expressions over the variables.

    {"id": "copy", "blocks": [
        {"for each": "c", "name": "customer", "where": "c.attrs['balance'] > 0"},
        {"for each": "p", "name": "page", "on": "p.attrs['of'] = c.parent_id", "target": True},
        {"insert": "entry", "attrs": {"of": "c.id"}, "value": "c.attrs['name']", "ord": "c.ord"}]}

A variable of nodes is a struct column (doc, id, parent_id, path, pos, ord, kind, name, attrs, value). Block types are
registered by name with what they allow, so rules are checked when they are compiled, and further types can be added.
Equal blocks are equal data: what changed in a rule is found by comparing stages.

Rules of ``for each`` blocks are maintained node by node; one that holds a set, a sequence, distinct values or at most one
node can lose bindings when nodes are added, and is evaluated in full when something that it reads changes.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovewise.functions.scalars import sanitize_ascii
from grovewise.operators import rules
from grovewise.operators.axes import each


@dataclass
class Scope:
    """What the blocks so far have bound: variables of nodes, keys that tell bindings apart, and what they rest on."""

    rule: str
    nodes: list[str] = field(default_factory=list)
    sets: list[str] = field(default_factory=list)
    values: list[str] = field(default_factory=list)
    target: str | None = None

    def names(self) -> set[str]:
        return {*self.nodes, *self.sets, *self.values}

    def key(self) -> Column:
        parts = [*(F.col(f"{v}.id") for v in self.nodes), *(F.concat_ws(" ", v) for v in self.sets), *(sanitize_ascii(F.col(v).cast("string")) for v in self.values)]
        return rules.binding_key(self.rule, *parts)


@dataclass(frozen=True)
class BlockType:
    """``binds``: adds a variable; ``grows``: more nodes only ever give more bindings."""

    name: str
    allowed: frozenset[str]
    run: Callable
    binds: bool = True
    grows: bool = False
    kind: str = "nodes"


BLOCKS: dict[str, BlockType] = {}


def block(name: str, *allowed: str, **more: object) -> Callable[[Callable], Callable]:
    """Register a block type and the attributes that it takes beside its own."""

    def add(run: Callable) -> Callable:
        BLOCKS[name] = BlockType(name, frozenset(allowed), run, **more)
        return run

    return add


def _on(spec: Mapping, var: str) -> Column:
    """How candidates meet bindings: children or the parent of a bound node, or any condition."""
    out = F.lit(True)
    if "child of" in spec:
        up = spec["child of"]
        out = (F.col(f"{up}.doc") == F.col(f"{var}.doc")) & (F.col(f"{up}.id") == F.col(f"{var}.parent_id"))
    if "parent of" in spec:
        down = spec["parent of"]
        out = (F.col(f"{down}.doc") == F.col(f"{var}.doc")) & (F.col(f"{down}.parent_id") == F.col(f"{var}.id"))
    return out & F.expr(spec["on"]) if "on" in spec else out


def _candidates(bound: DataFrame | None, found: DataFrame, spec: Mapping, var: str, outer: bool = False) -> DataFrame:
    found = found.where(F.expr(spec["where"])) if "where" in spec else found
    if bound is None:
        return found
    if not {"on", "child of", "parent of"} & spec.keys():
        raise ValueError(f"{var}: a block after the first needs 'on', 'child of' or 'parent of'")
    return bound.join(found, _on(spec, var), "left" if outer else "inner")


_FROM = ("name", "where", "on", "child of", "parent of")


@block("for each", *_FROM, "target", grows=True)
def _for_each(bound: DataFrame | None, found: DataFrame, scope: Scope, spec: Mapping) -> DataFrame:
    return _candidates(bound, found, spec, spec["for each"])


@block("for one", *_FROM, "target")
def _for_one(bound: DataFrame | None, found: DataFrame, scope: Scope, spec: Mapping) -> DataFrame:
    """None drops the binding, several are an error."""
    var = spec["for one"]
    met = _candidates(bound, found, spec, var)
    keys = [F.col(f"{v}.id").alias(f"_k{i}") for i, v in enumerate(scope.nodes)] + [F.col(v).alias(f"_v{i}") for i, v in enumerate([*scope.sets, *scope.values])]
    before = [c for c in met.columns if c != var]
    several = F.raise_error(F.concat(F.lit(f"{scope.rule}: more than one {var} for "), scope.key())).cast("boolean")
    one = met.groupBy(*keys or [F.lit(0).alias("_k")]).agg(F.count(F.lit(1)).alias("_n"), *[F.any_value(c).alias(c) for c in (*before, var)])
    return one.withColumn("_one", F.when(F.col("_n") > 1, several).otherwise(F.lit(True))).where("_one").select(*before, var)


def _collected(bound: DataFrame | None, found: DataFrame, scope: Scope, spec: Mapping, item: Column, var: str, node: str, keep_empty: bool) -> DataFrame:
    """Bindings with the sorted array of what their candidates give."""
    met = _candidates(bound, found, spec, node, outer=keep_empty)
    before = [c for c in met.columns if c != node]
    keys = [F.col(f"{v}.id").alias(f"_k{i}") for i, v in enumerate(scope.nodes)] + [F.col(v).alias(f"_v{i}") for i, v in enumerate([*scope.sets, *scope.values])]
    # The result is one array for each binding, as that is what the block binds.
    out = met.groupBy(*keys or [F.lit(0).alias("_k")]).agg(F.array_sort(F.collect_list(item)).alias(var), *[F.any_value(c).alias(c) for c in before])
    return out.select(*before, var)


@block("for all", *_FROM, kind="sets")
def _for_all(bound: DataFrame | None, found: DataFrame, scope: Scope, spec: Mapping) -> DataFrame:
    """The ids of the whole set, in order; an empty set binds nothing."""
    return _collected(bound, found, scope, spec, F.col("_node.id"), spec["for all"], "_node", False)


@block("with some", *_FROM, "value", kind="values")
def _with_some(bound: DataFrame | None, found: DataFrame, scope: Scope, spec: Mapping) -> DataFrame:
    out = _collected(bound, found, scope, spec, F.expr(spec["value"]), spec["with some"], "_node", False)
    return out.where(F.size(spec["with some"]) > 0)


@block("with any", *_FROM, "value", kind="values")
def _with_any(bound: DataFrame | None, found: DataFrame, scope: Scope, spec: Mapping) -> DataFrame:
    return _collected(bound, found, scope, spec, F.expr(spec["value"]), spec["with any"], "_node", True)


@block("with distinct", *_FROM, "value", kind="values")
def _with_distinct(bound: DataFrame | None, found: DataFrame, scope: Scope, spec: Mapping) -> DataFrame:
    """A binding for each distinct value."""
    var = spec["with distinct"]
    met = _candidates(bound, found, spec, "_node").withColumn(var, F.expr(spec["value"])).where(F.col(var).isNotNull()).drop("_node")
    ids = {f"_k{i}": F.col(f"{v}.id") for i, v in enumerate(scope.nodes)}
    return met.withColumns(ids).dropDuplicates([*ids, *scope.sets, *scope.values, var]).drop(*ids)


def _made(bound: DataFrame, scope: Scope, spec: Mapping, name: str, under: str | None, doc: Column | None) -> DataFrame:
    attrs = [x for k, v in sorted(spec.get("attrs", {}).items()) for x in (F.lit(k), F.expr(v).cast("string"))]
    refs = [F.col(f"{v}.id") for v in scope.nodes]
    value, ord_ = (F.expr(spec[k]) if k in spec else None for k in ("value", "ord"))
    filled = F.map_filter(F.create_map(*attrs), lambda _, v: v.isNotNull()) if attrs else None
    out = rules.inserted(bound, scope.key(), refs or [F.lit("")], [F.col(f"{v}.doc") for v in scope.nodes] or [F.lit("")], None, name, filled, value, ord_, doc, under)
    if scope.sets:
        held = bound.select(scope.key().alias("key"), F.flatten(F.array(*scope.sets)).alias("_held"))
        out = out.join(held, "key").withColumn("refs", F.array_union("refs", "_held")).drop("_held")
    return out


@block("insert", "attrs", "value", "ord", "under", binds=False)
def _insert(bound: DataFrame, scope: Scope, spec: Mapping) -> DataFrame:
    under = spec.get("under", scope.target)
    if under is None:
        raise ValueError(f"{scope.rule}: no block is a target")
    return _made(bound, scope, spec, spec["insert"], under, None)


@block("create-doc", "root", "attrs", "value", binds=False)
def _create(bound: DataFrame, scope: Scope, spec: Mapping) -> DataFrame:
    """A document with its root; by default it is named by the key."""
    name = F.expr(spec["create-doc"]) if spec["create-doc"] else F.lit(None).cast("string")
    return _made(bound, scope, spec, spec.get("root", "root"), None, rules.document_name(name, scope.key()))


@block("sort", "by", "direction", binds=False)
def _sort(bound: DataFrame, scope: Scope, spec: Mapping) -> DataFrame:
    raise ValueError("a sort inserts nothing")


def _typed(spec: Mapping, rule: str) -> BlockType:
    kinds = [k for k in spec if k in BLOCKS]
    if len(kinds) != 1:
        raise ValueError(f"{rule}: a block has one type, of {', '.join(sorted(BLOCKS))}; found {sorted(spec)}")
    kind = BLOCKS[kinds[0]]
    illegal = spec.keys() - kind.allowed - {kind.name}
    if illegal:
        raise ValueError(f"{rule}: {kind.name} takes no {', '.join(sorted(illegal))}")
    return kind


def stages(spec: Mapping) -> list[str]:
    """A digest of each block: equal data, equal digest, in whatever order a mapping's entries are."""
    return [hashlib.md5(json.dumps(b, sort_keys=True).encode()).hexdigest()[:12] for b in spec["blocks"]]


def compiled(spec: Mapping) -> rules.Rule | rules.Sort:
    """A rule, or a sort, from its data; a block of no known type, with an attribute that its type doesn't take, that binds
    a variable again, or in a wrong place is an error here, not at run time."""
    id_, given = spec["id"], list(spec["blocks"])
    typed = [(_typed(b, id_), b) for b in given]
    if not typed or typed[-1][0].binds or any(not t.binds for t, _ in typed[:-1]):
        raise ValueError(f"{id_}: blocks that bind come first, one that creates, inserts or sorts comes last")
    scopes, scope = [], Scope(id_)
    for t, b in typed[:-1]:
        scopes.append(Scope(id_, list(scope.nodes), list(scope.sets), list(scope.values), scope.target))
        if b[t.name] in scope.names():
            raise ValueError(f"{id_}: cannot bind {b[t.name]} again")
        getattr(scope, t.kind).append(b[t.name])
        if b.get("target"):
            scope.target = b[t.name]
    last, output = typed[-1]
    marks = stages(spec)
    fors = [rules.For(b[t.name], b.get("name"), _binder(t, b, s), bool(b.get("target"))) for (t, b), s in zip(typed[:-1], scopes, strict=True)]
    if last.name == "sort":
        if not all(t.grows for t, _ in typed[:-1]):
            raise ValueError(f"{id_}: sorts are bound by for each")
        return rules.Sort(id_, tuple(fors), F.expr(output["by"]), output.get("direction") == "descending")
    out = lambda bound: last.run(bound, scope, output)
    reads = frozenset() if any(b.get("name") is None for _, b in typed[:-1]) else frozenset(b["name"] for _, b in typed[:-1])
    if all(t.grows for t, _ in typed[:-1]):
        if last.name == "insert":
            _target(scope, output)
        return rules.Rule(id_, lambda nodes: out(rules._chain(fors, nodes)), reads, ".".join(marks), tuple(fors), out)

    def whole(nodes: DataFrame) -> DataFrame:
        bound = None
        for (t, b), f in zip(typed[:-1], fors, strict=True):
            bound = f.bind(bound, each(nodes, b[t.name] if t.kind == "nodes" else "_node", b.get("name")))
        return out(bound)

    return rules.Rule(id_, whole, reads, ".".join(marks))


def _target(scope: Scope, output: Mapping) -> None:
    if output.get("under", scope.target) not in scope.nodes:
        raise ValueError(f"{scope.rule}: no block is a target")


def _binder(kind: BlockType, spec: Mapping, scope: Scope) -> Callable[[DataFrame | None, DataFrame], DataFrame]:
    return lambda bound, found: kind.run(bound, found, scope, spec)


def compile_all(specs: Sequence[Mapping]) -> tuple[list[rules.Rule], list[rules.Sort]]:
    made = [compiled(s) for s in specs]
    return [m for m in made if isinstance(m, rules.Rule)], [m for m in made if isinstance(m, rules.Sort)]


def run(base: DataFrame, specs: Sequence[Mapping], unique: bool = False) -> rules.State:
    """Rules to a fixpoint, then sorts, until nothing moves."""
    made, sorts = compile_all(specs)
    return rules.settle(rules.run(rules.start(base, unique), made), sorts, made)


def update(state: rules.State, specs: Sequence[Mapping], removed: DataFrame, added: DataFrame) -> rules.State:
    made, sorts = compile_all(specs)
    return rules.settle(rules.update(state, made, removed, added), sorts, made)
