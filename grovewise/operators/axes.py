"""Steps along axes, predicates and positions over bindings.

A binding is a row; a node-valued variable is a struct column of it. A step joins the variable to the forest and adds
the nodes reached as another variable, so a path is a chain of joins that Catalyst reorders and prunes. A node is known by
its document and its id: documents may use the same ids.

Where the forest has the labels of ``intervals.labelled``, descendants, ancestors and what follows or precedes are found
by intervals, in work that doesn't grow with depth; else by the ids and positions that each node carries.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grovewise.operators.intervals import LABELS, structural_step
from grovewise.operators.ordering import ranked_order
from grovewise.sources.forest import FIELDS

AXES = (
    "self", "child", "parent", "descendant", "descendant-or-self", "ancestor", "ancestor-or-self",
    "following-sibling", "preceding-sibling", "following", "preceding", "attribute",
)


def named(nodes: DataFrame, name: str | None) -> DataFrame:
    """The name test of every axis: a name, ``*`` for elements of any name, None for nodes of every kind."""
    return nodes if name is None else nodes.where("kind = 'element'") if name == "*" else nodes.where(F.col("name") == name)


def _fields(nodes: DataFrame) -> list[str]:
    return [*FIELDS, *(c for c in LABELS if c in nodes.columns)]


def _as(nodes: DataFrame, var: str, name: str | None, *extra: Column) -> DataFrame:
    return named(nodes, name).select(F.struct(*_fields(nodes)).alias(var), *extra)


def each(nodes: DataFrame, var: str, name: str | None = None, roots: bool = False) -> DataFrame:
    """All nodes that pass a name test, or the roots only, as variable ``var``."""
    return _as(nodes.where(F.col("parent_id").isNull()) if roots else nodes, var, name)


def step(bound: DataFrame, nodes: DataFrame, origin: str, axis: str, name: str | None = None, into: str = "node", outer: bool = False) -> DataFrame:
    """Bindings extended by each node that ``axis`` leads to from variable ``origin``; ``outer`` keeps those without.

    An attribute of a name is its value, ``*`` or None a struct (name, value) for each.
    """
    if axis not in AXES:
        raise ValueError(f"unknown axis {axis!r}; known: {', '.join(AXES)}")
    how = "left" if outer else "inner"
    at = F.col(origin)

    def joined(rows: DataFrame, reached: DataFrame, key: Column, more: Column | None = None) -> DataFrame:
        on = (at["doc"] == F.col("_doc")) & (key == F.col("_key"))
        return rows.join(reached, on if more is None else on & more, how).drop("_doc", "_key")

    def keyed(key: Column, *extra: Column) -> DataFrame:
        return _as(nodes, into, name, F.col("doc").alias("_doc"), key.alias("_key"), *extra)

    if axis == "self":
        passes = F.lit(True) if name is None else at["kind"] == "element" if name == "*" else at["name"] == name
        return bound.withColumn(into, F.when(passes, at)) if outer else bound.where(passes).withColumn(into, at)
    if axis == "attribute":
        if name in (None, "*"):
            pairs = F.transform(F.array_sort(F.map_entries(at["attrs"])), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value")))
            return bound.withColumn(into, (F.explode_outer if outer else F.explode)(pairs))
        found = bound.withColumn(into, F.element_at(at["attrs"], name))
        return found if outer else found.where(F.col(into).isNotNull())
    if axis == "child":
        return joined(bound, keyed(F.col("parent_id")), at["id"])
    if axis == "parent":
        return joined(bound, keyed(F.col("id")), at["parent_id"])
    if axis.endswith("-sibling"):
        later = F.col("_ord") > at["ord"] if axis == "following-sibling" else F.col("_ord") < at["ord"]
        return joined(bound, keyed(F.col("parent_id"), F.col("ord").alias("_ord")), at["parent_id"], later).drop("_ord")
    if all(c in nodes.columns for c in LABELS):
        return structural_step(bound, _as(nodes, into, name), origin, axis, into, outer)
    if axis in ("descendant", "descendant-or-self"):
        above = F.col("path") if axis.endswith("self") else F.slice("path", 1, F.size("path") - 1)
        return joined(bound, keyed(F.explode(above)), at["id"])
    if axis in ("ancestor", "ancestor-or-self"):
        above = at["path"] if axis.endswith("self") else F.slice(at["path"], 1, F.size(at["path"]) - 1)
        return joined(bound.withColumn("_up", (F.explode_outer if outer else F.explode)(above)), keyed(F.col("id")), F.col("_up")).drop("_up")
    # What follows a node: its ancestors' following siblings, its own, and all that they contain.
    up = step(bound, nodes, origin, "ancestor-or-self", None, "_anc")
    side = step(up, nodes, "_anc", f"{axis}-sibling", None, "_side")
    return step(side, nodes, "_side", "descendant-or-self", name, into).drop("_anc", "_side")


def attr(var: str, name: str) -> Column:
    """An attribute's value, null where the node has none."""
    return F.element_at(F.col(var)["attrs"], name)


def distinct_nodes(bound: DataFrame, var: str, *keys: str) -> DataFrame:
    """One row for each node of ``var`` (and each value of ``keys``): a path's result has no duplicates."""
    ids = [F.col(f"{var}.doc").alias("_doc"), F.col(f"{var}.id").alias("_id"), *[F.col(k) for k in keys]]
    return bound.select(var, *ids).dropDuplicates(["_doc", "_id", *keys]).drop("_doc", "_id")


def in_document_order(bound: DataFrame, var: str) -> DataFrame:
    """Sorted by document order: only for output, since every later operator is free to reorder."""
    return bound.orderBy(f"{var}.doc", f"{var}.pos")


def numbered(bound: DataFrame, var: str, per: Sequence[str], reverse: bool = False, into: str = "position", last: str | None = None) -> DataFrame:
    """The 1-based position of ``var`` among the bindings that agree in ``per``, from the end for reverse axes.

    ``last`` also adds their number. Chained predicates number again after each filter.
    """
    order = [F.col(f"{var}.doc"), F.col(f"{var}.pos")]
    w = Window.partitionBy(*per).orderBy(*[c.desc() if reverse else c.asc() for c in order])
    out = bound.withColumn(into, F.row_number().over(w))
    return out.withColumn(last, F.count(F.lit(1)).over(Window.partitionBy(*per))) if last else out


def exists(bound: DataFrame, other: DataFrame, on: Column | Sequence[str]) -> DataFrame:
    """Bindings with a partner: existential predicates are semi-joins, never joins that multiply."""
    return bound.join(other, on, "left_semi")


def lacks(bound: DataFrame, other: DataFrame, on: Column | Sequence[str]) -> DataFrame:
    return bound.join(other, on, "left_anti")


def general(bound: DataFrame, left: DataFrame, right: DataFrame, key: str, value: str, op: str) -> DataFrame:
    """Bindings for which some item of ``left`` (key, value) and some of ``right`` compare by ``op``: existential over both
    sequences. ``=`` is a semi-join on the value; orders hold if they hold for the extremes, and items differ unless all
    are one, so these need a minimum and a maximum for each binding. Nothing holds where a side is empty."""
    if op == "=":
        hit = left.join(right.select(key, value), [key, value], "left_semi").select(key).distinct()
        return bound.join(hit, key, "left_semi")
    ends = lambda rows, low, high: rows.groupBy(key).agg(F.min(value).alias(low), F.max(value).alias(high))
    holds = {
        "!=": "not (_a = _b and _c = _d and _a = _c)", "<": "_a < _d", "<=": "_a <= _d", ">": "_b > _c", ">=": "_b >= _c",
    }[op]
    found = ends(left.where(F.col(value).isNotNull()), "_a", "_b").join(ends(right.where(F.col(value).isNotNull()), "_c", "_d"), key).where(holds)
    return bound.join(found.select(key), key, "left_semi")


def every(bound: DataFrame, other: DataFrame, on: Column, holds: Column) -> DataFrame:
    """Bindings all of whose partners satisfy ``holds`` (null counts as false); those without partners do, too."""
    return bound.join(other.where(~F.coalesce(holds, F.lit(False))), on, "left_anti")


def document_rank(nodes: DataFrame) -> DataFrame:
    """Each node's 0-based place in its document. Nodes are ranked within ranges of (document, position), so a document
    that holds a large part of all nodes is dealt to many tasks."""
    return ranked_order(nodes, "doc", [F.col("pos")], "id", "rank").withColumn("rank", F.col("rank") - 1)


def later_in_document(nodes: DataFrame, into: str = "n_later") -> DataFrame:
    """How many nodes of its document follow each node: from its rank and the document's size, without comparing pairs."""
    sizes = nodes.groupBy("doc").agg(F.count(F.lit(1)).alias("_size"))
    return document_rank(nodes).join(sizes, "doc").withColumn(into, F.col("_size") - 1 - F.col("rank")).drop("_size", "rank")


def nearest(bound: DataFrame, nodes: DataFrame, origin: str, attribute: str, into: str = "found") -> DataFrame:
    """The nearest ancestor-or-self with an attribute: the deepest one of the path."""
    # Only ids and paths meet the nodes, since very many lie below one; bindings themselves are joined by their own id.
    held = nodes.where(F.element_at("attrs", attribute).isNotNull())
    own = bound.select(F.col(f"{origin}.doc").alias("_doc"), F.col(f"{origin}.id").alias("_id"), F.col(f"{origin}.path").alias("_path"))
    up = own.select("_doc", "_id", "_path", F.posexplode("_path").alias("_depth", "_up"))
    holders = held.select(F.col("doc").alias("_doc"), F.col("id").alias("_up"))
    deepest = up.join(holders, ["_doc", "_up"], "left_semi").groupBy("_doc", "_id", "_path").agg(F.max("_depth").alias("_depth"))
    known = _as(held, into, None, F.col("doc").alias("_doc"), F.col("id").alias("_up"))
    best = deepest.select("_doc", "_id", F.get("_path", F.col("_depth")).alias("_up")).join(known, ["_doc", "_up"]).select("_doc", "_id", into)
    return bound.join(best, (F.col(f"{origin}.doc") == F.col("_doc")) & (F.col(f"{origin}.id") == F.col("_id"))).drop("_doc", "_id")


def root(bound: DataFrame, nodes: DataFrame, origin: str, into: str = "root") -> DataFrame:
    """The root of the tree that a node lies in: where its path begins."""
    tops = _as(nodes.where(F.col("parent_id").isNull()), into, None, F.col("doc").alias("_doc"), F.col("id").alias("_key"))
    return bound.join(tops, (F.col(f"{origin}.doc") == F.col("_doc")) & (F.element_at(F.col(f"{origin}.path"), 1) == F.col("_key"))).drop("_doc", "_key")


def documents(nodes: DataFrame) -> DataFrame:
    """(doc) of all documents that are there."""
    return nodes.select("doc").distinct()


def doc_available(bound: DataFrame, nodes: DataFrame, doc: Column, into: str = "available") -> DataFrame:
    """Bindings with whether the document that ``doc`` names is there; a null name names none."""
    there = documents(nodes).select(F.col("doc").alias("_there"))
    return bound.withColumn("_doc", doc).join(there, F.col("_doc") == F.col("_there"), "left").withColumn(into, F.col("_there").isNotNull()).drop("_doc", "_there")


def opened(bound: DataFrame, nodes: DataFrame, doc: Column, into: str = "root", name: str | None = None, outer: bool = False) -> DataFrame:
    """Bindings extended by the roots of the document that ``doc`` names; ``outer`` keeps those whose document is gone."""
    tops = _as(nodes.where(F.col("parent_id").isNull()), into, name, F.col("doc").alias("_of"))
    return bound.withColumn("_doc", doc).join(tops, F.col("_doc") == F.col("_of"), "left" if outer else "inner").drop("_doc", "_of")
