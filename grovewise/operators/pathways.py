"""Paths as values: chains of steps that are checked when they are built and know what they read.

    customers = path().child("nation").child("customer").where(lambda c: c["attrs"]["segment"] == "BUILDING")
    orders = customers.child("order").at(-1)
    orders.bind(each(forest, "r", "region"), forest, "r", "o")

A path is the chain of joins of ``axes.step``, so predicates are ordinary columns that Spark pushes below the joins. What
a path yields follows from its steps: nodes or atoms, at most one or several, in one derivation or not; duplicates are
only removed where a node can be reached twice. What it reads, names of elements and attributes, tells a rule when it has
to run again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovewise.operators import axes
from grovewise.operators.intervals import numbered_rows

DOWN = ("self", "child", "attribute")
REVERSE = ("parent", "ancestor", "ancestor-or-self", "preceding", "preceding-sibling")


@dataclass(frozen=True)
class Step:
    axis: str
    name: str | None
    #: Filters in their order: a function of the node's column, a path that must lead somewhere, or a position.
    filters: tuple[Callable[[Column], Column] | Path | int, ...] = ()
    #: Positions count within each parent, as for ``//name``, not within each node that the step starts from.
    by_parent: bool = False


@dataclass(frozen=True)
class Path:
    steps: tuple[Step, ...] = ()
    #: Names of attributes that its filters look at, where they say so.
    attributes: frozenset[str] = field(default_factory=frozenset)

    def step(self, axis: str, name: str | None = "*", by_parent: bool = False) -> Path:
        if axis not in axes.AXES:
            raise ValueError(f"unknown axis {axis!r}; known: {', '.join(axes.AXES)}")
        if not self.nodes:
            raise TypeError(f"XPTY0019: {axis}::{name} starts from attribute values, which aren't nodes")
        return replace(self, steps=(*self.steps, Step(axis, name, (), by_parent)))

    def child(self, name: str | None = "*") -> Path:
        return self.step("child", name)

    def parent(self, name: str | None = "*") -> Path:
        return self.step("parent", name)

    def descendant(self, name: str | None = "*") -> Path:
        return self.step("descendant", name)

    def anywhere(self, name: str | None = "*") -> Path:
        """``//name``: descendants, whose positions count within their parents."""
        return self.step("descendant", name, True)

    def ancestor(self, name: str | None = "*") -> Path:
        return self.step("ancestor", name)

    def attribute(self, name: str) -> Path:
        return self.step("attribute", name)

    def _filtered(self, item: Callable | Path | int) -> Path:
        if not self.steps:
            raise ValueError("a filter follows a step")
        last = self.steps[-1]
        return replace(self, steps=(*self.steps[:-1], replace(last, filters=(*last.filters, item))))

    def where(self, test: Callable[[Column], Column] | Path, *attributes: str) -> Path:
        """Only what ``test`` holds for, or from where a path leads somewhere; ``attributes``: what a function looks at."""
        if isinstance(test, Path) and not test.steps:
            raise ValueError("a path that is a filter has steps")
        inner = test.attributes if isinstance(test, Path) else frozenset()
        return replace(self._filtered(test), attributes=self.attributes | inner | frozenset(attributes))

    def at(self, position: int) -> Path:
        """The node at a position from 1, or from the end for -1, -2 ..; on reverse axes the nearest is the first. It counts
        what earlier filters have left."""
        if not position or self.steps and self.steps[-1].axis == "attribute":
            raise ValueError("positions of nodes start from 1, or from -1 at the end")
        return self._filtered(position)

    @property
    def nodes(self) -> bool:
        """Whether it yields nodes; attribute values are atoms."""
        return not self.steps or self.steps[-1].axis != "attribute"

    @property
    def single(self) -> bool:
        """Whether it leads to one item at most from each node."""
        return all(s.axis in ("self", "parent") or s.axis == "attribute" and s.name != "*" or (any(isinstance(f, int) for f in s.filters) and not s.by_parent) for s in self.steps)

    @property
    def distinct(self) -> bool:
        """Whether no node can be reached twice: known from the steps alone."""
        one, apart = True, True  # at most one node so far; none of the nodes so far lies in another
        for s in self.steps:
            if not one and not (s.axis in DOWN or s.axis.startswith("descendant") and apart):
                return False
            apart = apart and s.axis in DOWN or one and s.axis == "parent"
            one = one and replace(self, steps=(s,)).single
        return True

    @property
    def reads(self) -> tuple[frozenset[str] | None, frozenset[str]]:
        """Names of the elements that it can pass, None for any, and of the attributes that it looks at."""
        names: set[str] | None = set()
        looked = set(self.attributes)
        for s in self.steps:
            if s.axis == "attribute":
                looked.add(s.name or "*")
            elif names is not None:
                names = None if s.name in (None, "*") or s.axis in ("following", "preceding") else names | {s.name}
            for f in s.filters:
                if isinstance(f, Path):
                    inner, more = f.reads
                    names = None if names is None or inner is None else names | inner
                    looked |= more
        return None if names is None else frozenset(names), frozenset(looked)

    def bind(self, bound: DataFrame, nodes: DataFrame, origin: str, into: str) -> DataFrame:
        """Bindings extended by what the path leads to from ``origin``, as ``into``, each node once for a binding."""
        if not self.steps:
            return bound.withColumn(into, F.col(origin))
        counts = any(isinstance(f, int) for s in self.steps for f in s.filters)
        now = numbered_rows(bound, "_of") if counts or not self.distinct else bound
        at = origin
        for i, s in enumerate(self.steps):
            to = into if i == len(self.steps) - 1 else f"_step{i}"
            now = axes.step(now, nodes, at, s.axis, s.name, to)
            for f in s.filters:
                if isinstance(f, Path):
                    keyed = numbered_rows(now, "_at")
                    now = keyed.join(f.bind(keyed.select("_at", to), nodes, to, "_found").select("_at"), "_at", "left_semi").drop("_at")
                elif isinstance(f, int):
                    # One context is a node that the step starts from, of one binding.
                    start = [F.col(f"{at}.doc"), F.col(f"{at}.id")]
                    per = {"_p0": start[0], "_p1": F.col(f"{to}.parent_id") if s.by_parent else start[1]}
                    away = (f < 0) != (s.axis in REVERSE)
                    now = axes.numbered(now.withColumns(per), to, ["_of", *per], away, "_position").where(F.col("_position") == abs(f)).drop("_position", *per)
                else:
                    now = now.where(f(F.col(to)))
            if at != origin:
                now = now.drop(at)
            at = to
        if not self.distinct and self.nodes:
            now = now.withColumns({"_d": F.col(f"{into}.doc"), "_i": F.col(f"{into}.id")}).dropDuplicates(["_of", "_d", "_i"]).drop("_d", "_i")
        return now.drop("_of")


def path() -> Path:
    return Path()


def union(bound: DataFrame, nodes: DataFrame, origin: str, into: str, *paths: Path) -> DataFrame:
    """Nodes that any of the paths leads to, each once for a binding; nodes and atoms don't mix."""
    if len({p.nodes for p in paths}) != 1:
        raise TypeError("XPTY0018: a path yields nodes or atoms, not both")
    rows = numbered_rows(bound, "_each")
    out = None
    for p in paths:
        found = p.bind(rows, nodes, origin, into)
        out = found if out is None else out.unionByName(found)
    if not paths[0].nodes:
        return out.drop("_each")
    return out.withColumns({"_d": F.col(f"{into}.doc"), "_i": F.col(f"{into}.id")}).dropDuplicates(["_each", "_d", "_i"]).drop("_d", "_i", "_each")
