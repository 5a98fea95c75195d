"""Functions by name: built-in and user-defined ones, their arity and the kinds of their arguments checked."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from grovewise.functions import scalars, values

KINDS = ("item", "node", "atom", "string", "number", "integer")
MANY = ("one", "optional", "sequence")


@dataclass(frozen=True)
class Param:
    """``kind`` of item and how many: ``one`` (null is an error), ``optional`` (null gives null) or ``sequence`` (an array).

    ``context``: use the context item where the argument is missing."""

    kind: str = "item"
    many: str = "one"
    context: bool = False

    def __post_init__(self) -> None:
        if self.kind not in KINDS or self.many not in MANY:
            raise ValueError(f"unknown parameter {self.kind} {self.many}")

    def checked(self, name: str, x: Column) -> Column:
        if self.many == "sequence":
            return x
        if self.kind in ("number", "integer"):
            pattern = r"^[+-]?\d+$" if self.kind == "integer" else r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
            bad = x.isNotNull() & ~x.cast("string").rlike(pattern)
            x = F.when(bad, F.raise_error(F.concat(F.lit(f"{name}: not a {self.kind}: "), x.cast("string"))).cast("double")).otherwise(x)
        if self.many == "one":
            x = F.when(x.isNull(), F.raise_error(F.lit(f"{name}: an argument is empty")).cast("string")).otherwise(x) if self.kind in ("string", "atom") else x
        return x


@dataclass
class Functions:
    """A registry; ``define`` adds a function of columns, ``call`` checks the arguments and applies it.

    A function may call others of the registry, itself too as long as what it is called with shrinks while the plan is
    built. A name has one function: there is no overloading.
    """

    known: dict[str, tuple[tuple[Param, ...], Callable[..., Column]]] = field(default_factory=dict)

    def define(self, name: str, params: Sequence[Param], body: Callable[..., Column]) -> None:
        if name in self.known:
            raise ValueError(f"function {name} is defined already")
        self.known[name] = (tuple(params), body)

    def call(self, name: str, *args: Column, context: Column | None = None) -> Column:
        if name not in self.known:
            raise ValueError(f"XPST0017: unknown function {name}")
        params, body = self.known[name]
        if len(args) == len(params) - 1 and params and params[-1].context and context is not None:
            args = (*args, context)
        if len(args) != len(params):
            raise ValueError(f"XPST0017: {name} takes {len(params)} arguments, not {len(args)}")
        return body(*[p.checked(name, a) for p, a in zip(params, args, strict=True)])

    def bound_names(self, names: Mapping[str, frozenset[str] | None], used: Sequence[str]) -> frozenset[str] | None:
        """What element names the functions used may read: the union of ``names``, None (any) if one of them is unbounded."""
        found = [names.get(u, frozenset()) for u in used]
        return None if any(f is None for f in found) else frozenset().union(*found)


def builtin() -> Functions:
    """The built-in functions of sequences (arrays) and values."""
    out, many, text = Functions(), Param("item", "sequence"), Param("string")
    some, num = Param("string", "optional", context=True), Param("number", "optional")
    for name, params, body in (
        ("count", [many], F.size), ("empty", [many], lambda s: F.size(s) == 0), ("exists", [many], lambda s: F.size(s) > 0), ("not", [Param("item", "optional")], lambda b: ~F.coalesce(b.cast("boolean"), F.lit(False))),
        ("distinct-values", [many], F.array_distinct), ("reverse", [many], F.reverse), ("index-of", [many, Param("atom")], lambda s, x: F.filter(F.transform(s, lambda v, i: F.when(v == x, i + 1)), lambda i: i.isNotNull())),
        ("subsequence", [many, num, num], lambda s, a, n: F.slice(s, a.cast("int"), n.cast("int"))), ("deep-equal", [many, many], values.deep_equal), ("string-join", [many, text], lambda s, x: F.call_function("array_join", s, x)),
        ("max", [many], lambda s: F.array_max(F.transform(s, values.number))), ("min", [many], lambda s: F.array_min(F.transform(s, values.number))), ("sum", [many], lambda s: scalars.total(F.transform(s, values.number))),
        ("string-length", [some], F.length), ("normalize-space", [some], lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), ("upper-case", [some], F.upper), ("lower-case", [some], F.lower),
        ("concat", [text, text], F.concat), ("contains", [text, text], lambda a, b: a.contains(b)), ("starts-with", [text, text], lambda a, b: a.startswith(b)), ("number", [some], values.number), ("boolean", [some], lambda x: F.length(x) > 0),
    ):
        out.define(name, params, body)
    return out
