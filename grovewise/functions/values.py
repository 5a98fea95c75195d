"""Values of sequences: comparison, truth, casts by type name, names with prefixes, acronyms. All are Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OPERATORS = ("=", "!=", "<", "<=", ">", ">=")


def number(x: Column) -> Column:
    """A value's number, null where it has none."""
    return F.expr("cast(null as double)") if x is None else F.when(F.trim(x.cast("string")).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), x.cast("string").try_cast("double"))


def general_comparison(a: Column, op: str, b: Column, numeric: bool = False) -> Column:
    """Is there a pair, one item of each array, that compares so? False where either is empty or null.

    ``numeric``: one side holds numbers, so the other's strings are read as numbers; one that isn't a number equals
    nothing and differs from everything. ``!=`` isn't the opposite of ``=``. Takes one pass over each array: an order
    holds for some pair if it holds for the extremes.
    """
    if op not in OPERATORS:
        raise ValueError(f"unknown comparison {op!r}; known: {', '.join(OPERATORS)}")
    both = (F.size(a) > 0) & (F.size(b) > 0)
    x, y = (F.transform(s, number) if numeric else s for s in (a, b))
    strange = F.exists(x, lambda v: v.isNull()) | F.exists(y, lambda v: v.isNull())
    x, y = (F.filter(s, lambda v: v.isNotNull()) for s in (x, y))
    holds = {
        "=": lambda: F.arrays_overlap(x, y),
        "!=": lambda: strange | (F.size(F.array_distinct(F.concat(x, y))) > 1),
        "<": lambda: F.array_min(x) < F.array_max(y),
        "<=": lambda: F.array_min(x) <= F.array_max(y),
        ">": lambda: F.array_max(x) > F.array_min(y),
        ">=": lambda: F.array_max(x) >= F.array_min(y),
    }[op]()
    return F.coalesce(both & F.coalesce(holds, F.lit(False)), F.lit(False))


def effective_boolean(kind: Column, value: Column, n: Column) -> Column:
    """The truth of a sequence from its number of items and its first item's kind (node, boolean, string or number) and
    value as text: empty ones are false, those that begin with a node true, a single value by its kind; several items
    that begin with a value have none, which is an error."""
    zero = F.coalesce(number(value), F.lit(0.0)) == 0
    single = F.when(kind == "boolean", F.lower(value) == "true").when(kind == "string", F.length(value) > 0).when(kind == "number", ~zero)
    known = F.when(kind == "node", F.lit(True)).when(n == 1, single)
    return F.when(F.coalesce(n, F.lit(0)) == 0, F.lit(False)).when(known.isNotNull(), known).otherwise(F.raise_error(F.lit("FORG0006: the sequence has no effective boolean value")).cast("boolean"))


#: How a text becomes a value of a type: its pattern and its Spark type.
TYPES = {
    "xs:integer": (r"^[+-]?\d+$", "long"), "xs:decimal": (r"^[+-]?(\d+\.?\d*|\.\d+)$", "decimal(38,10)"), "xs:double": (r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$", "double"),
    "xs:boolean": (r"^(true|false|1|0)$", "boolean"), "xs:dateTime": (r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?$", "timestamp_ntz"), "xs:date": (r"^\d{4}-\d\d-\d\d$", "date"), "xs:string": (r"(?s)^.*$", "string"),
}


def castable(x: Column, type_: str) -> Column:
    """Does the text stand for a value of the type? False for null."""
    text = x.cast("string") if type_ == "xs:string" else F.trim(x.cast("string"))
    return F.coalesce(text.rlike(TYPES[type_][0]) & text.try_cast(TYPES[type_][1]).isNotNull(), F.lit(False))


def cast_as(x: Column, type_: str) -> Column:
    """The value of the type that the text stands for: null stays null, other texts are errors."""
    text = x.cast("string") if type_ == "xs:string" else F.trim(x.cast("string"))
    failed = F.raise_error(F.concat(F.lit("FORG0001: not a value of "), F.lit(type_), F.lit(": "), text)).cast(TYPES[type_][1])
    return F.when(x.isNull(), F.lit(None).cast(TYPES[type_][1])).when(castable(x, type_), text.try_cast(TYPES[type_][1])).otherwise(failed)


def constructor(type_: str):
    """The constructor of a type whose name is known at run time only."""
    if type_ not in TYPES:
        raise ValueError(f"unknown type {type_!r}; known: {', '.join(TYPES)}")
    return lambda x: cast_as(x, type_)


def expanded_name(name: Column, prefixes: Column, default: str = "") -> Column:
    """(ns, local) of a name: its prefix by the map of prefixes, an unknown prefix being an error."""
    prefixed = F.instr(name, ":") > 0
    prefix = F.substring_index(name, ":", 1)
    unknown = F.raise_error(F.concat(F.lit("XPST0081: no namespace for prefix "), prefix)).cast("string")
    uri = F.coalesce(F.try_element_at(prefixes, prefix), unknown)
    none = F.coalesce(F.try_element_at(prefixes, F.lit("")), F.lit(default))
    return F.struct(F.when(prefixed, uri).otherwise(none).alias("ns"), F.when(prefixed, F.substring_index(name, ":", -1)).otherwise(name).alias("local"))


def acronym(name: Column) -> Column:
    """A short lower-case form: the first letters of the parts between ``-``, ``_``, space and ``.``; of a single part its
    first letter and up to three capitals after it or, without capitals, its first three letters."""
    parts = F.filter(F.split(name, "[-_ .]+"), lambda p: p != "")
    firsts = F.array_join(F.filter(F.transform(parts, lambda p: F.lower(F.left(p, F.lit(1)))), lambda c: c.rlike(r"^\p{L}$")), "")
    tail = F.regexp_extract(name, r"(?s)^\P{L}*\p{L}(.*)$", 1)
    first = F.lower(F.regexp_extract(name, r"\p{L}", 0))
    capitals = F.slice(F.regexp_extract_all(tail, F.lit(r"\p{Lu}"), F.lit(0)), 1, 3)
    letters = F.slice(F.regexp_extract_all(tail, F.lit(r"\p{L}"), F.lit(0)), 1, 2)
    single = F.concat(first, F.lower(F.array_join(F.when(F.size(capitals) > 0, capitals).otherwise(letters), "")))
    return F.when(F.size(parts) >= 2, firsts).otherwise(single)


def deep_equal(a: Column, b: Column) -> Column:
    """Equal items in equal order; empty equals empty, null counts as empty."""
    empty = lambda x: F.size(F.coalesce(x, F.array().cast("array<string>"))) == 0
    return F.when(empty(a) | empty(b), empty(a) & empty(b)).otherwise(a == b)


def integer_range(start: Column, end: Column) -> Column:
    """The integers from ``start`` to ``end`` as an array, empty where the end lies below the start or one is empty."""
    a, b = start.cast("long"), end.cast("long")
    return F.when(b >= a, F.sequence(a, b)).otherwise(F.array().cast("array<long>"))
