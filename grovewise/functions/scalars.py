"""Scalar, array, map and hash functions as Spark columns. All stay in the JVM."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- arithmetic: an empty (null) operand gives an empty result


def divide(a: Column, b: Column) -> Column:
    """IEEE division: by zero gives an infinity, or not-a-number for 0 / 0."""
    x, y = a.cast("double"), b.cast("double")
    limit = F.when(x > 0, F.lit(float("inf"))).when(x < 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))
    return F.when(x.isNull() | y.isNull(), F.lit(None).cast("double")).when(y == 0, limit).otherwise(x / F.nullif(y, F.lit(0.0)))


def integer_divide(a: Column, b: Column) -> Column:
    """Truncated towards zero; by zero null."""
    q = a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))
    return F.when(q >= 0, F.floor(q)).otherwise(F.ceil(q))


def remainder(a: Column, b: Column) -> Column:
    """With the sign of the dividend; by zero null."""
    return a % F.nullif(b, F.lit(0))


def sign_run(signs: str, x: Column) -> Column:
    """A run of unary signs: an odd number of minuses negates."""
    return -x if signs.count("-") % 2 else x


# ---- strings


def capitalize(s: Column) -> Column:
    """Only the first character changes."""
    return F.concat(F.upper(F.left(s, F.lit(1))), F.substring(s, 2, 2147483647))


def escape_html(s: Column) -> Column:
    for c, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        s = F.replace(s, F.lit(c), F.lit(name))
    return s


def pluralize(s: Column, n: Column) -> Column:
    return F.when(n == 1, s).otherwise(F.concat(s, F.lit("s")))


def strip(s: Column) -> Column:
    """Without spaces, tabs and line ends at either side."""
    return F.btrim(s, F.lit(" \t\n\r"))


def truncate(s: Column, n: int, mark: str = "...") -> Column:
    return F.when(F.length(s) <= n, s).otherwise(F.concat(F.left(s, F.lit(n)), F.lit(mark)))


def expand(template: str, values: Mapping[str, Column]) -> Column:
    """``#{key}`` by its value; unknown keys stay. Values aren't expanded again."""
    out, rest = [], template
    while rest:
        before, mark, after = rest.partition("#{")
        key, close, tail = after.partition("}")
        if mark and close and key in values:
            out += [F.lit(before), values[key].cast("string")]
            rest = tail
        elif mark:
            out.append(F.lit(before + mark))
            rest = after
        else:
            out.append(F.lit(before))
            rest = ""
    return F.concat(*out) if out else F.lit("")


def cardinal(n: Column) -> Column:
    """Numbers up to ten in words."""
    # Fixed values.
    words = ("no", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten")
    return F.when((n >= 0) & (n <= 10), F.element_at(F.array(*map(F.lit, words)), (n + 1).cast("int"))).otherwise(n.cast("string"))


def substring_after(s: Column, part: str) -> Column:
    at = F.instr(s, part)
    return F.when(at > 0, F.substr(s, at + len(part))).otherwise("")


def sanitize_ascii(s: Column) -> Column:
    """Keys from texts: letters and digits stay, ``-`` doubles, any other character becomes ``-hex-``. ASCII only."""
    chars = F.filter(F.split(s, ""), lambda c: c != "")
    return F.array_join(F.transform(chars, lambda c: F.when(c.rlike("^[A-Za-z0-9]$"), c).when(c == "-", "--").otherwise(F.concat(F.lit("-"), F.lower(F.hex(F.ascii(c).cast("long"))), F.lit("-")))), "")


def sanitize_key(s: Column) -> Column:
    """As ``sanitize_ascii`` with letters and digits of any script, as the JVM's tables have them."""
    chars = F.filter(F.split(s, ""), lambda c: c != "")
    # A character's code point is that of its UTF-32 form.
    point = lambda c: F.regexp_replace(F.lower(F.hex(F.encode(c, "UTF-32"))), "^0*", "")
    return F.array_join(F.transform(chars, lambda c: F.when(c.rlike(r"^[\p{L}\p{N}]$"), c).when(c == "-", "--").otherwise(F.concat(F.lit("-"), point(c), F.lit("-")))), "")


# ---- hashes


def md5_base64(s: Column) -> Column:
    return F.base64(F.unhex(F.md5(s.cast("binary"))))


def hmac_md5(key: str) -> Callable[[Column], Column]:
    """The keyed digest as hex: two rounds of md5 over the padded key and the text."""
    k = key.encode()
    k = (hashlib.md5(k).digest() if len(k) > 64 else k).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in k)) for pad in (0x36, 0x5C))
    return lambda s: F.md5(F.concat(outer, F.unhex(F.md5(F.concat(inner, s.cast("binary"))))))


# ---- arrays


def index_of(a: Column, x: Column) -> Column:
    """0-based, -1 where it is missing."""
    return F.array_position(a, x) - 1


def detect(a: Column, holds: Callable[[Column], Column]) -> Column:
    """The first element that satisfies the predicate, or null."""
    return F.try_element_at(F.filter(a, holds), F.lit(1))


def last(a: Column) -> Column:
    return F.try_element_at(a, F.lit(-1))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def concat_map(a: Column, f: Callable[[Column], Column]) -> Column:
    return F.flatten(F.transform(a, f))


def commas(a: Column) -> Column:
    return F.array_join(a, ",")


# ---- maps


def merge(a: Column, b: Column) -> Column:
    """The entries of both; ``b`` wins."""
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.array_contains(F.map_keys(b), k)), b)


def compact_map(m: Column) -> Column:
    return F.map_filter(m, lambda _, v: v.isNotNull())


def query_string(m: Column) -> Column:
    pairs = F.transform(F.map_entries(m), lambda e: F.concat(F.url_encode(e["key"]), F.lit("="), F.url_encode(e["value"])))
    return F.array_join(F.array_sort(pairs), "&")
