"""Sharding: best-fit-decreasing packing of indivisible groups (rows of equal text) into shards of one capacity.

Groups of one size are interchangeable, so the packing runs on the histogram of group sizes: all groups of a size enter
the tightest bin together as long as they fit, which is what entering one by one would do. Only the histogram reaches the
driver: exact sizes as long as there are at most CLASSES different ones. Beyond that, which takes more than 60 GB in groups above
64 KB, sizes enter with 16 significant bits, rounded up, at most 1 / 32768 too large: at most 2**16 + 2**15 * 47 classes
however many groups there are, and no bin filled above its capacity. Runs of groups go back to the rows by their rank
within the size, counted in two levels so that a size of very many groups doesn't meet in one task.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grovewise.llm.common import buckets_for, stored

CLASSES = 1 << 20  # different sizes that the driver packs exactly
EXACT_BITS = 16
Run = tuple[int, int, int, int]  # size class, first rank, end rank, bin


class BinTree:
    """Bins by remaining capacity in an AVL-free balanced tree: a treap whose priorities are a hash of the bin."""

    def __init__(self) -> None:
        self.root: list | None = None  # [key, priority, left, right]

    @staticmethod
    def _priority(key: tuple[int, int]) -> int:
        return (key[1] * 0x9E3779B97F4A7C15 + key[0] * 0xC2B2AE3D27D4EB4F) & (2**64 - 1)

    def _split(self, node: list | None, key: tuple[int, int]) -> tuple[list | None, list | None]:
        """Below ``key``, and the rest."""
        if node is None:
            return None, None
        if node[0] < key:
            node[3], rest = self._split(node[3], key)
            return node, rest
        less, node[2] = self._split(node[2], key)
        return less, node

    def _merge(self, a: list | None, b: list | None) -> list | None:
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b

    def add(self, remaining: int, bin_: int) -> None:
        key = (remaining, bin_)
        less, more = self._split(self.root, key)
        self.root = self._merge(self._merge(less, [key, self._priority(key), None, None]), more)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return the bin of least remaining capacity that is ``size`` at least."""
        node, found = self.root, None
        while node is not None:
            if node[0] >= (size, -1):
                found, node = node[0], node[2]
            else:
                node = node[3]
        if found is not None:
            less, rest = self._split(self.root, found)
            _, more = self._split(rest, (found[0], found[1] + 1))
            self.root = self._merge(less, more)
        return found


def best_fit_decreasing(sizes: Iterable[tuple[int, int]], capacity: int, bins: int | None = None) -> list[Run] | None:
    """Pack (size, count) pairs into bins of ``capacity``; new bins open as needed, or None where ``bins`` don't do.

    A size above the capacity gets bins of its own, one for each group.
    """
    tree, opened, runs = BinTree(), 0, []
    for size, count in sorted(sizes, reverse=True):
        rank = 0
        while rank < count:
            found = tree.take_tightest(size)
            if found is None:
                if bins is not None and opened >= bins:
                    return None
                found, opened = (max(capacity, size), opened), opened + 1
            n = min(count - rank, found[0] // max(size, 1)) if size else count - rank
            runs.append((size, rank, rank + n, found[1]))
            tree.add(found[0] - n * size, found[1])
            rank += n
    return runs


def even_capacity(sizes: list[tuple[int, int]], bins: int) -> list[Run]:
    """Best fit decreasing into exactly ``bins`` bins of the least capacity that a bisection finds to hold all.

    Groups larger than an even share take a bin each, first; the others share the remaining bins. The bisection ends at
    a byte, or at a millionth of the capacity; as best fit may fail above a capacity at which it does, no search short
    of trying all finds the very least.
    """
    left, own, runs = sorted(sizes, reverse=True), 0, []
    while left and own < bins - 1:
        total = sum(s * c for s, c in left)
        size, count = left[0]
        if size * (bins - own) <= total:
            break
        taken = sum(r[0] == size for r in runs)
        runs.append((size, taken, taken + 1, own))
        own += 1
        left = ([(size, count - 1)] if count > 1 else []) + left[1:]
    skipped = {size: sum(1 for r in runs if r[0] == size) for size, *_ in runs}
    total, n = sum(s * c for s, c in left), bins - own
    low = max([-(-total // n), *(s for s, _ in left[:1])])
    slack, found, high = 0, None, low
    while found is None:  # least power-of-two slack that does, then halve
        high = low + slack
        found = best_fit_decreasing(left, high, n)
        slack = slack * 2 or max(1, low >> 14)
    floor = low - 1
    while high - floor > max(1, high >> 20):
        middle = (floor + high) // 2
        if closer := best_fit_decreasing(left, middle, n):
            found, high = closer, middle
        else:
            floor = middle
    return runs + [(s, a + skipped.get(s, 0), b + skipped.get(s, 0), bin_ + own) for s, a, b, bin_ in found]


def _class(size):
    """The size itself up to EXACT_BITS bits, else rounded up to so many significant bits."""
    bits = F.greatest(F.length(F.bin(size)) - EXACT_BITS, F.lit(0))
    unit = F.pow(F.lit(2.0), bits).cast("long")
    return (F.floor((size + unit - 1) / unit) * unit).cast("long")


def shard_documents(docs: DataFrame, shards: int | None = 24, capacity: int | None = None) -> DataFrame:
    """Rows (doc_id, size, text_crc32, shard, slot) of ``docs``: equal texts share a shard.

    With ``shards``, all bins exist and the capacity is the least that bisection finds (``even_capacity``); with ``capacity``, as few bins as best fit
    needs; its bins and runs are the driver's, so it is for thousands of bins, not millions. Size is the UTF-8 bytes of the text plus 8. Null texts form one group of size 8 each row, apart from empty
    texts; their crc is null. Repeated rows count each. Slots number a shard's rows from 0 in an order that depends on
    keys and ids only. An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = stored(
        docs.select(
            "doc_id",
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
            F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
            F.coalesce(F.unhex(F.sha2(F.col("text").cast("binary"), 256)), F.lit(b"")).alias("key"),
        ),
        "shard-rows",
    )
    n = rows.count()
    salts = buckets_for(n)
    groups = stored(rows.groupBy("key").agg(F.sum("size").alias("class")).withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(salts)).cast("int")), "shard-groups")
    if groups.select("class").distinct().count() > CLASSES:
        groups = groups.withColumn("class", _class(F.col("class")))
    counts = groups.groupBy("class", "salt").count()
    sizes = [(r["class"], r["n"]) for r in groups.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect()]
    runs = even_capacity(sizes, shards) if capacity is None else best_fit_decreasing(sizes, capacity)
    placed = spark.createDataFrame(runs, "class long, first long, end long, shard int")

    before = counts.withColumn("before", F.sum("count").over(Window.partitionBy("class").orderBy("salt")) - F.col("count")).drop("count")
    ranked = groups.withColumn("no", F.row_number().over(Window.partitionBy("class", "salt").orderBy("key"))).join(before, ["class", "salt"])
    ranked = ranked.select("key", "class", (F.col("before") + F.col("no") - 1).alias("rank"))
    shard_of = ranked.join(placed, (ranked["class"] == placed["class"]) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end"))).select("key", "shard")
    dealt = rows.join(shard_of, "key").withColumn("part", F.pmod(F.xxhash64("key", "doc_id"), F.lit(salts)).cast("int")).drop("key")
    dealt = stored(dealt, "shard-dealt")

    of_part = dealt.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    of_part = of_part.withColumn("from", F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).drop("n")
    numbered = dealt.withColumn("no", F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")))
    return numbered.join(of_part, ["shard", "part"]).select("doc_id", "size", "text_crc32", "shard", (F.col("from") + F.col("no") - 1).alias("slot"))
