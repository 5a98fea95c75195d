"""Sibling order: by value, as corresponding nodes, and from pairwise constraints with priorities."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from heapq import heapify, heappop, heappush
from itertools import chain, groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StructField, StructType

from grovewise.sources.store import checkpointed, observed


def sort_by_value(children: DataFrame, parent: str, value: Column, id_: str, descending: bool = False, into: str = "place") -> DataFrame:
    """Places from 1 among a parent's children; ties by id."""
    w = Window.partitionBy(parent).orderBy(value.desc() if descending else value.asc(), id_)
    return children.withColumn(into, F.row_number().over(w))


def sort_as_corresponding(children: DataFrame, proxies: DataFrame, parent: str, id_: str, into: str = "place") -> DataFrame:
    """Children in the document order of their proxies (id, doc, pos), per proxy document.

    Children whose proxies lie in different documents aren't constrained by each other: documents follow each other in
    the order of the least id that they hold. Children are ranked over ranges, so that those of one parent are many tasks'.
    """
    paired = children.join(proxies, id_)
    first = paired.groupBy(F.col(parent).alias("_p"), F.col("doc").alias("_d")).agg(F.min(id_).alias("_first"))
    placed = paired.join(first, F.col(parent).eqNullSafe(F.col("_p")) & F.col("doc").eqNullSafe(F.col("_d"))).drop("_p", "_d")
    return ranked_order(placed, parent, [F.col("_first"), F.col("pos")], id_, into).drop("_first", "doc", "pos")


def relative_edges(chosen: DataFrame, siblings: DataFrame, parent: str, before: bool, priority: int) -> DataFrame:
    """Edges (parent, a, b, priority): each chosen node before, or after, each selected sibling of its parent."""
    a, b = ("id", "sib") if before else ("sib", "id")
    pairs = chosen.select(parent, "id").join(siblings.select(parent, F.col("id").alias("sib")), parent).where("id <> sib")
    return pairs.select(parent, F.col(a).alias("a"), F.col(b).alias("b"), F.lit(priority).alias("priority"))


def sequence_edges(rows: DataFrame, parent: str, pos: str, priority: int) -> DataFrame:
    """Edges between successive members of an insertion sequence: their closure orders all pairs."""
    after = F.lead("id").over(Window.partitionBy(parent).orderBy(pos))
    return rows.withColumn("b", after).where("b is not null").select(parent, F.col("id").alias("a"), "b", F.lit(priority).alias("priority"))


def value_edges(rows: DataFrame, parent: str, value: str, priority: int) -> DataFrame:
    """Edges from each child to those of the next greater value; equal values give none."""
    rank = F.dense_rank().over(Window.partitionBy(parent).orderBy(value))
    ranked = rows.select(parent, "id", rank.alias("r"))
    nxt = ranked.select(F.col(parent).alias("_p"), F.col("id").alias("b"), (F.col("r") - 1).alias("_r"))
    return ranked.join(nxt, (F.col(parent) == F.col("_p")) & (F.col("r") == F.col("_r"))).select(parent, F.col("id").alias("a"), "b", F.lit(priority).alias("priority"))


#: Rows of a range that one task sorts and sums.
RANGE = 1 << 19


def ranges(rows: DataFrame, *order: str | Column) -> DataFrame:
    """``rows`` stored in ranges of ``order`` with each row's ``_range``. There are as many as the setting says, more where
    these would hold more than about ``RANGE`` rows each, so that a task's memory doesn't follow the size of the table."""
    spark = rows.sparkSession
    counted, seen = observed(rows, n=F.count(F.lit(1)))
    needed = -(-seen["n"] // RANGE)
    by = (needed,) if needed > int(spark.conf.get("spark.sql.shuffle.partitions")) else ()
    return checkpointed(counted.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()))


def ranked_order(children: DataFrame, parent: str, ranks: Sequence[Column], id_: str = "id", into: str = "place", descending: bool = False) -> DataFrame:
    """Places from 1 among a parent's children by rank columns (``descending``: from the greatest on), ties by id.

    Constraints that say "each of these before each of those" are consistent by nature: as ranks they need no edges. Rows
    are cut into ranges of (parent, ranks, id), so that the children of one large parent are dealt to many tasks.
    """
    names = [f"_rank{i}" for i in range(len(ranks))]
    ranked = children.withColumns(dict(zip(names, ranks, strict=True)))
    order = [*(F.col(n).desc() if descending else F.col(n).asc() for n in names), F.col(id_)]
    cut = ranges(ranked, parent, *order)
    within = Window.partitionBy(parent, "_range").orderBy(*order)
    # Only parents that go on from an earlier range have an offset: fewer rows than there are ranges.
    sizes = cut.groupBy(parent, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(parent).orderBy("_range")) - F.col("_n")
    offsets = sizes.select(F.col(parent).alias("_parent"), F.col("_range").alias("_at"), before.alias("_before")).where("_before > 0")
    placed = cut.withColumn("_place", F.row_number().over(within)).join(F.broadcast(offsets), F.col(parent).eqNullSafe(F.col("_parent")) & (F.col("_range") == F.col("_at")), "left")
    return placed.withColumn(into, (F.col("_place") + F.coalesce("_before", F.lit(0))).cast("int")).select(*children.columns, into)


def running_totals(rows: DataFrame, parent: str, order: Sequence[str], totals: dict[str, str]) -> DataFrame:
    """``rows`` with running totals per parent in the order of columns, rows of equal order taken together; ``totals`` names
    each by the column that it sums. Rows are cut into ranges of (parent, order) as by ``ranked_order``."""
    cut = ranges(rows, parent, *order)
    sums = cut.groupBy(parent, "_range").agg(*[F.sum(v).alias(f"_{k}") for k, v in totals.items()], F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(parent).orderBy("_range")
    before = [(F.sum(f"_{k}").over(upto) - F.col(f"_{k}")).alias(f"_{k}") for k in totals]
    offsets = sums.select(F.col(parent).alias("_parent"), F.col("_range").alias("_at"), *before, (F.sum("_n").over(upto) > F.col("_n")).alias("_on")).where("_on")
    within = Window.partitionBy(parent, "_range").orderBy(*order)
    # Only parents that go on from an earlier range have an offset: fewer rows than there are ranges.
    summed = cut.withColumns({k: F.sum(v).over(within) for k, v in totals.items()})
    found = summed.join(F.broadcast(offsets), F.col(parent).eqNullSafe(F.col("_parent")) & (F.col("_range") == F.col("_at")), "left")
    return found.select(*rows.columns, *[(F.col(k) + F.coalesce(f"_{k}", F.lit(0))).alias(k) for k in totals])


def running_extremes(rows: DataFrame, parent: str, order: str, value: str, before: str, after: str) -> DataFrame:
    """``rows`` with the greatest ``value`` of the rows of its parent before it in ``order``, and the least of those after it;
    null where there is none. ``order`` is a number that no two rows of a parent share. Two-level, as ``running_totals``."""
    cut = ranges(rows, parent, order)
    ends = cut.groupBy(parent, "_range").agg(F.max(value).alias("_range_most"), F.min(value).alias("_range_least"))
    # What comes after a row is what comes before it in the opposite order: Spark sums a frame that runs to the end anew for
    # each row, in the square of the rows.
    past = (Window.unboundedPreceding, -1)
    at = Window.partitionBy(parent)
    most = F.max("_range_most").over(at.orderBy("_range").rowsBetween(*past))
    rest = F.min("_range_least").over(at.orderBy(F.desc("_range")).rowsBetween(*past))
    outside = ends.select(F.col(parent).alias("_parent"), F.col("_range").alias("_at"), most.alias("_range_most"), rest.alias("_range_least"))
    # Only parents that lie in several ranges have an outside: fewer than two rows for each range.
    outside = outside.where("_range_most is not null or _range_least is not null")
    within = Window.partitionBy(parent, "_range")
    own = cut.withColumn(before, F.max(value).over(within.orderBy(order).rowsBetween(*past)))
    own = own.withColumn(after, F.min(value).over(within.orderBy(F.desc(order)).rowsBetween(*past)))
    found = own.join(F.broadcast(outside), F.col(parent).eqNullSafe(F.col("_parent")) & (F.col("_range") == F.col("_at")), "left")
    return found.select(*rows.columns, F.greatest(before, "_range_most").alias(before), F.least(after, "_range_least").alias(after))


#: Between the labels of neighbours that are numbered anew.
GAP = 1 << 24


def order_labels(children: DataFrame, parent: str, by: Sequence[Column], descending: bool = False) -> DataFrame:
    """``children`` (parent, id, ord, fresh, ..) with ``label``, an order by ``by``, ties by id, that touches as few as it can.

    Children that aren't ``fresh`` are in order already and keep their ``ord`` as label, as do fresh ones that no other
    child is out of order with. The others are moved right behind the one that they follow, or before the first. Where the
    parent has children that aren't ordered, ``follows`` and ``precedes`` are the ``ord`` of a child's neighbours among all
    of them, and ``last`` the greatest, so that no label is taken twice. ``room`` is false for all children of a parent
    where some gap is too small: it has to be numbered anew first.
    """
    null = F.lit(None).cast("long")
    at = children.withColumns({c: null for c in ("follows", "precedes", "last") if c not in children.columns})
    at = ranked_order(at, parent, by, into="_n", descending=descending)
    at = running_extremes(at, parent, "_n", "ord", "_greatest", "_least")
    calm = (F.coalesce(F.col("ord") > F.col("_greatest"), F.lit(True))) & (F.coalesce(F.col("ord") < F.col("_least"), F.lit(True)))
    at = at.withColumn("_stays", F.when(~F.col("fresh") | calm, F.col("ord")))
    at = checkpointed(running_extremes(at, parent, "_n", "_stays", "_prev", "_next"))
    moved = at.where("_stays is null").withColumn("_gap", F.struct(parent, "_prev"))
    placed = ranked_order(moved, "_gap", [F.col("_n")], into="_j")
    sizes = placed.groupBy(F.col("_gap").alias("_of")).agg(F.count(F.lit(1)).alias("_m"))
    placed = placed.join(sizes, F.col("_gap").eqNullSafe(F.col("_of")))
    fixed = at.where("_stays is not null")
    behind = fixed.select(F.col(parent).alias("_p1"), F.col("_stays").alias("_l1"), F.col("follows").alias("_f"))
    ahead = fixed.select(F.col(parent).alias("_p2"), F.col("_stays").alias("_l2"), F.col("precedes").alias("_b"))
    placed = placed.join(behind, F.col(parent).eqNullSafe(F.col("_p1")) & (F.col("_prev") == F.col("_l1")), "left")
    placed = placed.join(ahead, F.col(parent).eqNullSafe(F.col("_p2")) & (F.col("_next") == F.col("_l2")), "left")
    low = F.coalesce("_prev", F.when(F.col("_next").isNotNull(), F.col("_b")), F.when(F.col("_next").isNull(), F.coalesce("last", F.lit(0))))
    high = F.when(F.col("_prev").isNotNull(), F.coalesce("_f", "_next")).otherwise(F.col("_next"))
    placed = placed.withColumns({"_low": low, "_high": high})
    j, m = F.col("_j").cast("long"), F.col("_m")
    between = F.col("_low") + F.floor((F.col("_high") - F.col("_low")).cast("decimal(38,0)") * j / (m + 1)).cast("long")
    label = F.when(F.col("_high").isNull(), F.col("_low") + j * GAP).when(F.col("_low").isNull(), F.col("_high") - (m + 1 - j) * GAP).otherwise(between)
    placed = checkpointed(placed.withColumn("label", label).withColumn("_tight", F.coalesce(F.col("_high") - F.col("_low") <= m, F.lit(False))))
    tight = placed.where("_tight").select(F.col(parent).alias("_p")).distinct().withColumn("room", F.lit(False))
    both = placed.select(*children.columns, "label").unionByName(fixed.select(*children.columns, F.col("_stays").alias("label")))
    return both.join(tight, F.col(parent).eqNullSafe(F.col("_p")), "left").select(*children.columns, "label", F.coalesce("room", F.lit(True)).alias("room"))


def greedy_order(ids: list[str], edges: dict[tuple[str, str], int]) -> list[str]:
    """Place next the child that the weakest constraint of an unplaced one holds back, ties by id.

    Consistent constraints are all kept; in a conflict the greater priority wins; a cycle breaks at its lowest. Takes
    time in n log n for n children and edges: a placed child only lowers others, so the heap gets an entry a change.
    """
    copies, out = Counter(ids), []
    held: dict[str, Counter] = {i: Counter() for i in copies}
    after: dict[str, list[tuple[str, int]]] = {i: [] for i in copies}
    for (a, b), p in edges.items():
        if a in held and b in held and a != b:
            held[b][p] += 1
            after[a].append((b, p))
    levels = {i: sorted(c) for i, c in held.items()}
    now = {i: x[-1] if x else float("-inf") for i, x in levels.items()}
    heap = [(now[i], i) for i in copies]
    heapify(heap)
    while heap:
        level, best = heappop(heap)
        if not copies[best] or level != now[best]:
            continue
        out.append(best)
        copies[best] -= 1
        if copies[best]:
            heappush(heap, (level, best))
        for b, p in after.pop(best, ()):
            held[b][p] -= 1
            while levels[b] and not held[b][levels[b][-1]]:
                levels[b].pop()
            if (top := levels[b][-1] if levels[b] else float("-inf")) != now[b]:
                now[b] = top
                heappush(heap, (top, b))
    return out


#: Places in one batch of the result.
PLACED = 1 << 15


def priority_order(children: DataFrame, edges: DataFrame, parent: str) -> DataFrame:
    """(parent, id, place) from edges (parent, a, b, priority); of repeated edges the greatest priority counts.

    Parents don't interact: each is one small search over its children. Children and edges come sorted by parent, and a batch
    holds those of many, so that a parent costs no call of its own.
    """
    kind, none = dict(children.dtypes), F.lit(None)
    kids = children.select(parent, F.col("id").alias("a"), none.cast(kind["id"]).alias("b"), none.cast(dict(edges.dtypes)["priority"]).alias("priority"), F.lit(False).alias("_edge"))
    both = kids.unionByName(edges.select(parent, "a", "b", "priority", F.lit(True).alias("_edge"))).repartition(parent).sortWithinPartitions(parent)
    schema = to_arrow_schema(StructType([children.schema[parent], children.schema["id"], StructField("place", IntegerType())]))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (zip(*(b.column(i).to_pylist() for i in range(5)), strict=True) for b in batches)
        found: list[list] = [[], [], []]
        for key, own in groupby(chain.from_iterable(rows), itemgetter(0)):
            ids: list = []
            arcs: dict[tuple, int] = {}
            for _, a, b, priority, edge in own:
                if not edge:
                    ids.append(a)
                elif arcs.get((a, b)) is None or priority is not None and priority > arcs[a, b]:
                    arcs[a, b] = priority
            order = greedy_order(ids, arcs)
            found[0].extend([key] * len(order))
            found[1].extend(order)
            found[2].extend(range(1, len(order) + 1))
            if len(found[0]) >= PLACED:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(found, schema, strict=True)], schema=schema)
                found = [[], [], []]
        if found[0]:
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(found, schema, strict=True)], schema=schema)

    return both.mapInArrow(solve, f"{parent} {kind[parent]}, id {kind['id']}, place int")


def moved(before: DataFrame, after: DataFrame, parent: str) -> DataFrame:
    """Children whose place changed: what an incremental sort has to touch."""
    return before.join(after.withColumnRenamed("place", "_new"), [parent, "id"]).where("place <> _new").select(parent, "id", F.col("_new").alias("place"))


__all__ = ["greedy_order", "moved", "order_labels", "priority_order", "ranked_order", "relative_edges", "running_extremes", "running_totals", "sequence_edges", "sort_as_corresponding", "sort_by_value", "value_edges"]
