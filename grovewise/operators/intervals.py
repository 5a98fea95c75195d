"""Points and intervals on a line, by sweeps: counts without pairs, and pairs in work that follows the result.

Bounds and points are sorted together once; the running number of points at a bound is how many lie before it, so the
points of an interval are a run of ranks whose length is the difference of two such numbers. Ranges of the sorted rows are
summed in two levels, so that no key is one task's. Pairs meet in blocks of ranks: an interval is copied once for each
block of points that it covers, hence at most two blocks more than its points fill.

A tree is such a line: with nodes numbered in document order (``pre``) and ``end`` the number after a node's last
descendant, every axis is a question about intervals. Labels are computed from positions, or from parents alone by list
ranking, in which deep trees take a logarithm of their size in rounds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovewise.operators.ordering import ranked_order, running_totals
from grovewise.sources.store import checkpointed, observed

BLOCK = 4096
LABELS = ("pre", "end")


def numbered_rows(rows: DataFrame, into: str = "_row") -> DataFrame:
    """``rows`` stored with a number each, so that reading them again gives the same numbers."""
    return checkpointed(rows.withColumn(into, F.monotonically_increasing_id()))


def stabbed(intervals: DataFrame, points: DataFrame, keys: Sequence[str], low: Column, high: Column, at: Column, first: str = "first", into: str = "n", known_by: Sequence[str] | None = None) -> DataFrame:
    """``intervals`` with ``into``, the number of points of equal ``keys`` in [low, high), and ``first``, the number of those
    before ``low``; 0 points where high is below low. A null bound is infinite: nothing lies before a null ``low`` and
    nothing after a null ``high``; points at null, and rows of a null key, meet nothing. ``known_by``: columns that bounds
    and keys depend on, so that intervals needn't be numbered. Column names starting with ``_`` are taken."""
    key = F.when(_all_known(keys), F.struct(*keys))
    rows = intervals.withColumn("_row", F.struct(*known_by)) if known_by else numbered_rows(intervals)
    # An infinite low comes before all points (0), a high after them (3); at one place bounds come before points.
    bound = lambda c, side, phase: rows.select(key.alias("_key"), F.when(c.isNull(), phase).otherwise(1).alias("_part"), c.alias("_spot"), F.lit(0).alias("_point"), F.lit(0).cast("long").alias("_w"), "_row", F.lit(side).alias("_side"))
    dots = points.select(key.alias("_key"), F.lit(1).alias("_part"), at.alias("_spot"), F.lit(1).alias("_point"), F.lit(1).cast("long").alias("_w"), F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), F.lit(2).alias("_side"))
    dots = dots.where("_key is not null and _spot is not null")
    summed = running_totals(bound(low, 0, 0).unionByName(bound(high, 1, 3)).unionByName(dots), "_key", ["_part", "_spot", "_point"], {"_before": "_w"}).where("_point = 0")
    ends = summed.groupBy("_row").agg(*(F.max(F.when((F.col("_side") == s) & F.col("_key").isNotNull(), F.col("_before"))).alias(n) for s, n in ((0, "_lo"), (1, "_hi"))))
    found = rows.join(ends.withColumnRenamed("_row", "_of"), F.col("_row").eqNullSafe(F.col("_of"))).drop("_of")
    return found.withColumn(first, F.coalesce("_lo", F.lit(0)).cast("long")).withColumn(into, F.greatest(F.coalesce(F.col("_hi") - F.col("_lo"), F.lit(0)), F.lit(0)).cast("long")).drop("_lo", "_hi", "_row")


def _all_known(keys: Sequence[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).isNotNull()
    return out


def inside(intervals: DataFrame, points: DataFrame, keys: Sequence[str], low: Column, high: Column, at: Column, point: Sequence[str], block: int = BLOCK) -> DataFrame:
    """A row for each interval and point of equal ``keys`` in [low, high): the interval's columns and the columns ``point``
    of the point, whose names must differ."""
    keys = list(keys)
    dots = points.where(_all_known(keys) & at.isNotNull()).select(F.struct(*keys).alias("_key"), at.alias("_spot"), F.struct(*point).alias("_point"))
    dots = ranked_order(numbered_rows(dots), "_key", [F.col("_spot")], "_row", "_place").select("_key", "_point", (F.col("_place").cast("long") - 1).alias("_place"))
    found = stabbed(intervals, points, keys, low, high, at, "_first", "_n").where("_n > 0")
    blocks = F.sequence(F.floor(F.col("_first") / block), F.floor((F.col("_first") + F.col("_n") - 1) / block))
    spread = found.withColumn("_key", F.struct(*keys)).withColumn("_block", F.explode(blocks))
    within = (F.col("_place") >= F.col("_first")) & (F.col("_place") < F.col("_first") + F.col("_n"))
    met = spread.join(dots.withColumn("_block", F.floor(F.col("_place") / block)), ["_key", "_block"]).where(within)
    return met.select(*intervals.columns, *(F.col(f"_point.{c}").alias(c) for c in point))


def labelled(nodes: DataFrame) -> DataFrame:
    """``nodes`` (of NODE) with ``pre`` and ``end``, from the positions that lead to them; siblings of one position go by id."""
    steps = F.transform(F.arrays_zip("pos", "path"), lambda s: F.struct(s["pos"].alias("p"), s["path"].alias("i"), F.lit(0).alias("after")))
    last = F.element_at("pos", -1), F.element_at("path", -1)
    # The least place after all descendants: that of a node right after this one.
    over = F.concat(F.slice("_steps", 1, F.size("_steps") - 1), F.array(F.struct(last[0].alias("p"), last[1].alias("i"), F.lit(1).alias("after"))))
    at = nodes.withColumn("_steps", steps)
    own = at.select("doc", "id", F.col("_steps").alias("_spot"), F.lit(1).cast("long").alias("_w"))
    both = own.unionByName(at.select("doc", "id", over.alias("_spot"), F.lit(0).cast("long").alias("_w")))
    placed = running_totals(both, "doc", ["_spot"], {"_upto": "_w"}).groupBy("doc", "id").agg(F.max(F.when(F.col("_w") == 1, F.col("_upto") - 1)).alias("pre"), F.max(F.when(F.col("_w") == 0, F.col("_upto"))).alias("end"))
    return nodes.join(placed, ["doc", "id"])


#: Steps that are ranked by doubling alone.
FEW = 1 << 18


def ranked_steps(steps: DataFrame, few: int = FEW) -> DataFrame:
    """``steps`` (e, s, n, depth), each followed by step ``s`` or, where it is null, by none, with the sums of ``n`` and ``depth``
    from each step to its list's end, and ``s`` null; -1 where the list leads to a step that isn't there.

    A step that drew heads takes in the one behind it if that drew tails, which leaves three in four: the rounds together move
    four times the steps, however many they are. The ``few`` that are left are ranked by doubling links, in as many rounds as
    their number has binary digits. Then steps that were taken in get the sums of those that took them, less what these
    had gathered before, in reverse order. No step may follow two.
    """
    now, seen = observed(steps, open=F.count("s"))
    left, taken = seen["open"], []
    while left > few:
        toss = F.xxhash64("e", F.lit(len(taken))) % 2 == 0
        # The last steps of lists are dealt by their own number, which is nobody's follower.
        heads = now.where(toss).withColumn("_to", F.coalesce("s", -2 - F.col("e")))
        tails = now.where(~toss).select(F.col("e").alias("_e"), F.col("s").alias("_s"), F.col("n").alias("_n"), F.col("depth").alias("_depth"))
        met = heads.join(tails, F.col("_to") == F.col("_e"), "full")
        both, alone = F.col("e").isNotNull() & F.col("_e").isNotNull(), F.col("e").isNull()
        plus = lambda c: (F.coalesce(c, F.lit(0)) + F.coalesce(f"_{c}", F.lit(0))).alias(c)
        gone = F.when(both, F.struct(F.col("_e").alias("e"), F.col("e").alias("by"), "n", "depth")).alias("gone")
        kept, seen = observed(met.select(F.coalesce("e", "_e").alias("e"), F.when(both | alone, F.col("_s")).otherwise(F.col("s")).alias("s"), plus("n"), plus("depth"), gone), open=F.count("s"))
        now = kept.drop("gone")
        taken.append(kept.where("gone is not null").select("gone.*"))
        if seen["open"] == left:
            break
        left = seen["open"]
    # Steps that lead out of what is known get -1; those that go round in a circle are unfinished after all rounds.
    for _ in range(now.count().bit_length() + 1):
        ahead = now.select(F.col("e").alias("s"), F.col("s").alias("_s"), F.col("n").alias("_n"), F.col("depth").alias("_d"))
        open_ = now.where("s >= 0").join(ahead, "s", "left")
        open_ = open_.select("e", F.when(F.col("_n").isNull(), -1).otherwise(F.col("_s")).alias("s"), (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n"), (F.col("depth") + F.coalesce("_d", F.lit(0))).alias("depth"))
        now = checkpointed(now.where("s is null or s < 0").unionByName(open_))
        if now.where("s >= 0").isEmpty():
            break
    for gone in reversed(taken):
        by = now.select(F.col("e").alias("by"), "s", F.col("n").alias("_n"), F.col("depth").alias("_depth"))
        back = gone.join(by, "by").select("e", "s", (F.col("_n") - F.col("n")).alias("n"), (F.col("_depth") - F.col("depth")).alias("depth"))
        now = now.unionByName(checkpointed(back))
    return now


def labelled_by_parents(nodes: DataFrame) -> DataFrame:
    """``nodes`` (doc, id, parent_id, ord, ..) with ``pre``, ``end`` and ``level`` (0 for roots), from parents alone.

    A walk around the trees enters and leaves every node; what follows each of these steps is known from the node's first
    child, next sibling or parent. These links, with the nodes entered and left on the way, are ranked by ``ranked_steps``. A node whose
    parent isn't in its document, or that is its own ancestor, gets no labels and is left out, with all below it.
    """
    keyed = numbered_rows(nodes, "_v")
    # Children of one parent in order, two-level: a parent may have very many.
    family = keyed.select("_v", "doc", "id", "ord", F.col("parent_id").alias("_up"), F.struct("doc", F.col("parent_id").alias("up")).alias("_family"))
    family = checkpointed(ranked_order(family, "_family", [F.col("ord")], "id", "_place").select("_v", "doc", "id", "_up", "_place"))
    parent = family.select(F.col("doc").alias("_d"), F.col("id").alias("_id"), F.col("_v").alias("_parent"))
    known = family.join(parent, (F.col("doc") == F.col("_d")) & (F.col("_up") == F.col("_id")), "left").where("_up is null or _parent is not null").select("_v", "doc", "_place", "_parent")
    known = checkpointed(known)
    following = known.select(F.col("doc").alias("_d"), F.col("_parent").alias("_of"), (F.col("_place") - 1).alias("_p"), F.col("_v").alias("_next"))
    first = known.where("_place = 1 and _parent is not null").select(F.col("_parent").alias("_v"), F.col("_v").alias("_child"))
    same = (F.col("doc") == F.col("_d")) & F.col("_parent").eqNullSafe(F.col("_of")) & (F.col("_place") == F.col("_p"))
    linked = checkpointed(known.join(following, same, "left").join(first, "_v", "left").select("_v", "doc", "_parent", "_next", "_child"))
    # Steps are numbered 2v (enter) and 2v + 1 (leave); ``n`` counts nodes entered, ``depth`` entered less left.
    step = lambda e, s, n, depth: linked.select(e.alias("e"), s.alias("s"), F.lit(n).cast("long").alias("n"), F.lit(depth).cast("long").alias("depth"))
    enter, leave = F.col("_v") * 2, F.col("_v") * 2 + 1
    now = step(enter, F.coalesce(F.col("_child") * 2, leave), 1, 1).unionByName(step(leave, F.coalesce(F.col("_next") * 2, F.col("_parent") * 2 + 1), 0, -1))
    now = ranked_steps(now)
    sides = linked.select(enter.alias("e"), "doc", "_v", F.lit(0).alias("side")).unionByName(linked.select(leave.alias("e"), "doc", "_v", F.lit(1).alias("side")))
    done = checkpointed(now.where("s is null").join(sides, "e"))
    sizes = done.where("side = 0").groupBy("doc").agg(F.max("n").alias("_size"))
    ends = done.join(sizes, "doc").groupBy("_v").agg(
        F.max(F.when(F.col("side") == 0, F.col("_size") - F.col("n"))).alias("pre"), F.max(F.when(F.col("side") == 1, F.col("_size") - F.col("n"))).alias("end"), F.max(F.when(F.col("side") == 0, -F.col("depth"))).alias("level"),
    )
    return keyed.join(ends, "_v").drop("_v")


def _range(axis: str, var: str) -> tuple[Column, Column | None, str]:
    """From where to where an axis looks from a node, and at which label of the nodes that it leads to."""
    pre, end = F.col(f"{var}.pre"), F.col(f"{var}.end")
    none = F.lit(None).cast("long")
    return {
        "descendant": (pre + 1, end, "pre"), "descendant-or-self": (pre, end, "pre"), "following": (end, none, "pre"), "preceding": (none, pre + 1, "end"),
    }[axis]


def structural_step(bound: DataFrame, found: DataFrame, origin: str, axis: str, into: str, outer: bool = False) -> DataFrame:
    """Bindings extended by the nodes of ``found`` (one struct column ``into`` of labelled nodes) that ``axis`` leads to."""
    rows = numbered_rows(bound, "_binding").withColumn("_doc", F.col(f"{origin}.doc"))
    nodes = found.withColumn("_doc", F.col(f"{into}.doc"))
    if axis.startswith("ancestor"):
        # The ancestors are the intervals that the node lies in.
        low = F.col(f"{into}.pre") + (0 if axis.endswith("self") else 1)
        met = inside(nodes, rows, ["_doc"], low, F.col(f"{into}.end"), F.col(f"{origin}.pre"), ["_binding"])
        met = met.select("_binding", into).join(rows, "_binding")
    else:
        low, high, label = _range(axis, origin)
        met = inside(rows, nodes, ["_doc"], low, high, F.col(f"{into}.{label}"), [into])
    met = met.select("_binding", *bound.columns, into)
    if outer:
        rest = rows.join(met.select("_binding"), "_binding", "left_anti")
        met = met.unionByName(rest.select("_binding", *bound.columns, F.lit(None).cast(found.schema[into].dataType).alias(into)))
    return met.drop("_binding")


def structural_count(bound: DataFrame, found: DataFrame, origin: str, axis: str, node: str, into: str = "n") -> DataFrame:
    """Bindings with the number of nodes of ``found`` (struct column ``node``) that ``axis`` leads to, 0 where there is none:
    for descendants, what follows and what precedes, without a pair."""
    low, high, label = _range(axis, origin)
    rows, nodes = bound.withColumn("_doc", F.col(f"{origin}.doc")), found.withColumn("_doc", F.col(f"{node}.doc"))
    return stabbed(rows, nodes, ["_doc"], low, high, F.col(f"{node}.{label}"), "_first", into).select(*bound.columns, into)
