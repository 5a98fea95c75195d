"""Change logs in time: quiet ranges, sessions, agreement on checkpoints, as-of reads."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grovewise.operators.intervals import stabbed
from grovewise.sources.store import checkpointed


def interval(t: timedelta) -> Column:
    return F.lit(t)


def quiet_ranges(changes: DataFrame, keys: Sequence[str], ts: str, start: Column, end: Column, quiet: timedelta, precision: timedelta = timedelta(0)) -> DataFrame:
    """Gaps of at least ``quiet`` between successive changes of a key, from ``start`` to ``end``.

    A range begins one unit of ``precision`` after the change it follows, so the change itself lies outside.
    """
    points = changes.where((F.col(ts) >= start) & (F.col(ts) < end)).select(*keys, F.col(ts).alias("to_ts")).distinct()
    points = points.unionByName(changes.select(*keys).distinct().withColumn("to_ts", end))
    before = F.lag("to_ts").over(Window.partitionBy(*keys).orderBy("to_ts"))
    ranges = points.withColumn("_after", before).withColumn("from_ts", F.when(F.col("_after").isNull(), start).otherwise(F.col("_after") + interval(precision)))
    return ranges.where(F.col("to_ts") - F.col("from_ts") >= interval(quiet)).select(*keys, "from_ts", "to_ts")


def interesting(ranges: DataFrame, points: DataFrame, changes: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """Flag ranges that hold an interest point, or are a key's last, and start at or after its first change.

    Points in a range are counted by a sweep, and last and first are aggregates of a key, so no range meets a point and
    no key's rows gather.
    """
    first = changes.groupBy(*keys).agg(F.min(ts).alias("_first")).join(ranges.groupBy(*keys).agg(F.max("from_ts").alias("_last")), list(keys), "full_outer")
    held = stabbed(ranges, points, keys, F.col("from_ts"), F.col("to_ts"), F.col(ts), "_before", "_hits", [*keys, "from_ts", "to_ts"])
    flagged = held.join(first, list(keys), "left")
    known = F.col("from_ts").isNotNull() & F.col("to_ts").isNotNull()
    flag = F.coalesce(((F.col("_hits") > 0) & known | (F.col("_last") == F.col("from_ts"))) & (F.col("from_ts") >= F.col("_first")), F.lit(False))
    return flagged.withColumn("interesting", flag).select(*ranges.columns, "interesting")


def postpone_until(changes: DataFrame, keys: Sequence[str], ts: str, quiet: timedelta, now: Column) -> DataFrame:
    """When a key will have been quiet, where that lies after ``now``; else null."""
    until = F.max(ts) + interval(quiet)
    return changes.groupBy(*keys).agg(F.when(until > now, until).alias("postpone_until"))


def gap_sessions(rows: DataFrame, keys: Sequence[str], ts: str, order: str, gap: timedelta, into: str = "session") -> DataFrame:
    """Number the sessions of each key: a row joins while it comes less than ``gap`` after the one before."""
    w = Window.partitionBy(*keys).orderBy(ts, order)
    fresh = F.when(F.col(ts) - F.lag(ts).over(w) < interval(gap), 0).otherwise(1)
    return rows.withColumn("_new", fresh).withColumn(into, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def commit_sessions(revisions: DataFrame, gap: timedelta) -> DataFrame:
    """Sessions of (author, message, file, date): as by gap, and a file comes in a session once.

    Gaps are found by a window first; only within a gap stretch can files repeat. The sequential rule then streams over
    partitions sorted by stretch and time; its state is the open sessions of one stretch, however many rows pass.
    """
    keyed = gap_sessions(revisions, ["author", "message"], "date", "file", gap, "stretch")
    key = ["author", "message", "stretch"]

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, open_, n = None, [], 0
        for pdf in batches:
            part = []
            for *k, d, f in zip(*(pdf[c] for c in key), pdf["date"], pdf["file"], strict=True):
                if k != now:
                    now, open_, n = k, [], 0
                open_ = [s for s in open_ if d - s[0] < gap]  # what is too old stays closed
                found = next((s for s in open_ if f not in s[1]), None)
                if found is None:
                    found = [d, set(), n]
                    open_.append(found)
                    n += 1
                found[0] = d
                found[1].add(f)
                part.append(found[2])
            yield pdf.assign(part=part)

    ordered = keyed.repartition(*key).sortWithinPartitions(*key, "date", "file")
    return ordered.mapInPandas(split, f"{_ddl(keyed)}, part int")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def _running(rows: DataFrame, keys: Sequence[str], at: str, phase: str, values: Sequence[str]) -> DataFrame:
    """Running sums of ``values`` in the order of (at, phase), equal places taken together: by hour, then within the hour,
    so that a key with very many rows isn't one task's."""
    rows = rows.groupBy(*keys, at, phase).agg(*[F.sum(v).alias(v) for v in values]).withColumn("_hour", F.date_trunc("hour", at))
    hours = rows.groupBy(*keys, "_hour").agg(*[F.sum(v).alias(f"_{v}") for v in values])
    over = Window.partitionBy(*keys).orderBy("_hour")
    hours = hours.select(*keys, "_hour", *[(F.sum(f"_{v}").over(over) - F.col(f"_{v}")).alias(f"_{v}") for v in values])
    within = Window.partitionBy(*keys, "_hour").orderBy(at, phase)
    summed = rows.withColumns({v: F.sum(v).over(within) for v in values}).join(hours, [*keys, "_hour"])
    return summed.select(*keys, at, phase, *[(F.col(v) + F.col(f"_{v}")).alias(v) for v in values])


def mediate(ranges: DataFrame, scopes: Sequence[str], proposal: str, last: Column, now: Column) -> DataFrame:
    """The earliest time on which all proposals agree, per scope.

    Interesting ranges are clipped to (last, now); clipped ends and all bounds inside are candidates; a candidate holds
    if every proposal has a range around it: lower bounds in [from, to), upper bounds in (from, to]. One sweep over time
    counts the ranges around each bound, a proposal's overlapping ranges being merged before; nothing is compared in pairs.
    """
    scopes = list(scopes)
    ranges = checkpointed(ranges.select(*scopes, proposal, "from_ts", "to_ts", "interesting"))  # read seven times below
    n_of = ranges.groupBy(*scopes).agg(F.countDistinct(proposal).alias("_n"))
    sound = ranges.where("from_ts < to_ts")
    w = Window.partitionBy(*scopes, proposal).orderBy("from_ts", "to_ts")
    fresh = F.coalesce(F.col("from_ts") > F.max("to_ts").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)).cast("int")
    islands = sound.withColumn("_new", fresh).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    merged = islands.groupBy(*scopes, proposal, "_island").agg(F.min("from_ts").alias("from_ts"), F.max("to_ts").alias("to_ts"))
    clipped = ranges.where("interesting").select(*scopes, F.greatest("from_ts", last).alias("from_ts"), F.least("to_ts", now).alias("to_ts")).where("from_ts < to_ts")

    def marks(rows: DataFrame, end: str, phase: int, held: int = 0, inside: int = 0, bound: int = 0, clip: int = 0) -> DataFrame:
        return rows.select(*scopes, F.col(end).alias("b"), F.lit(phase).alias("phase"), *[F.lit(v).cast("long").alias(k) for k, v in (("held", held), ("inside", inside), ("bound", bound), ("clip", clip))])

    # At one time upper bounds come first, then ranges end and begin, then lower bounds.
    points = marks(merged, "from_ts", 1, held=1)
    for rows in (
        marks(merged, "to_ts", 1, held=-1), marks(clipped, "from_ts", 1, inside=1), marks(clipped, "to_ts", 1, inside=-1),
        marks(ranges, "from_ts", 2, bound=1), marks(ranges, "to_ts", 0, bound=1), marks(clipped, "from_ts", 2, clip=1), marks(clipped, "to_ts", 0, clip=1),
    ):
        points = points.unionByName(rows)
    own = points.groupBy(*scopes, "b", "phase").agg(F.sum("bound").alias("bound"), F.sum("clip").alias("clip")).where("phase <> 1")
    counted = _running(points, scopes, "b", "phase", ["held", "inside"]).join(own, [*scopes, "b", "phase"])
    agreed = counted.where("clip > 0 or bound > 0 and inside > 0").join(n_of, scopes).where("held = _n")
    return agreed.groupBy(*scopes).agg(F.min("b").alias("checkpoint"))


def without_agreement(scopes: DataFrame, agreed: DataFrame, postponed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, decision, until): ``checkpoint`` where all proposals agree, else ``postpone`` until the latest time that a
    proposal names, and ``abandon`` where none does."""
    keys = list(keys)
    latest = postponed.groupBy(*keys).agg(F.max("postpone_until").alias("_until"))
    found = scopes.select(*keys).distinct().join(agreed.select(*keys, "checkpoint"), keys, "left").join(latest, keys, "left")
    decision = F.when(F.col("checkpoint").isNotNull(), "checkpoint").when(F.col("_until").isNotNull(), "postpone").otherwise("abandon")
    return found.select(*keys, decision.alias("decision"), F.coalesce("checkpoint", "_until").alias("until"))


def run_gate(runs: DataFrame, keys: Sequence[str], ended: str, aborted: str, now: Column, least: timedelta) -> DataFrame:
    """(keys, wait_until): when a job may run again if ``now`` is too soon after its last end, else null. The end of an
    aborted run counts if there is one, then that of the last complete run; a job that never ran may run."""
    last = runs.groupBy(*keys).agg(F.max(F.when(F.col(aborted), F.col(ended))).alias("_a"), F.max(F.when(~F.col(aborted), F.col(ended))).alias("_c"))
    end = F.coalesce("_a", "_c")
    return last.select(*keys, F.when(now - end < interval(least), end + interval(least)).alias("wait_until"))


def quiet_for(quiet: timedelta, precision: timedelta) -> timedelta:
    """A quiet period that the precision of the times can tell: twice the precision at least."""
    return max(quiet, 2 * precision)


def as_of(revisions: DataFrame, file: str, ts: str, at: Column, value: str, order: str) -> DataFrame:
    """The latest version of each file at a time."""
    return revisions.where(F.col(ts) <= at).groupBy(file).agg(F.max_by(value, F.struct(ts, order)).alias(value))


def modified_since(rows: DataFrame, ts: str, since: Column) -> DataFrame:
    """Inclusive: a change at the very time of the last run counts."""
    return rows.where(F.col(ts) >= since)
