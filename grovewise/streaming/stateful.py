"""Change-log operators that session windows can't express, as stateful streams with timers.

Rows of a key are kept until the watermark has passed them and then folded in the order of time, so late rows and the
order of arrival don't change a result; what is folded leaves the state. A key's state is what its fold carries on (the
last change; the open sessions) and the rows that the watermark hasn't passed. Results equal those of the batch forms.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from datetime import timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What a fold takes: what it carries on, rows (micros, text) in order, the watermark; it gives the former anew, and outputs.
Fold = Callable[[dict, list[tuple[int, str]], int], tuple[dict, list[tuple]]]


def _micros(t: timedelta) -> int:
    return round(t.total_seconds() * 1_000_000)


class InOrder(StatefulProcessor):
    """Keep rows (micros, text) until the watermark has passed them, then fold them in order. ``end``: a last call when it
    passes this time."""

    def __init__(self, fold: Fold, keys: int, columns: Sequence[str], end: int | None = None) -> None:
        self.fold, self.n_keys, self.columns, self.end = fold, keys, list(columns), end

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "micros long, text string")
        self.carried = handle.getValueState("carried", "json string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        came = [(int(m), t) for pdf in rows for m, t in zip(pdf["micros"], pdf["text"], strict=True)]
        if came:
            self.waiting.appendList(came)
            # The watermark is in milliseconds: a timer goes off once it has passed the row's own.
            self.handle.registerTimer(min(m for m, _ in came) // 1000 + 1)
            if self.end is not None:
                self.handle.registerTimer(self.end // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        rows = [(int(m), t) for m, t in self.waiting.get()] if self.waiting.exists() else []
        past, rest = sorted(r for r in rows if r[0] < mark), [r for r in rows if r[0] >= mark]
        carried = json.loads(self.carried.get()[0]) if self.carried.exists() else {}
        carried, out = self.fold(carried, past, mark)
        self.carried.update((json.dumps(carried),))
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(min(m for m, _ in rest) // 1000 + 1)
        else:
            self.waiting.clear()
        if out:
            yield pd.DataFrame([(*key[: self.n_keys], *o) for o in out], columns=self.columns)

    def close(self) -> None:
        pass


def _folded(events: DataFrame, keys: Sequence[str], ts: str, text: Column, late: timedelta, fold: Fold, out: str, end: int | None = None) -> DataFrame:
    spark = events.sparkSession
    if spark.conf.get(STORE) != ROCKS:
        raise RuntimeError(f"{STORE} has to be {ROCKS}: timers need it; see with_timers")
    kinds = dict(events.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), out])
    at = F.col(ts).cast("timestamp")
    rows = events.select(*keys, at.alias("_at"), F.unix_micros(at).alias("micros"), text.cast("string").alias("text")).withWatermark("_at", f"{int(late.total_seconds())} seconds")
    names = [*keys, *(c.split()[0] for c in out.split(", "))]
    return rows.groupBy(*keys).transformWithStateInPandas(InOrder(fold, len(keys), names, end), schema, "Append", "EventTime")


def with_timers(spark: SparkSession) -> SparkSession:
    """A session of the same application in which stateful streams have timers."""
    own = spark.newSession()
    for k in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        own.conf.set(k, spark.conf.get(k))
    own.conf.set(STORE, ROCKS)
    return own


def quiet_ranges(events: DataFrame, keys: Sequence[str], ts: str, start: int, end: int, quiet: timedelta, late: timedelta, precision: timedelta = timedelta(0)) -> DataFrame:
    """(keys, from_ts, to_ts) as by ``temporal.quiet_ranges`` from ``start`` to ``end`` (microseconds): a range is given out
    when the watermark has passed the change that ends it, the last one when it passes ``end``."""
    least, unit = _micros(quiet), _micros(precision)

    def fold(carried: dict, rows: list[tuple[int, str]], mark: int) -> tuple[dict, list[tuple]]:
        at, out = carried.get("from", start), []
        for m in dict.fromkeys(m for m, _ in rows):
            if start <= m < end:
                if m - at >= least:
                    out.append((at, m))
                at = m + unit
        done = carried.get("done", False)
        if mark > end and not done:
            done = True
            if end - at >= least:
                out.append((at, end))
        return {"from": at, "done": done}, out

    found = _folded(events, keys, ts, F.lit(""), late, fold, "from_micros long, to_micros long", end)
    stamp = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    return found.select(*keys, stamp("from_micros").alias("from_ts"), stamp("to_micros").alias("to_ts"))


def commit_sessions(revisions: DataFrame, gap: timedelta, late: timedelta) -> DataFrame:
    """(author, message, date, file, stretch, part) as by ``temporal.commit_sessions``: in a stretch without a gap a file comes
    once in a session, whose anchor moves on. The state is the open sessions of one stretch; older ones are dropped."""
    least = _micros(gap)

    def fold(carried: dict, rows: list[tuple[int, str]], mark: int) -> tuple[dict, list[tuple]]:
        last, stretch, n, open_ = carried.get("last"), carried.get("stretch", 0), carried.get("n", 0), carried.get("open", [])
        out = []
        for m, file in rows:
            if last is None or m - last >= least:
                stretch, n, open_ = stretch + 1, 0, []
            last = m
            open_ = [s for s in open_ if m - s[0] < least]
            found = next((s for s in open_ if file not in s[1]), None)
            if found is None:
                found = [m, [], n]
                open_.append(found)
                n += 1
            found[0] = m
            found[1].append(file)
            out.append((m, file, stretch, found[2]))
        return {"last": last, "stretch": stretch, "n": n, "open": open_}, out

    found = _folded(revisions, ["author", "message"], "date", F.col("file"), late, fold, "micros long, file string, stretch long, part int")
    return found.select("author", "message", F.timestamp_micros("micros").cast("timestamp_ntz").alias("date"), "file", "stretch", "part")
