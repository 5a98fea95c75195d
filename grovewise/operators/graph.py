"""Queries on directed, typed graphs held as arcs (src, dst, kind) and nodes (id, kind)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovewise.sources.store import checkpointed


def reachable(arcs: DataFrame, start: DataFrame, reverse: bool = False, limit: int = 1000) -> DataFrame:
    """(id, depth) of the nodes that ``start`` (id) leads to, itself at depth 0.

    Breadth first: each round joins only the newest nodes with the arcs and drops those seen before, so cycles end it.
    Arcs are stored once; what was seen is stored anew every few rounds, so plans don't grow with the depth.
    """
    frm, to = ("dst", "src") if reverse else ("src", "dst")
    edges = checkpointed(arcs.select(F.col(frm).alias("id"), F.col(to).alias("next")).distinct())
    front = checkpointed(start.select("id").distinct().withColumn("depth", F.lit(0)))
    seen = front
    for depth in range(1, limit + 1):
        fresh = front.join(edges, "id").select(F.col("next").alias("id")).distinct()
        front = checkpointed(fresh.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)
        seen = checkpointed(seen) if depth % 8 == 0 else seen
    raise RuntimeError(f"more than {limit} rounds")


def isolated(nodes: DataFrame, arcs: DataFrame) -> DataFrame:
    """Nodes without any arc."""
    ends = arcs.select(F.col("src").alias("id")).union(arcs.select("dst"))
    return nodes.join(ends, "id", "left_anti")


def neighbours(arcs: DataFrame, chosen: DataFrame, incoming: bool = False) -> DataFrame:
    """Nodes one arc away from the chosen ones, in either sense."""
    frm, to = ("dst", "src") if incoming else ("src", "dst")
    return arcs.join(chosen.select(F.col("id").alias(frm)), frm, "left_semi").select(F.col(to).alias("id")).distinct()


def complement(nodes: DataFrame, chosen: DataFrame) -> DataFrame:
    return nodes.join(chosen.select("id"), "id", "left_anti")


def contract(arcs: DataFrame, members: DataFrame) -> DataFrame:
    """Arcs after ``members`` (id, group) became group nodes: inner arcs go, parallel outer arcs merge with their number."""
    src = members.select(F.col("id").alias("src"), F.col("group").alias("_s"))
    dst = members.select(F.col("id").alias("dst"), F.col("group").alias("_d"))
    moved = arcs.join(src, "src", "left").join(dst, "dst", "left")
    moved = moved.select(F.coalesce("_s", "src").alias("src"), F.coalesce("_d", "dst").alias("dst"), (F.col("_s").isNotNull() | F.col("_d").isNotNull()).alias("composite"))
    return moved.where("not (composite and src = dst)").groupBy("src", "dst").agg(F.bool_or("composite").alias("composite"), F.count(F.lit(1)).alias("n_arcs"))


def expand(contracted_members: DataFrame, arcs: DataFrame, group: str) -> DataFrame:
    """The original arcs again, with one group opened and the others kept contracted."""
    return contract(arcs, contracted_members.where(F.col("group") != group))


def visible(arcs: DataFrame, nodes: DataFrame, node_kinds: list[str], arc_kinds: list[str]) -> DataFrame:
    """Arcs of shown kinds between shown nodes."""
    shown = nodes.where(F.col("kind").isin(node_kinds)).select("id")
    kept = arcs.where(F.col("kind").isin(arc_kinds))
    return kept.join(shown.withColumnRenamed("id", "src"), "src", "left_semi").join(shown.withColumnRenamed("id", "dst"), "dst", "left_semi")


def degrees(arcs: DataFrame) -> DataFrame:
    """(id, n_in, n_out)."""
    ends = arcs.select(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(arcs.select("dst", F.lit(1), F.lit(0)))
    return ends.groupBy("id").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))


def spring_layout(arcs: DataFrame, key: str, rounds: int = 50, c1: float = 2.0, c2: float = 1.0, c3: float = 1.0, seed: int = 1) -> DataFrame:
    """(key, id, x, y): arcs attract by c1 log(d / c2), nodes repel by c3 / d². One small drawing is one task's work."""

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(np.concatenate((pdf["src"], pdf["dst"])))
        a, b = np.searchsorted(ids, pdf["src"]), np.searchsorted(ids, pdf["dst"])
        p = np.random.default_rng(seed).normal(size=(len(ids), 2)) * np.sqrt(len(ids))
        for _ in range(rounds):
            d = p[:, None] - p[None]
            r = np.sqrt((d**2).sum(axis=2)) + 1e-9
            move = (d * np.where(r > 1e-6, c3 / r**3, 0)[:, :, None]).sum(axis=1)
            e = p[b] - p[a]
            n = np.sqrt((e**2).sum(axis=1, keepdims=True)) + 1e-9
            pull = e / n * c1 * np.log(n / c2)
            np.add.at(move, a, pull)
            np.add.at(move, b, -pull)
            p += 0.05 * np.clip(move, -10, 10)
        return pd.DataFrame({key: pdf[key].iloc[0], "id": ids, "x": p[:, 0], "y": p[:, 1]})

    kind = dict(arcs.dtypes)
    return arcs.groupBy(key).applyInPandas(draw, f"{key} {kind[key]}, id {kind['src']}, x double, y double")
