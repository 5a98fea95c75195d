"""Connected components by alternating large-star and small-star steps on an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovewise.llm.common import stored


#: A node with this share of all edge ends, and so many at least, is a hub; hence at most so many are broadcast.
HUBS = 1000


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def joined_apart(rows: DataFrame, found: DataFrame, keys: list[str], weight: str, hot: int | None) -> DataFrame:
    """``rows`` with what ``found``, unique by ``keys``, has for them. Keys of ``hot`` rows or more (``weight``) are looked up
    in a broadcast, so that the rows of one key needn't meet in a task; they are few where ``hot`` is a share of all."""
    if hot is None:
        return rows.join(found.drop(weight), keys)
    many = F.broadcast(found.where(F.col(weight) >= hot).drop(weight))
    rest = rows.join(many.select(*keys), keys, "left_anti").join(found.where(F.col(weight) < hot).drop(weight), keys)
    return rows.join(many, keys).unionByName(rest)


def hot_from(total: int, most: int | None) -> int | None:
    """From how many rows on a key is hot: a share of ``total``, so that at most HUBS keys are; None if no key has so many."""
    least = max(HUBS, -(-total // HUBS))
    return least if (most or 0) >= least else None


def _large_star(edges: DataFrame, hub_degree: int | None) -> DataFrame:
    """Every node links its larger neighbours to its least neighbour (itself included)."""
    pairs = _both_ways(edges)
    least = pairs.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("degree")).withColumn("m", F.least("a", "m"))
    return joined_apart(pairs, least, ["a"], "degree", hub_degree).where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links its smaller neighbours, and itself, to the least of them; few remain after a large star."""
    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = pairs.groupBy("a").agg(F.min("b").alias("m"))
    moved = pairs.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (a long, b long): the least node reachable.

    Each star needs one least value per node, aggregated before the shuffle, and one join, in which hubs are broadcast,
    so a hub of any degree isn't gathered in one task. Rounds end when the edges are stars: every node either has one
    edge, to a smaller node, or is only pointed at. Loops, repeated edges and edges with a null end are ignored.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    for _ in range(max_rounds):
        ends = now.select(F.col("a").alias("node"), F.lit(1).alias("out")).unionByName(now.select(F.col("b").alias("node"), F.lit(0).alias("out")))
        nodes = ends.groupBy("node").agg(F.sum("out").alias("out"), F.count(F.lit(1)).alias("degree"))
        other = (F.col("out") > 1) | (F.col("out") > 0) & (F.col("out") < F.col("degree"))
        unsettled, degrees, most = nodes.agg(F.max(other), F.sum("degree"), F.max("degree")).first()
        if not unsettled:
            break
        now = stored(_small_star(_large_star(now, hot_from(degrees, most))), "components")
    else:
        raise RuntimeError(f"components didn't settle in {max_rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
