"""Forests as tables of nodes.

A node carries the ids of its ancestors and itself (``path``) and the positions that lead to it (``pos``). Document
order is the order of (doc, pos); ancestors and descendants meet in equi-joins on ids, so every axis shuffles by key or
broadcasts a small side, and none needs an interval join. Both arrays come from the parent's by appending, so a forest
is built level by level without a global numbering.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grovewise.session import table

NODE = "doc string, id string, parent_id string, path array<string>, pos array<long>, ord long, kind string, name string, attrs map<string,string>, value string"
FIELDS = tuple(f.split(" ")[0] for f in NODE.split(", "))


def node(doc: Column, path: list[Column], pos: list[Column], name: str, attrs: dict[str, Column], value: Column | None = None, kind: str = "element") -> list[Column]:
    """The columns of a node from its ancestors' ids and positions, its own last."""
    pairs = [x for k, v in attrs.items() for x in (F.lit(k), v.cast("string"))]
    return [
        doc.alias("doc"),
        path[-1].alias("id"),
        (path[-2] if len(path) > 1 else F.lit(None).cast("string")).alias("parent_id"),
        F.array(*path).alias("path"),
        F.array(*[p.cast("long") for p in pos]).alias("pos"),
        pos[-1].cast("long").alias("ord"),
        F.lit(kind).alias("kind"),
        F.lit(name).alias("name"),
        (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("attrs"),
        (F.lit(None).cast("string") if value is None else value.cast("string")).alias("value"),
    ]


def _id(letter: str, key: str) -> Column:
    return F.concat(F.lit(letter), F.col(key).cast("string"))


def region_forest(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """region > nation > (customer > order, supplier), one document for each region. ``names`` limits the kinds of node."""
    wanted = names or ("region", "nation", "customer", "supplier", "order")
    nation = table(spark, sf_dir, "nation")
    r, n, c, s, o = _id("r", "n_regionkey"), _id("n", "n_nationkey"), _id("c", "c_custkey"), _id("s", "s_suppkey"), _id("o", "o_orderkey")
    kr, kn, kc = F.col("n_regionkey"), F.col("n_nationkey"), F.col("c_custkey")
    parts = {}
    if "region" in wanted:
        own = _id("r", "r_regionkey")
        parts["region"] = table(spark, sf_dir, "region").select(*node(own, [own], [F.col("r_regionkey")], "region", {"name": F.col("r_name")}))
    if "nation" in wanted:
        parts["nation"] = nation.select(*node(r, [r, n], [kr, kn], "nation", {"name": F.col("n_name")}))
    customers = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    if "customer" in wanted:
        attrs = {"name": F.col("c_name"), "segment": F.col("c_mktsegment"), "balance": F.col("c_acctbal")}
        parts["customer"] = customers.select(*node(r, [r, n, c], [kr, kn, kc], "customer", attrs))
    if "supplier" in wanted:
        found = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        # Suppliers stand after all customers of their nation.
        parts["supplier"] = found.select(*node(r, [r, n, s], [kr, kn, F.col("s_suppkey") + F.lit(1 << 40)], "supplier", {"name": F.col("s_name"), "balance": F.col("s_acctbal")}))
    if "order" in wanted:
        found = table(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == kc)
        attrs = {"priority": F.col("o_orderpriority"), "status": F.col("o_orderstatus"), "total": F.col("o_totalprice")}
        parts["order"] = found.select(*node(r, [r, n, c, o], [kr, kn, kc, F.col("o_orderkey")], "order", attrs))
    return reduce(DataFrame.unionByName, parts.values())


def conversation_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversation > turn, one document for each conversation; a turn's value is its text."""
    turns = table(spark, sf_dir, "conversations")
    d, t = _id("v", "conv_id"), F.concat(_id("v", "conv_id"), F.lit("."), F.col("turn").cast("string"))
    roots = turns.select("conv_id").distinct().select(*node(d, [d], [F.lit(0)], "conversation", {}))
    return roots.unionByName(turns.select(*node(d, [d, t], [F.lit(0), F.col("turn")], "turn", {"role": F.col("role")}, F.col("text"))))


def empty_forest(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], NODE)
