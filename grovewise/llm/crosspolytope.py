"""Near-duplicate vectors by cross-polytope hashing with multiprobe buckets and verified pairs.

A hash rotates a unit vector (three rounds of random signs and a fast Hadamard transform) and names the signed axis
nearest to it; a table concatenates three hashes. A vector is filed under its own bucket and probes the next likeliest
ones. Only (bucket, vector's number) are filed; the vectors themselves go to buckets in which there is something to
compare. Pairs that meet are verified by cosine in double precision, each in one place only: the first table in which
they meet. Equal vectors are one class with a multiplicity, and a bucket emits link counts and a spanning forest of its
links, so output grows with rows and not with pairs. Buckets above ``cell_rows`` rows are cut into cells that compare
two parts each.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovewise.llm.cells import Forest, blocks, cell_runs, dealt_to_cells, pairs, whole_cells
from grovewise.llm.common import stored
from grovewise.llm.components import connected_components
from grovewise.llm.shingles import mixed

CODED = "node long, label string, width int, id long, copies long, v binary, buckets array<long>, codes binary"
HASHES = 3  # of a table
FEW = 64  # cells up to so many rows are compared many at once, larger ones in blocks


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row; the width is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(n, d)
        h *= 2
    return x


def codes_of(x: np.ndarray, tables: int, probes: int, seed: int) -> np.ndarray:
    """(rows, tables, probes) bucket codes, the own bucket first, then by what the probe gives up.

    A code is a 32-bit number of the axes named: the number itself up to 812 dimensions, beyond that a hash of it.
    """
    n, d = x.shape
    width = 1 << max(1, (d - 1).bit_length())
    padded = np.zeros((n, width))
    padded[:, :d] = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    rng, out = np.random.default_rng(seed), np.empty((n, tables, probes), dtype=np.uint32)
    each = min(2 * width, max(2, probes))
    for t in range(tables):
        code, cost = np.zeros((n, 1), dtype=np.uint64), np.zeros((n, 1))
        for _ in range(HASHES):
            y = padded
            for _ in range(3):
                y = hadamard(y * rng.choice((-1.0, 1.0), width)) / np.sqrt(width)
            signed = np.concatenate((y, -y), axis=1)
            best = np.argpartition(-signed, each - 1, axis=1)[:, :each]
            best = np.take_along_axis(best, np.argsort(-np.take_along_axis(signed, best, axis=1), axis=1, kind="stable"), axis=1)
            value = np.take_along_axis(signed, best, axis=1)
            cost = (cost[:, :, None] + np.square(value[:, :1] - value)[:, None, :]).reshape(n, -1)
            code = (code[:, :, None] * np.uint64(2 * width) + best[:, None, :].astype(np.uint64)).reshape(n, -1)
            order = np.argsort(cost, axis=1, kind="stable")[:, :probes]
            cost, code = np.take_along_axis(cost, order, axis=1), np.take_along_axis(code, order, axis=1)
        out[:, t] = (code if (2 * width) ** HASHES <= 1 << 32 else mixed(code) >> np.uint64(32)).astype(np.uint32)
    return out


def _coded(tables: int, probes: int, seed: int):
    """Rows (node, label, width, id, copies, v) with their codes and, for each place in them, the bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (b.slice(at, 2048) for b in batches for at in range(0, b.num_rows, 2048)):
            widths = part.column("width").to_numpy(zero_copy_only=False)
            for d in np.unique(widths).tolist():
                some = part.filter(pa.array(widths == d))
                x = some.column("v").flatten().to_numpy(zero_copy_only=False).reshape(some.num_rows, d)
                codes = codes_of(x.astype(np.float64), tables, probes, seed)
                tag = some.column("tag").to_numpy(zero_copy_only=False).view(np.uint64)
                table = np.arange(tables, dtype=np.uint64)[:, None]
                bucket = mixed(mixed(tag[:, None, None] + table) ^ codes).view(np.int64).reshape(some.num_rows, -1)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(some.num_rows + 1, dtype=np.int32) * (tables * probes)), pa.array(bucket.ravel()))
                kept = [some.column(k) for k in ("node", "label", "width", "id", "copies")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array([r.tobytes() for r in x], pa.binary()), flat, pa.array([r.tobytes() for r in codes], pa.binary())], names=[c.split()[0] for c in CODED.split(", ")])

    return run


def _matrix(cells: pa.Table, element: str) -> np.ndarray:
    """The cells' vectors at length 1; shorter ones are filled up with zeros, which changes no cosine."""
    widths = cells.column("width").to_numpy()
    x = np.zeros((len(widths), int(widths.max())))
    for d in np.unique(widths).tolist():
        some = np.flatnonzero(widths == d)
        x[some, :d] = np.frombuffer(b"".join(cells.column("v").take(pa.array(some)).to_pylist()), dtype=element).reshape(len(some), d)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _verify(tables: int, probes: int, least: float, element: str):
    """Sorted rows of whole cells to link counts (node, n) and forest edges (a, b)."""

    def flush(cells: pa.Table) -> pa.RecordBatch:
        start, size, part, across = cell_runs(cells, "bucket")
        node, ids, copies, width, pos = (cells.column(k).to_numpy() for k in ("node", "id", "copies", "width", "pos"))
        label = cells.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
        x = _matrix(cells, element)
        codes = np.frombuffer(b"".join(cells.column("codes").to_pylist()), dtype=np.uint32).reshape(len(node), tables, probes)
        table, own = pos // probes, pos % probes == 0
        code = codes.reshape(len(node), -1)[np.arange(len(node)), pos]
        n_links, links = np.zeros(len(node), dtype=np.int64), Forest()
        some = np.add.reduceat(own.astype(np.int64), start) > 0
        few = size <= FEW
        met_in = lambda i, j, t: (codes[i, t] == codes[j, t][:, :1]).any(axis=1) | (codes[j, t] == codes[i, t][:, :1]).any(axis=1)
        for i, j in chain(pairs(start[some & few], size[some & few]), blocks(start[some & ~few], size[some & ~few], x, least - 1e-9)):
            fit = (own[i] | own[j]) & (node[i] != node[j]) & (across[i] == (part[i] != part[j]))
            fit &= (label[i] == label[j]) & (width[i] == width[j]) & (table[i] == table[j]) & (code[i] == code[j])
            i, j = i[fit], j[fit]
            near = np.einsum("ij,ij->i", x[i], x[j]) >= least
            i, j = i[near], j[near]
            swap = node[i] > node[j]
            i, j = np.where(swap, j, i), np.where(swap, i, j)  # the smaller number first
            for t in range(tables):  # pairs that met in an earlier table are counted there
                earlier = table[i] > t
                if not earlier.any():
                    break
                new = np.ones(len(i), dtype=bool)
                new[earlier] = ~met_in(i[earlier], j[earlier], t)
                i, j = i[new], j[new]
            # In a table they may meet in either's own bucket; that of the smaller number counts if both hold.
            here = table[i]
            base = codes[i, here, 0]
            at = np.where((codes[j, here] == base[:, None]).any(axis=1), base, codes[j, here, 0])
            good = code[i] == at
            i, j = i[good], j[good]
            np.add.at(n_links, i, copies[j])
            np.add.at(n_links, j, copies[i])
            links.add(ids[i], ids[j])
        found = np.flatnonzero(n_links)
        ends = links.links()
        counted = [pa.concat_arrays([pa.array(c[found]), pa.nulls(len(ends[0]), pa.int64())]) for c in (node, n_links)]
        linked = [pa.concat_arrays([pa.nulls(len(found), pa.int64()), pa.array(e, pa.int64())]) for e in ends]
        columns = [*counted, *linked]
        return pa.RecordBatch.from_arrays(columns, names=["node", "n", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(flush, whole_cells(batches, "bucket"))

    return run


def _plain(c: Column, element: str) -> Column:
    """Minus zero as zero, so that equal vectors have equal bytes."""
    x = c.cast(element)
    return F.when(x == 0, F.lit(0).cast(element)).otherwise(x)


def near_vectors(
    embeddings: DataFrame, least: float = 0.93, tables: int = 16, probes: int = 2, cell_rows: int = 8192, seed: int = 7,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``embeddings`` (vec_id, embedding, label).

    Only vectors of equal, non-null labels and of one width are compared; labels may be of any type. Null or zero
    vectors, those with null or non-finite components and those without a label or an id link with nothing. Repeated
    rows are vectors like any other: each links to its equals. Rows that share an id are one place for what is
    reachable, whatever their vectors; each has its own links. Other columns are ignored. An empty table gives no rows.

    Of pairs with a cosine of exactly 0.93 about 1 in 1,000 never meet in 64 dimensions; nearer ones are missed far less.
    """
    kind = dict(embeddings.dtypes)["embedding"]
    element = "float" if kind == "array<float>" else "double"
    sound = F.col("embedding").isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull() & ~F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    usable = F.coalesce(sound & F.exists("embedding", lambda c: c != 0), F.lit(False))
    rows = embeddings.where(usable).select("vec_id", F.col("label").cast("string").alias("label"), F.transform("embedding", lambda c: _plain(c, element)).alias("v"))
    # 128 bits of hashes stand for a vector with its label where rows look for their class.
    keys = [F.xxhash64("label", "v").alias("key_a"), F.xxhash64("v", F.lit(1), "label").alias("key_b")]
    merged = rows.groupBy("label", "v").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"))
    merged = merged.select("label", F.size("v").alias("width"), "id", "copies", "v", *keys).repartition(max(1, -(-embeddings.count() // 8192)), "key_a")
    merged = stored(merged.withColumn("node", F.monotonically_increasing_id()).withColumn("tag", F.xxhash64("label", "width")), "vectors-merged")
    members = rows.select("vec_id", *keys).join(merged.select("key_a", "key_b", "node", "id", "copies"), ["key_a", "key_b"]).select("vec_id", "node", "id", "copies")
    classes = stored(merged.select("node", "label", "width", "id", "copies", "v", "tag").mapInArrow(_coded(tables, probes, seed), CODED), "vectors-classes")

    filed = classes.select("node", F.posexplode("buckets").alias("pos", "bucket"))
    own = F.max(F.col("pos") % probes == 0)
    sizes = filed.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"), own.alias("any_own")).where("rows > 1 and any_own")
    sizes = stored(sizes, "vectors-buckets")
    cells = dealt_to_cells(filed, sizes, "bucket", "node", cell_rows, carry=lambda c: c.join(classes.drop("buckets"), "node"))
    found = stored(cells.mapInArrow(_verify(tables, probes, least, "<f4" if element == "float" else "<f8"), "node long, n long, a long, b long"), "vectors-links")

    counts = found.where("n is not null").groupBy("node").agg(F.sum("n").alias("n"))
    shared = members.groupBy("vec_id").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high").select("vec_id")
    same = members.join(shared, "vec_id", "left_semi").select(F.col("vec_id").alias("a"), F.col("id").alias("b"))
    roots = connected_components(found.where("a is not null").select("a", "b").unionByName(same))
    linked = members.join(counts, "node", "left").join(roots.withColumnRenamed("node", "id"), "id", "left")
    linked = linked.select(
        "vec_id", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"),
    )
    alone = embeddings.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
