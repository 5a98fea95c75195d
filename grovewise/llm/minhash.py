"""Near-duplicate documents: universal hash minima, banding, signature verification, full-set confirmation, components.

Texts of equal shingle sets are one class. Classes that share a band's minima are candidates if their signatures nearly
agree (4.5 standard deviations below the threshold at most), and full sets decide. Since components are asked for, a
pair within one component needs no check:

1. each bucket's least class is compared with its other members; these pairs are sorted into parts of equal size, so a
   class that leads large buckets is compared in many tasks, and its text comes once to each;
2. of a bucket that this leaves in several components, the candidate pairs across them are reduced to a spanning forest;
3. candidates of both steps form clusters. Where a cluster still has several components, all its pairs across them are
   compared within cells, which return the links that join components.

So no step returns more rows than it reads, however large a group of near copies is, and no candidate pair that could
join two components goes unchecked.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grovewise.llm.cells import Forest, cell_runs, dealt_to_cells, pairs, whole_cells
from grovewise.llm.common import stored, text_slices
from grovewise.llm.components import connected_components, hot_from, joined_apart
from grovewise.llm.shingles import mixed, shared, shingles_of

SIGNED = "n_shingles long, key_a long, key_b long, bands array<long>, signature binary"
PART_PAIRS = 2048  # pairs of a part that one task compares
CELL_BYTES = 4 << 20  # text of a cell's part
AT_ONCE = 256  # documents shingled at once


def banding(threshold: float, miss: float = 1e-4, most: int = 200) -> tuple[int, int]:
    """(bands, rows): the longest bands of which ``most`` hashes still leave a pair at the threshold out with ``miss``."""
    for rows in range(32, 0, -1):
        bands = ceil(log(miss) / log(1 - threshold**rows))
        if rows * bands <= most:
            return bands, rows
    return most, 1


def _sign(at: int, width: int, bands: int, rows: int, seed: int):
    """Rows, whose text is column ``at``, with the columns of SIGNED."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 2**64, bands * rows, dtype=np.uint64)
    fold = rng.integers(0, 2**63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, at, AT_ONCE):
                sets = shingles_of(part.column(at).cast(pa.large_string()), width)
                size = np.array([len(s) for s in sets], dtype=np.int64)
                full = np.flatnonzero(size)
                minima = np.zeros((len(sets), bands * rows), dtype=np.uint32)
                keys = np.zeros((len(sets), 2), dtype=np.uint64)
                if len(full):
                    every, start = np.concatenate(sets), np.append(0, np.cumsum(size[full])[:-1])
                    keys[full, 0] = np.add.reduceat(mixed(every + np.uint64(1)), start)
                    keys[full, 1] = np.add.reduceat(mixed(every ^ np.uint64(0x5851F42D4C957F2D)), start)
                    for k in range(bands * rows):
                        minima[full, k] = np.minimum.reduceat(((every * a[k] + b[k]) >> np.uint64(32)).astype(np.uint32), start)
                banded = mixed((minima.reshape(-1, bands, rows).astype(np.uint64) * fold).sum(axis=2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64)).view(np.int64)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * bands), pa.array(banded.ravel()))
                signed = keys.view(np.int64)
                yield pa.RecordBatch.from_arrays([
                    *part.columns, pa.array(size), pa.array(np.ascontiguousarray(signed[:, 0])), pa.array(np.ascontiguousarray(signed[:, 1])),
                    flat, pa.array([m.tobytes() for m in minima], pa.binary()),
                ], names=[*part.schema.names, "n_shingles", "key_a", "key_b", "bands", "signature"])

    return run


def _stack(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(len(column), -1)


def _compared(least: float, width: int, percent: int):
    """Rows sorted by (part, a), each hub before its members, to (a, b, good): the pairs whose signatures agree in
    ``least`` of their places, and whether 100 * intersection >= ``percent`` * union on full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minima, whole = None, None
        for batch in (p for b in batches for p in text_slices(b, "text", AT_ONCE)):
            signed, hub, text = _stack(batch.column("signature")), batch.column("hub").to_pylist(), batch.column("text")
            ends = list(zip(batch.column("a").to_pylist(), batch.column("node").to_pylist(), strict=True))
            found: list[tuple[int, int, bool]] = []
            for k, (a, b) in enumerate(ends):
                if hub[k]:
                    minima = signed[k]
                    whole = shingles_of(text.slice(k, 1).cast(pa.large_string()), width)[0]
                elif (signed[k] == minima).mean() >= least:
                    own = shingles_of(text.slice(k, 1).cast(pa.large_string()), width)[0]
                    both = shared(whole, own)
                    found.append((a, b, 100 * both >= percent * (len(whole) + len(own) - both)))
            a, b, good = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(good, pa.bool_())], names=["a", "b", "good"])

    return run


def _across(cells: pa.Table, key: str, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The cells' pairs (i, j) in different components whose signatures agree in ``least`` of their places."""
    start, size, part, across = cell_runs(cells, key)
    component, minima = cells.column("component").to_numpy(), _stack(cells.column("signature"))
    for i, j in pairs(start, size):
        fit = (component[i] != component[j]) & (across[i] == (part[i] != part[j]))
        i, j = i[fit], j[fit]
        near = np.concatenate([(minima[i[k : k + 4096]] == minima[j[k : k + 4096]]).mean(axis=1) >= least for k in range(0, len(i), 4096)] or [np.zeros(0, bool)])
        yield i[near], j[near]


def _agreeing_in_cells(least: float):
    """A spanning forest of the candidate pairs across components of a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cells in whole_cells(batches, "bucket"):
            node = cells.column("node").to_numpy()
            forest = Forest()
            for i, j in _across(cells, "bucket", least):
                forest.add(node[i], node[j])
            b, a = forest.links()
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def _joining_in_cells(least: float, width: int, percent: int):
    """The confirmed links that join components of a cluster, a spanning forest of them in each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cells in whole_cells(batches, "cluster"):
            node, component = cells.column("node").to_numpy(), cells.column("component").to_numpy()
            sets = shingles_of(cells.column("text").combine_chunks(), width)
            joined: dict[int, int] = {}

            def root(c: int) -> int:
                while (up := joined.get(c, c)) != c:
                    joined[c] = c = joined.get(up, up)
                return c

            links = []
            for i, j in _across(cells, "cluster", least):
                for x, y in zip(i.tolist(), j.tolist(), strict=True):
                    p, q = root(component[x]), root(component[y])
                    if p != q:
                        both = shared(sets[x], sets[y])
                        if 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                            joined[max(p, q)] = min(p, q)
                            links.append((node[x], node[y]))
            yield pa.RecordBatch.from_arrays([pa.array([k[n] for k in links], pa.int64()) for n in (0, 1)], names=["a", "b"])

    return run


def _signed(docs: DataFrame, width: int, bands: int, rows: int, seed: int) -> DataFrame:
    """The rows of ``docs`` with a number (``row``) and the columns of SIGNED, stored."""
    schema = T.StructType([*docs.schema.fields, *T._parse_datatype_string(SIGNED).fields])
    signed = docs.mapInArrow(_sign(docs.columns.index("text"), width, bands, rows, seed), schema)
    return stored(signed.withColumn("row", F.monotonically_increasing_id()), "minhash-signed")


def _links(full: DataFrame, width: int, percent: int, bands: int, rows: int, cell_rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """((row, node), links (a, b) between nodes, (node, component)) of signed rows with shingles: a node is the first row
    of a set."""
    least = max(0.0, percent / 100 - 4.5 * sqrt(percent / 100 * (1 - percent / 100) / (bands * rows)))
    keys = ["n_shingles", "key_a", "key_b"]
    heads = stored(full.groupBy(*keys).agg(F.min("row").alias("node"), F.count(F.lit(1)).alias("n")), "minhash-sets")
    total, most = heads.agg(F.coalesce(F.sum("n"), F.lit(0)), F.max("n")).first()
    nodes = stored(joined_apart(full.select("row", *keys), heads, keys, "n", hot_from(total, most)).select("row", "node"), "minhash-nodes")
    filed = full.select(F.col("row").alias("node"), "bands").join(heads.select("node"), "node", "left_semi")
    filed = filed.select("node", F.explode("bands").alias("bucket"))
    buckets = filed.groupBy("bucket").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    members = stored(filed.join(buckets, "bucket"), "minhash-members")
    # Texts and signatures of what shares a bucket, shuffled once; most joins after it need a part of them.
    payload = full.select(F.col("row").alias("node"), "signature", "text").join(members.select("node").distinct().hint("merge"), "node", "left_semi")
    payload = stored(payload, "minhash-payload")

    def compared(pairs_: DataFrame, name: str) -> DataFrame:
        """(a, b, good) of the pairs whose signatures agree."""
        pairs_ = stored(pairs_.select("a", "b").distinct(), f"{name}-pairs")
        n = -(-pairs_.count() // PART_PAIRS)
        if not n:
            return pairs_.withColumn("good", F.lit(True))
        pairs_ = stored(pairs_.repartitionByRange(n, "a", "b").select(F.spark_partition_id().alias("part"), "a", "b"), f"{name}-parts")
        ends = pairs_.select("part", "a", F.col("b").alias("node"), F.lit(False).alias("hub"))
        ends = ends.unionByName(pairs_.select("part", "a").distinct().select("part", "a", F.col("a").alias("node"), F.lit(True).alias("hub")))
        rows_ = ends.join(payload, "node").repartition(n, "part").sortWithinPartitions("part", "a", F.desc("hub"))
        return stored(rows_.mapInArrow(_compared(least, width, percent), "a long, b long, good boolean"), name)

    tried = compared(members.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")), "minhash-hubs")
    linked = tried.where("good").select("a", "b")

    first = stored(connected_components(linked), "minhash-first")
    placed = members.join(first, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    several = F.min("component") != F.max("component")
    sizes = stored(placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"), several.alias("several")).where("several").drop("several"), "minhash-several")
    rest = stored(placed.join(sizes.select("bucket"), "bucket", "left_semi"), "minhash-rest").join(payload.drop("text"), "node")
    forest = dealt_to_cells(rest, sizes, "bucket", "node", cell_rows).mapInArrow(_agreeing_in_cells(least), "a long, b long")
    forest = stored(forest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "minhash-forest")
    clusters = connected_components(tried.select("a", "b").unionByName(forest)).withColumnRenamed("component", "cluster")
    clustered = stored(clusters.join(first, "node", "left").select("cluster", "node", F.coalesce("component", "node").alias("component")), "minhash-clustered")
    sizes = clustered.groupBy("cluster").agg(F.count(F.lit(1)).alias("rows"), several.alias("several")).where("several").drop("several")
    rest = stored(clustered.join(sizes.select("cluster"), "cluster", "left_semi"), "minhash-unjoined")
    if rest.isEmpty():
        return nodes, linked, first
    rest = rest.join(payload, "node")
    sizes = stored(rest.groupBy("cluster").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("text")).alias("bytes")), "minhash-clusters")
    joining = dealt_to_cells(rest, sizes, "cluster", "node", cell_rows // 4, 4096, cell_bytes=CELL_BYTES).mapInArrow(_joining_in_cells(least, width, percent), "a long, b long")
    joining = stored(joining, "minhash-joining")
    if joining.isEmpty():
        return nodes, linked, first
    # Stars in place of all links: the components found so far, and what joins them.
    stars = first.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    return nodes, linked.unionByName(joining), stored(connected_components(stars.unionByName(joining)), "minhash-groups")


def near_documents(docs: DataFrame, width: int = 5, percent: int = 80, cell_rows: int = 1024, seed: int = 11) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text; other columns are ignored).

    Documents whose sets of ``width``-word shingles have 100 * intersection >= ``percent`` * union are linked; a
    component is named by its least doc_id, which alone is kept. Texts that are null, empty or without words have no
    shingles and link with nothing. Rows that repeat an id are one document: it is linked with whatever any of its texts
    is linked with, and it comes back as often as it came, with each row's own set size. Rows with a null doc_id are
    nobody's copy: they come back with a null component and are kept. An empty table gives no rows.
    """
    bands, rows = banding(percent / 100)
    signed = _signed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), width, bands, rows, seed)
    full = signed.where("n_shingles > 0 and doc_id is not null")
    nodes, linked, groups = _links(full, width, percent, bands, rows, cell_rows)
    # Nodes that share an id are linked, each with the least of them.
    owned = stored(full.select("row", "doc_id").join(nodes, "row").select("doc_id", "node"), "minhash-owned")
    several = owned.groupBy("doc_id").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high")
    same = owned.join(several.drop("high"), "doc_id").where("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b"))
    same = stored(same, "minhash-same")
    groups = groups if same.isEmpty() else stored(connected_components(linked.unionByName(same)), "minhash-same-groups")
    # The least id of each group, then of each node: ids are aggregated before they meet a large group.
    least = owned.groupBy("node").agg(F.min("doc_id").alias("id"))
    least = stored(least.join(groups, "node", "left").select("node", "id", F.coalesce("component", "node").alias("component")), "minhash-least")
    named = least.groupBy("component").agg(F.min("id").alias("component_id"))
    names = least.where("node <> component").select("node", "component").join(named, "component").select("node", "component_id")
    names = names.unionByName(named.select(F.col("component").alias("node"), "component_id"))
    names = owned.join(names, "node").select("doc_id", "component_id").distinct()
    known = signed.where("doc_id is not null").select("doc_id", "n_shingles").join(names, "doc_id", "left")
    known = known.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    out = known.unionByName(signed.where("doc_id is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def distinct_documents(docs: DataFrame, width: int = 5, percent: int = 80, cell_rows: int = 1024, seed: int = 11) -> DataFrame:
    """The rows of ``docs``, with all their columns, one of each group of near-duplicate texts.

    Groups are of texts, whatever their ids: of rows that repeat an id with unlike texts each may stay, of equal rows one
    does. The row of the least id stays, null ids last; of several the one of the least hash of all columns. Rows
    without words all stay. Columns may have any names; an empty table gives no rows.
    """
    inner = ["text" if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)]
    id_ = inner[docs.columns.index("doc_id")]
    bands, rows = banding(percent / 100)
    signed = _signed(docs.toDF(*inner), width, bands, rows, seed)
    full = signed.where("n_shingles > 0")
    nodes, _, groups = _links(full, width, percent, bands, rows, cell_rows)
    rank = F.struct(F.col(id_).isNull(), F.col(id_), F.xxhash64(*inner), "row")
    first = full.select("row", rank.alias("rank")).join(nodes, "row").groupBy("node").agg(F.min("rank").alias("rank"))
    first = first.join(groups, "node", "left").groupBy(F.coalesce("component", "node").alias("component")).agg(F.min("rank").alias("rank"))
    kept = signed.join(stored(first.select("rank.row"), "minhash-kept"), "row", "left_semi")
    return kept.unionByName(signed.where("n_shingles = 0")).select(*inner).toDF(*docs.columns)
