"""Mixing sources to target weights with DataFrame functions only.

Every source is one long stream of its documents' words, cut into blocks of a fixed number of words. Each source asks
for as many slots as its target needs; output shards have a fixed number of slots each.

1. Draw: each slot of each shard draws a source with the sources' shares, by a seeded hash, so a shard's source counts
   are multinomial.
2. Number: a source's slots are numbered by running sums over the shards' counts.
3. Correct: multinomial totals miss the targets by about their square root. A source drawn too often gives up slots,
   evenly spaced over its numbers, and sources drawn too seldom take them over, so totals are as asked for, also of small
   sources. All but those few slots stay as drawn.
4. Map: slot number k of a source reads block perm(k mod blocks). The permutation visits every block once before any
   block again, so no block, and no document, is used more than ceil(slots / blocks) times.
5. Join: what is taken of a document are the words of its pieces in the blocks that slots read.

Permutations of blocks are ``(p * x + q) mod n`` with ``p`` a prime above every possible ``n``: coprime to ``n``, hence
bijective.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grovewise.llm.common import buckets_for, running_sums, stored, word_count

#: Primes above 2**60, for the permutations; one is taken by a hash of the source's rank.
PRIMES = (1152921504606847009, 1152921504606847067, 1152921504606847081, 1152921504606847123)
BIG = "decimal(38,0)"


@dataclass
class Mix:
    """``sources``: one row each with size, target and slots asked for; ``pieces``: overlap of documents and blocks;
    ``slots``: shard, place in the shard, source drawn, source after correction, number k and block;
    ``documents``: words taken of each and the first shard that takes some."""

    sources: DataFrame
    slots: DataFrame
    pieces: DataFrame
    documents: DataFrame


def _permuted(x: Column, n: Column, key: Column, seed: int) -> Column:
    pick = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(len(PRIMES)))
    p = F.element_at(F.array(*[F.lit(v) for v in PRIMES]), (pick + 1).cast("int"))
    q = F.pmod(F.xxhash64(key, F.lit(seed + 1)), n)
    return F.pmod(F.pmod(p, n).cast(BIG) * x.cast(BIG) + q.cast(BIG), n.cast(BIG)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), limit: int = 3, share: float = 1.0) -> DataFrame:
    """Per source: rank by code point (null last), size, weight and target.

    ``share`` of all words is split by weight; a target stops at ``limit`` times its source's size and the excess is
    split again by weight among the others. In order of ``limit * size / weight`` the stopped sources come first, so
    one running sum finds the level at which the rest is paid.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = by_source.withColumn("source_no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    everything = Window.partitionBy(F.lit(0))
    by_ratio = everything.orderBy("ratio", "source_no")
    level = (
        ranked.withColumn("weight", w)
        .withColumn("most", F.col("source_size") * F.lit(float(limit)))
        .withColumn("ratio", F.col("most") / F.col("weight"))
        .withColumn("pay", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("before", F.sum("most").over(by_ratio) - F.col("most"))
        .withColumn("rest", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("pay") - F.col("before")) / F.col("rest"))
        .withColumn("stopped", F.col("level") > F.col("ratio"))
        .withColumn("place", F.row_number().over(by_ratio))
        .withColumn("paid", F.min_by(F.when(~F.col("stopped"), F.col("level")), F.when(~F.col("stopped"), F.col("place"))).over(everything))
    )
    target = F.when(F.col("stopped"), F.col("most")).otherwise(F.least("most", F.col("weight") * F.col("paid")))
    return level.select("source", "source_no", "source_size", "weight", target.alias("target"))


def _laid_out(ranges: DataFrame, length: str, order: str) -> DataFrame:
    """``ranges`` with ``first`` and ``end``: they follow each other in the order given; empty ones are left out."""
    upto = F.sum(length).over(Window.orderBy(order))
    return ranges.withColumn("end", upto).withColumn("first", F.col("end") - F.col(length)).where(F.col(length) > 0)


def _within(points: DataFrame, at: str, ranges: DataFrame, total: int, n_ranges: int) -> DataFrame:
    """Each point with the range (``first`` to ``end``) that holds it: an equi-join on cells of as many numbers as a
    range has on average, so a cell holds few ranges and a range few cells. Spark broadcasts ``ranges`` where small."""
    width = max(1, -(-total // max(1, n_ranges)))
    cells = ranges.withColumn("cell", F.explode(F.sequence(F.floor(F.col("first") / width), F.floor((F.col("end") - 1) / width))))
    found = points.withColumn("cell", F.floor(F.col(at) / width)).join(cells, "cell")
    return found.where((F.col(at) >= F.col("first")) & (F.col(at) < F.col("end"))).drop("cell", "first", "end", at)


def draw_slots(src: DataFrame, shard_slots: int, seed: int) -> DataFrame:
    """(shard, slot, drawn, source_no, k, blocks) from (source_no, blocks, n_slots), ``n_slots`` of each source in all."""
    n_sources, total = src.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_slots"), F.lit(0))).first()
    n_shards = -(-total // shard_slots)
    tasks = max(1, -(-n_shards // 64))
    shards = src.sparkSession.range(n_shards).select(F.col("id").alias("shard")).repartition(tasks, "shard")
    here = F.least(F.lit(shard_slots), F.lit(total) - F.col("shard") * shard_slots)
    slots = shards.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), here - 1)))
    slots = slots.withColumn("u", F.pmod(F.xxhash64("shard", "slot", F.lit(seed + 2)), F.lit(total)))
    shares = stored(_laid_out(src.select("source_no", "blocks", "n_slots"), "n_slots", "source_no"), "mix-shares")
    drawn = _within(slots, "u", shares, total, n_sources)

    counts = stored(drawn.groupBy("shard", "source_no").agg(F.count(F.lit(1)).alias("n")), "mix-counts")
    before = running_sums(counts, ["source_no"], "shard", "n", "k_before").drop("n")
    at = F.row_number().over(Window.partitionBy("shard", "source_no").orderBy("slot")) - 1
    numbered = drawn.withColumn("at", at).join(before, ["shard", "source_no"]).withColumn("k", F.col("k_before") + F.col("at"))

    missed = shares.join(counts.groupBy("source_no").agg(F.sum("n").alias("n")), "source_no", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    missed = missed.withColumn("over", F.greatest(F.col("n") - F.col("n_slots"), F.lit(0))).withColumn("under", F.greatest(F.col("n_slots") - F.col("n"), F.lit(0)))
    given = missed.select("source_no", "n", "over", (F.sum("over").over(Window.orderBy("source_no")) - F.col("over")).alias("over_before"))
    given = stored(given, "mix-given")
    # Number k is given up where k * over / n passes a whole number; floor(k * over / n) were given up before.
    gone = lambda k: F.expr(f"cast({k} as {BIG}) * over div n")
    numbered = numbered.join(given, "source_no").withColumn("gone", gone("k")).withColumn("gives", gone("(k + 1)") > F.col("gone"))
    numbered = stored(numbered.select("shard", "slot", "source_no", "blocks", "k", "gone", "gives", "over_before", "n_slots"), "mix-slots")
    kept = numbered.where("not gives").select("shard", "slot", F.col("source_no").alias("drawn"), "source_no", (F.col("k") - F.col("gone")).alias("k"), "blocks")
    n_over = given.agg(F.coalesce(F.sum("over"), F.lit(0))).first()[0]
    takers = stored(_laid_out(missed.select("source_no", "blocks", "n", "under"), "under", "source_no").withColumn("start", F.col("first")), "mix-takers")
    moved = numbered.where("gives").select("shard", "slot", F.col("source_no").alias("drawn"), (F.col("over_before") + F.col("gone")).alias("j"), (F.col("over_before") + F.col("gone")).alias("nth"))
    moved = _within(moved, "j", takers, n_over, takers.count())
    return kept.unionByName(moved.select("shard", "slot", "drawn", "source_no", (F.col("n") + F.col("nth") - F.col("start")).alias("k"), "blocks"))


def mix_sources(
    docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), limit: int = 3, share: float = 1.0,
    block_words: int = 128, shard_slots: int = 4096, seed: int = 42,
) -> Mix:
    """Mix ``docs`` (doc_id, text, source; further columns are ignored) to the weights of their sources.

    Null and empty texts have size 0 and are never taken; null is a source of its own; rows with a null id and repeated
    rows count each; an empty table gives empty results. Results depend on the rows and ``seed`` only, not on their order
    or partitions. Rows, blocks and slots may be any number; sources are ranked by one window, so their number should
    stay at what one task can sort.
    """
    sizes = stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    buckets = buckets_for(sizes.count())
    src = targets(sizes, weights, limit, share).withColumn("blocks", F.ceil(F.col("source_size") / block_words))
    slots_of = F.least(F.round(F.col("target") * F.col("blocks") / F.col("source_size")), F.col("blocks") * limit)
    src = src.withColumn("n_slots", F.when(F.col("source_size") > 0, slots_of).otherwise(F.lit(0)).cast("long"))
    src = stored(src, "mix-sources")

    # A document's first word in its source's stream: the words of the buckets before, and of the rows before in its own.
    keyed = sizes.withColumn("bucket", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(buckets)))
    keyed = keyed.join(src.withColumnRenamed("source", "src"), F.col("source").eqNullSafe(F.col("src"))).drop("src", "blocks", "n_slots", "weight")
    sums = keyed.groupBy("source_no", "bucket").agg(F.sum("size").alias("bucket_size"))
    before = running_sums(sums, ["source_no"], "bucket", "bucket_size", "bucket_start").drop("bucket_size")
    within = Window.partitionBy("source_no", "bucket").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = keyed.withColumn("upto", F.sum("size").over(within)).join(before, ["source_no", "bucket"]).withColumn("start", F.col("bucket_start") + F.col("upto") - F.col("size"))
    keep = ["doc_id", "source_no", "size", "source_size", "target", "start"]
    placed = placed.select(*keep)

    lo, hi = F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words)
    pieces = placed.where("size > 0").withColumn("block", F.explode(F.sequence(lo, hi)))
    overlap = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words) - F.greatest(F.col("start"), F.col("block") * block_words)
    pieces = pieces.withColumn("words", overlap)

    slots = draw_slots(src, shard_slots, seed)
    block = _permuted(F.pmod(F.col("k"), F.col("blocks")), F.col("blocks"), F.col("source_no"), seed)
    slots = slots.select("shard", "slot", "drawn", "source_no", "k", block.alias("block"))

    # Both sides grow with the input: never broadcast.
    uses = slots.groupBy("source_no", "block").agg(F.count(F.lit(1)).alias("uses"), F.min("shard").alias("shard")).hint("merge")
    taken = pieces.join(uses, ["source_no", "block"], "left").groupBy(*keep).agg(
        F.coalesce(F.sum(F.col("words") * F.col("uses")), F.lit(0)).alias("taken"), F.min("shard").alias("first_shard"),
    )
    documents = taken.unionByName(placed.where("size = 0").withColumn("taken", F.lit(0).cast("long")).withColumn("first_shard", F.lit(None).cast("long")))
    return Mix(src, slots, pieces, documents)


def mixed_documents(docs: DataFrame, seed: int = 42, **how) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; what is left of a whole taking is drawn by the seed.

    Rows are known by a hash of id, source and text, so rows with a null id take part like others, and rows that repeat
    one id with several texts count apart; equal rows share what is taken of them. Texts that are null or without words
    are never taken. Columns of any name stay as they are; an empty table gives no rows.
    """
    inner = [f"c{i}" for i in range(len(docs.columns))]
    of = {name: inner[docs.columns.index(name)] for name in ("doc_id", "text", "source")}
    keyed = docs.toDF(*inner).withColumn("key", F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in of.values()], *[F.col(c).isNull() for c in of.values()]))
    mix = mix_sources(keyed.select(F.col("key").alias("doc_id"), F.col(of["text"]).alias("text"), F.col(of["source"]).alias("source")), seed=seed, **how)
    taken = mix.documents.where("taken > 0").groupBy(F.col("doc_id").alias("key")).agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"))
    chance = F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1_000_000)) / 1e6
    times = F.floor(F.col("taken") / F.col("size") + chance).cast("int")
    out = keyed.join(taken, "key").withColumn("nth", F.explode(F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>"))))
    return out.select(*inner).toDF(*docs.columns)
