"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Every source has a target in words: the whole corpus shared by weight, no source above `repeats` times its own
size, the excess shared again by weight. A source is taken whole as often as its target allows, and once more in
part: documents stand in the order of a hash of doc_id, and the part is the prefix whose words come nearest
to what is left of the target. Each pass over a source is cut into BLOCKS blocks by the leading bits of that hash; the
blocks of the whole passes and of the partial one up to its end are the urn. A binary tree of nodes splits the exact numbers of blocks of each source: half of a
node's blocks, drawn without replacement, go left, so that the counts of the sources follow the multivariate hypergeometric law. The
leaves are the output shards; each draws disjoint blocks from the permuted list of every source, and its rows are shuffled locally. A document is taken as often as its block has been drawn.

Defined results: a null text has size 0; null is a source of its own, the last one; rows that repeat a doc_id stand at one place
of the order and are taken together, as do null ids; sources without words have target 0; texts of any length count whole; an empty table gives no rows; other columns, whatever their names, are kept by
`materialise` and ignored by `plan`. Reruns agree, as nothing depends on partitions.

Plan: one pass counts words and keeps four narrow columns. All sums are grouped with partial aggregates: by (source, block),
then, in each source's boundary block alone, by finer pieces of the hash, so that no window holds more than a few thousand
rows of a source of any size. What decides about a row is a small table by source and one by (source, block), with BLOCKS rows
a source; they are joined by broadcast when their counted rows stay below SMALL, else by a shuffle on (source, block).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import NON_BLANK, stored

WEIGHTS = (5, 2, 1)
BLOCKS = 256
SMALL = 500_000
_HEX = 15  # digits of the hash: 60 bits
_BLOCK_BITS, _PIECE_BITS = 60 - 8, 60 - 8 - 12
_BUCKET_BITS = 12


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(NON_BLANK)), F.lit(0)).cast("bigint")


def place_of(doc_id: Column) -> Column:
    """Place of a document in its source's order: 60 bits of the MD5 of its id as text."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, _HEX), 16, 10).cast("bigint")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, repeats: int = 3) -> DataFrame:
    """sizes: source, source_size, a row a source. Adds weight and target. The capped shares are min(repeats * size, level * weight);
    the level follows from running sums over the sources in order of the level at which each is capped: the first, and highest, that caps no later source."""
    ranked = sizes.withColumn("n", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.withColumn("weight", F.element_at(cycle, (F.col("n") - 1) % len(weights) + 1)).withColumn("most", F.col("source_size") * float(repeats))
    by_cap = W.orderBy(F.col("most") / F.col("weight"), "n").rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy(F.lit(1))
    before = F.coalesce(F.sum("most").over(by_cap), F.lit(0.0))
    left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_cap), F.lit(0.0))
    ranked = ranked.withColumn("level", (F.sum(F.col("source_size").cast("double")).over(everything) - before) / left)
    ranked = ranked.withColumn("level", F.max(F.when(F.col("level") <= F.col("most") / F.col("weight"), F.col("level"))).over(everything))
    return ranked.select("source", "source_size", "weight", F.least(F.col("most"), F.coalesce(F.col("level") * F.col("weight"), F.col("most"))).alias("target"))


def _cut(rows: DataFrame, by: list[str], bits: int) -> DataFrame:
    """rows: by, remainder, size, place. The piece of the hash that the remainder ends in, by running sums over pieces:
    adds piece and what is left of the remainder there."""
    pieces = rows.groupBy(*by, "remainder", F.shiftright("place", bits).alias("piece")).agg(F.sum("size").alias("words"))
    w = W.partitionBy(*by).orderBy("piece")
    pieces = pieces.withColumn("upto", F.sum("words").over(w)).withColumn("rest", F.col("remainder") - (F.col("upto") - F.col("words")))
    ends = pieces.where("upto >= remainder").withColumn("k", F.row_number().over(w)).where("k = 1")
    return ends.select(*by, "piece", F.col("rest").alias("remainder"))


def source_plan(slim: DataFrame, weights: tuple = WEIGHTS, repeats: int = 3) -> DataFrame:
    """A row a source: source_size, target, passes (whole passes) and last (the last place that the partial pass takes, or -1)."""
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = targets(sizes, weights, repeats).withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint"))
    plan = stored(plan.withColumn("remainder", F.col("target") - F.col("passes") * F.col("source_size")).withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null"))))
    rows = slim.withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null"))).select("key", "size", "place")
    small = plan.where("remainder > 0").select("key", "remainder")
    hint = F.broadcast if plan.count() <= SMALL else lambda x: x
    block = _cut(rows.join(hint(small), "key"), ["key"], _BLOCK_BITS)
    inside = rows.withColumn("piece", F.shiftright("place", _BLOCK_BITS)).join(hint(block), ["key", "piece"]).drop("piece")
    fine = _cut(inside, ["key"], _PIECE_BITS)
    last = rows.withColumn("piece", F.shiftright("place", _PIECE_BITS)).join(hint(fine), ["key", "piece"])
    last = last.groupBy("key", "piece", "remainder", "place").agg(F.sum("size").alias("words"))
    last = last.withColumn("upto", F.sum("words").over(W.partitionBy("key").orderBy("place")))
    last = last.groupBy("key").agg(F.min("piece").alias("piece"), F.max(F.when(F.col("upto") - F.col("words") / 2 <= F.col("remainder"), F.col("place"))).alias("found"))
    last = last.select("key", F.coalesce("found", F.shiftleft("piece", _PIECE_BITS) - 1).alias("last"))
    return plan.join(last, "key", "left").select("key", "source_size", "target", "passes", F.coalesce("last", F.lit(-1)).cast("bigint").alias("last"))


def _left_half(balls: DataFrame, seed: int, level: int) -> DataFrame:
    """balls: node, key, ball. side: 0 for half of each node's balls, drawn without replacement (those of least hash), 1 for the others. The hash at which a node is
    halved is found from counts by its leading bits, so no window holds more than the balls of one hash bucket of a node."""
    hashed = balls.withColumn("h", F.xxhash64(F.lit(seed), F.lit(level), "node", "key", "ball")).withColumn("bucket", F.shiftrightunsigned("h", 64 - _BUCKET_BITS))
    counts = hashed.groupBy("node", "bucket").agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("node")
    cut = counts.withColumn("upto", F.sum("n").over(w.orderBy("bucket"))).withColumn("half", F.floor(F.sum("n").over(w) / 2))
    cut = cut.where("upto > half").groupBy("node").agg(F.min("bucket").alias("cut"), F.min_by(F.col("half") - (F.col("upto") - F.col("n")), "bucket").alias("rest"))
    hashed = hashed.join(F.broadcast(cut), "node")  # a row a node, at most as many as there are shards
    order = F.row_number().over(W.partitionBy("node").orderBy("h", "key", "ball"))
    inside = hashed.where("bucket = cut").withColumn("side", (order > F.col("rest")).cast("int"))
    return hashed.where("bucket <> cut").withColumn("side", (F.col("bucket") > F.col("cut")).cast("int")).unionByName(inside).select("node", "key", "side")


def shards_of(plan: DataFrame, shards: int = 32, seed: int = 0) -> DataFrame:
    """key, block, shards: the shard of each time that the mix takes the block, whole passes first. Leaves of a splitting tree over the urn of all blocks that the mix takes."""
    units = plan.select("key", "last", F.explode(F.sequence(F.lit(1), (F.col("passes") + 1).cast("int"))).alias("pass"), "passes")
    units = units.select("key", "last", "pass", "passes", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("block"))
    units = units.where((F.col("pass") <= F.col("passes")) | ((F.col("last") >= 0) & (F.col("block") <= F.shiftright("last", _BLOCK_BITS)))).select("key", "pass", "block")
    quota = units.groupBy("key").agg(F.count(F.lit(1)).alias("n")).select(F.lit(0).alias("node"), "key", "n")
    for level in range((shards - 1).bit_length()):
        balls = quota.select("node", "key", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("ball"))
        side = _left_half(balls, seed, level).select((F.col("node") * 2 + F.col("side")).alias("node"), "key")
        quota = stored(side.groupBy("node", "key").agg(F.count(F.lit(1)).alias("n")))
    quota = quota.withColumn("upto", F.sum("n").over(W.partitionBy("key").orderBy("node")))
    drawn = units.withColumn("k", F.row_number().over(W.partitionBy("key").orderBy(F.xxhash64(F.lit(seed), "key", "pass", "block"), "pass", "block")))
    drawn = drawn.join(quota, "key").where((F.col("k") <= F.col("upto")) & (F.col("k") > F.col("upto") - F.col("n")))
    drawn = drawn.groupBy("key", "block").agg(F.array_sort(F.collect_list(F.struct("pass", "node"))).alias("all"))
    return drawn.select("key", "block", F.col("all.node").alias("shards"))


def _decided(rows: DataFrame, slim: DataFrame, weights: tuple, repeats: int, shards: int, seed: int) -> DataFrame:
    """rows with source_size, target, shards (of each time the document is taken) and times. A document is taken as often as the tree has drawn its block; in the block where the
    partial pass ends, documents behind the last one are not taken that once more."""
    plan = stored(source_plan(slim, weights, repeats))
    tree = stored(shards_of(plan, shards, seed))
    hint = F.broadcast if tree.count() <= SMALL else lambda x: x
    rows = rows.withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null"))).withColumn("block", F.shiftright("place", _BLOCK_BITS).cast("int"))
    out = rows.join(hint(plan), "key").join(hint(tree), ["key", "block"], "left").withColumn("shards", F.coalesce("shards", F.array().cast("array<int>")))
    behind = (F.col("last") >= 0) & (F.col("block") == F.shiftright("last", _BLOCK_BITS)) & (F.col("place") > F.col("last"))
    return out.withColumn("times", F.size("shards") - behind.cast("int")).withColumn("shards", F.slice("shards", 1, F.col("times")))


def plan(docs: DataFrame, weights: tuple = WEIGHTS, repeats: int = 3, shards: int = 32, seed: int = 0) -> DataFrame:
    """doc_id, size, source_size, target, taken and shards (of each time the document is taken) of every row of docs."""
    slim = stored(docs.select("doc_id", F.col("source").cast("string").alias("source"), size_of(F.col("text")).alias("size"), place_of(F.col("doc_id")).alias("place")))
    out = _decided(slim, slim, weights, repeats, shards, seed)
    return out.select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"), "shards")


def materialise(docs: DataFrame, weights: tuple = WEIGHTS, repeats: int = 3, shards: int = 32, seed: int = 0) -> DataFrame:
    """The mix itself: the rows of docs, each as often as it is taken, dealt out by shard and shuffled within each partition."""
    slim = stored(docs.select(F.col("source").cast("string").alias("source"), size_of(F.col("text")).alias("size"), place_of(F.col("doc_id")).alias("place")))
    own = docs.select(F.struct(*docs.columns).alias("row"), F.col("source").cast("string").alias("source"), place_of(F.col("doc_id")).alias("place"))
    out = _decided(own, slim, weights, repeats, shards, seed).where("times > 0")
    out = out.select("row", "place", F.posexplode("shards").alias("time", "shard"))
    out = out.repartition("shard").sortWithinPartitions("shard", F.xxhash64(F.lit(seed), "place", "time"))
    return out.select("row.*")
