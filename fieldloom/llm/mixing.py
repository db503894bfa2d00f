"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree over source blocks."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD, drop_written, written

SEGMENT = 1 << 20  #: blocks of a source that are dealt and permuted together; a larger source has several such strata
BROADCAST_SOURCES = 100_000  #: rows of the table of sources up to which it is broadcast
STRATA = 512  #: strata that one splitting tree deals; their blocks stay below the 10^9 that the draw allows

def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def with_targets(sources: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """sources (no, words, ...) with target: shares of all words by weight, none above most * its size; what is cut off is shared again by weight.

    A source is cut off where most * words / weight is below what a weight of 1 gets, so each round is one sum over the table."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("no") % len(weights) + 1).cast("int"))
    rows = sources.withColumn("weight", weight)
    most_words = F.lit(float(most)) * F.col("words")
    unit = 0.0
    while True:
        is_open = (F.col("words") > 0) & (most_words >= F.lit(unit) * F.col("weight"))
        r = rows.agg(F.sum("words").alias("words"), F.sum(F.when(~is_open, most_words).otherwise(0.0)).alias("cut"), F.sum(F.when(is_open, F.col("weight"))).alias("open")).first()
        new = ((r.words or 0) - (r.cut or 0.0)) / r.open if r.open else unit
        if new <= unit:
            break
        unit = new
    return rows.withColumn("target", F.least(most_words, F.lit(unit) * F.col("weight"))).drop("weight")


def numbered(sources: DataFrame, key: str) -> DataFrame:
    """sources with no: their places in code-point order of the key, null last. Sorted by ranges, so no task holds all of them."""
    spark = sources.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = written(sources.repartitionByRange(parts, F.col(key).asc_nulls_last()).withColumn("part", F.spark_partition_id()), "mix-sources")
    counts = ranged.groupBy("part").agg(F.count("*").alias("n"))  # a row for each partition
    base = counts.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    place = F.row_number().over(W.partitionBy("part").orderBy(F.col(key).asc_nulls_last()))
    return ranged.withColumn("place", place).join(F.broadcast(base), "part").withColumn("no", F.col("base") + F.col("place") - 1).drop("part", "place", "base")


def seed_of(*parts) -> int:
    return int.from_bytes(hashlib.blake2b("|".join(map(str, parts)).encode(), digest_size=8).digest(), "little")


def leaf_quotas(low: int, high: int, quotas: np.ndarray, key: tuple, lo: int, hi: int, before: np.ndarray | None = None):
    """Yields (shard, blocks of each stratum before it, blocks of each stratum in it) for the shards of the tree's node [low, high) that are in [lo, hi).

    A node of the tree holds a range of shards and a quota of blocks for each stratum. Its left half gets a
    multivariate-hypergeometric draw of the node's blocks, in proportion to its shards, and the right half
    the rest, so the quotas of the leaves add up exactly. The draw's seed is the node's range: every task
    that walks a part of the tree draws the same.
    """
    before = np.zeros(len(quotas), np.int64) if before is None else before
    if high <= lo or low >= hi:
        return
    if high - low == 1:
        yield low, before, quotas
        return
    middle, total = (low + high) // 2, int(quotas.sum())
    draw = total * (middle - low) // (high - low)
    rng = np.random.Generator(np.random.PCG64(seed_of(*key, low, high)))
    left = rng.multivariate_hypergeometric(quotas, draw, method="marginals") if total else quotas
    yield from leaf_quotas(low, middle, left, key, lo, hi, before)
    yield from leaf_quotas(middle, high, quotas - left, key, lo, hi, before + left)


def deal(strata: DataFrame, shards: int, seed: int) -> DataFrame:
    """(no, segment, shard, first, count): how many blocks of each stratum (no, segment, n) each shard takes, and how many those before it take.

    STRATA strata share a splitting tree; tasks walk runs of its leaves."""
    run = max(1, min(256, -(-shards // 64)))

    def walk(batches):
        for pdf in batches:
            for tree, lo, no, segment, n in zip(pdf["tree"], pdf["lo"], pdf["no"], pdf["segment"], pdf["n"]):
                no, segment = np.asarray(no), np.asarray(segment)
                for shard, first, count in leaf_quotas(0, shards, np.asarray(n, np.int64), (seed, int(tree)), int(lo), min(int(lo) + run, shards)):
                    own = np.flatnonzero(count)
                    yield pd.DataFrame({"no": no[own], "segment": segment[own], "shard": shard, "first": first[own], "count": count[own]})

    trees = strata.groupBy((F.floor(F.col("stratum") / STRATA)).alias("tree")).agg(F.sort_array(F.collect_list(F.struct("no", "segment", "n"))).alias("s"))  # STRATA at most
    work = trees.select("tree", F.col("s.no").alias("no"), F.col("s.segment").alias("segment"), F.col("s.n").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1), F.lit(run))).alias("lo"))
    parts = max(1, int(strata.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return work.repartition(parts, "tree", "lo").mapInPandas(walk, "no long, segment long, shard long, first long, count long")


def mix_plan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0,
    shard_words: int = 4_000_000, blocks_per_shard: int = 64, bucket_rows: int = 1_500, seed: int = 17, keep: list[str] = (),
) -> DataFrame:
    """One row for every row of docs: id_col, size, source_size, target, copies: array of (epoch, block, shard), and the columns keep.

    size is the number of words (null: 0). Sources in code-point order, null last, weigh weights, repeating,
    and share the words of docs; a target stops at most times its source's size and the excess is shared
    again. A source is laid out as a line of words: its rows in a keyed random order, once per epoch. A copy
    is taken when its middle lies before the target, so the words taken differ from the target by at most half
    of one row, and one copy of the best-fitting row is then added or left out to close that gap. Blocks are
    stretches of the line; splitting trees deal them to shards, each shard takes its own disjoint run of the source's
    permuted blocks (SEGMENT of them at a time in a random order), and rows are shuffled within their shard.
    Equal rows may stand in any order among themselves. Rows without words are never taken. Any number of sources is dealt: they stay a table.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("src"), word_count(F.col(text_col)).alias("size"), F.xxhash64(F.lit(seed), F.col(id_col), F.length(text_col), F.col(text_col)).alias("h"), *[F.col(c).alias(f"k_{c}") for c in keep])
    rows = written(rows, "mix-rows")
    sources = numbered(rows.groupBy("src").agg(F.sum("size").alias("words"), F.count("*").alias("n")), "src")
    sources = written(with_targets(sources, weights, most), "mix-targets")
    total, n_sources = sources.agg(F.coalesce(F.sum("words"), F.lit(0)), F.count("*")).first()
    # so few rows are sent to all tasks, and a hot source needs no shuffle; a larger table is joined by Spark's own choice
    sent = F.broadcast if n_sources <= BROADCAST_SOURCES else lambda table: table
    shards = max(1, -(-total // shard_words))
    block = max(1, min(shard_words // blocks_per_shard, -(-total // (8 * blocks_per_shard))))
    buckets = F.when(F.col("n") < bucket_rows, 1).otherwise(F.pow(F.lit(2.0), F.floor(F.log2(F.floor(F.col("n") / bucket_rows))) + 1)).cast("long")
    table = sources.select(F.col("src").alias("of"), "no", F.col("words").alias("source_size"), "target", buckets.alias("buckets"))
    named = rows.join(sent(table), rows["src"].eqNullSafe(table["of"])).drop("of", "src")

    # where each row starts on its source's line: sums of the buckets before, then of the rows before in the bucket
    named = named.withColumn("bucket", F.floor((F.shiftright("h", 32) + F.lit(2**31)) * F.col("buckets") / F.lit(2**32)))
    before = W.partitionBy("no").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    bases = named.groupBy("no", "bucket").agg(F.sum("size").alias("words")).select("no", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    inside = W.partitionBy("no", "bucket").orderBy("h", "id").rowsBetween(W.unboundedPreceding, -1)
    placed = named.withColumn("own", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(bases, ["no", "bucket"]).withColumn("at", F.col("base") + F.col("own"))
    middle = lambda e: e * F.col("source_size") + F.col("at") + F.col("size") / 2
    epochs = F.filter(F.sequence(F.lit(0), F.lit(math.ceil(most) - 1)), lambda e: (F.col("size") > 0) & (middle(e) < F.col("target")))
    placed = placed.withColumn("epochs", F.transform(epochs, lambda e: F.struct(e.alias("epoch"), F.floor(middle(e) / block).alias("block"))))
    placed = written(placed.withColumn("row", F.monotonically_increasing_id()).select("row", "id", "no", "size", "source_size", "target", "h", "epochs", *[f"k_{c}" for c in keep]), "mix-placed")
    drop_written(rows)

    # the row on the border may be large: one copy more or less of the row that fits best closes most of the gap, and again
    for _ in range(2):
        gaps = placed.groupBy("no").agg((F.first("target") - F.sum(F.size("epochs") * F.col("size"))).alias("gap"))
        after = F.abs(F.col("gap") - F.signum("gap") * F.col("size"))
        able = (F.col("size") > 0) & (after < F.abs("gap")) & F.when(F.col("gap") > 0, F.size("epochs") < math.floor(most)).otherwise(F.size("epochs") > 0)
        fixes = placed.join(sent(gaps), "no").filter(able).groupBy("no").agg(F.min_by(F.struct("row", "gap"), F.struct(after, "h", "row")).alias("fix"))
        fixes = fixes.select(F.col("fix.row").alias("row"), F.col("fix.gap").alias("gap"))  # a row for each source
        last = F.floor((F.col("target") - 0.001) / block)
        more = F.array(F.struct(F.size("epochs").alias("epoch"), F.greatest(last, F.lit(0)).alias("block")))
        changed = F.when(F.col("gap") > 0, F.concat("epochs", more)).when(F.col("gap") < 0, F.slice("epochs", 1, F.size("epochs") - 1)).otherwise(F.col("epochs"))
        placed = placed.join(sent(fixes), "row", "left").withColumn("epochs", changed).drop("gap")

    blocks = F.ceil(F.col("target") / block)
    strata = sources.filter("target > 0").select("no", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((blocks - 1) / SEGMENT))).alias("segment"), blocks.alias("blocks"))
    strata = strata.select("no", "segment", F.least(F.col("blocks") - F.col("segment") * SEGMENT, F.lit(SEGMENT)).alias("n"))
    # the further segments of large sources are dealt in trees of their own
    strata = strata.withColumn("stratum", F.when(F.col("segment") == 0, F.col("no")).otherwise(F.abs(F.xxhash64("no", "segment")) % F.lit(1 << 40) + F.lit(1 << 41)))
    dealt = deal(strata, shards, seed).select("no", "segment", "shard", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("count") - 1)).alias("p"))
    order = W.partitionBy("no", "segment").orderBy(F.xxhash64(F.lit(seed), "no", "block"), "block")  # SEGMENT rows at most
    turned = strata.select("no", "segment", F.explode(F.sequence(F.col("segment") * SEGMENT, F.col("segment") * SEGMENT + F.col("n") - 1)).alias("block"))
    turned = turned.select("no", "segment", "block", (F.row_number().over(order) - 1).cast("long").alias("p"))
    dealt = dealt.join(turned, ["no", "segment", "p"]).select("no", "shard", "block")

    taken = placed.select("row", "no", F.explode("epochs").alias("e")).select("row", "no", "e.epoch", "e.block").join(dealt, ["no", "block"])
    taken = taken.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("epoch", "block", "shard"))).alias("copies"))
    none = F.array().cast("array<struct<epoch:int,block:bigint,shard:bigint>>")
    out = placed.join(taken, "row", "left")
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", F.coalesce("copies", none).alias("copies"), *[F.col(f"k_{c}").alias(c) for c in keep])


def mix(docs: DataFrame, columns: list[str], id_col: str = "doc_id", seed: int = 17, **options) -> DataFrame:
    """The mixture: (shard, position, epoch, *columns), one row for every copy taken, in random order within its shard.

    Two copies with the same position are ordered by id."""
    plan = mix_plan(docs, id_col=id_col, seed=seed, keep=[c for c in columns if c != id_col], **options)
    copies = plan.select(F.explode("copies").alias("copy"), *columns)
    order = F.xxhash64(F.lit(seed), F.col(id_col), F.col("copy.epoch"), F.col("copy.block"))
    return copies.select(F.col("copy.shard").alias("shard"), order.alias("position"), F.col("copy.epoch").alias("epoch"), *columns)
