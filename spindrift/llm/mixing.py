"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

DataFrame operations only.  Documents are hashed into at most ``BLOCKS`` blocks a source (a hot
source is spread over its blocks, never ordered as a whole).  A source's quota is a number of
block draws: every full pass over the source draws each of its blocks once, and the rest of the
target draws blocks in permuted order up to the one in which the target falls.  That one is cut
into blocks again, drawn in the same way, and only the inner block in which the target falls (a
65,536th part of a large source) is resolved document by document.  A binary tree deals the draws to the output shards: at each node
a uniformly random half of the node's draws goes left, so that the sources' counts on the left
follow the multivariate hypergeometric law and quotas stay exact.  Rows of a shard are ordered
by a hash (the local shuffle).

Edge cases: null text has size 0; a null source is a source of its own, last in the order of the
weights; an empty table gives no rows; rows that repeat each count as a row of their own; other
columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.sources.stage import Stages

WEIGHTS = (5.0, 2.0, 1.0)
#: Blocks of a source, at most, and documents of a block, at least (as a mean).
BLOCKS, BLOCK_DOCS = 256, 64
#: Depth of the splitting tree: 2 ** LEVELS output shards.
LEVELS = 4
#: Most often that a document is taken.
REPEAT = 3
SEED = 20240531


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _hash(*parts) -> Column:
    return F.xxhash64(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(source, n_docs, source_size, target): shares of all words by weight, none above REPEAT times its size.

    The limit is solved in closed form: sources sorted by limit over weight are at their limit up
    to the first one for which the remaining words, shared by the remaining weights, stay below.
    """
    per = sized.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    choice = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("w", choice)
    every = Window.partitionBy(F.lit(0))
    before = Window.partitionBy(F.lit(0)).orderBy(F.col("ratio"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    most = F.col("source_size") * F.lit(float(REPEAT))
    per = (
        per.withColumn("ratio", most / F.col("w"))
        .withColumn("total", F.sum("source_size").over(every).cast("double"))
        .withColumn("weight", F.sum("w").over(every))
        .withColumn("used", F.coalesce(F.sum(most).over(before), F.lit(0.0)))
        .withColumn("used_w", F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("used")) / (F.col("weight") - F.col("used_w")))
        .withColumn("free_level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(every)["level"])
    )
    target = F.least(most, F.coalesce(F.col("free_level") * F.col("w"), most))
    return per.select("source", "n_docs", "source_size", target.alias("target"))


def split_draws(draws: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Deal draws (one row each, with a unique ``key``) to 2 ** levels shards of sizes that differ by 1 at most."""
    out = draws.withColumn("shard", F.lit(0))
    for level in range(levels):
        node = Window.partitionBy("shard")
        place = F.row_number().over(node.orderBy(_hash(F.col("key"), SEED, level), F.col("key")))
        out = out.withColumn("right", (place > F.ceil(F.count("*").over(node) / 2)).cast("int"))
        out = out.withColumn("shard", F.col("shard") * 2 + F.col("right")).drop("right")
    return out


def mix_sources(documents: DataFrame, weights: tuple[float, ...] = WEIGHTS, keep: tuple[str, ...] = (), stages: Stages | None = None) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, copies, taken, shards, then the columns in ``keep``.

    ``shards`` lists the output shard of each of the document's copies.
    """
    spark = documents.sparkSession
    stages = stages or Stages(spark, "mixing")
    sized = documents.select("doc_id", "source", word_count(F.col("text")).alias("size"), _hash(F.col("doc_id"), F.col("text"), SEED).alias("h"), *[F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)])
    sized = stages.save(sized, "sized")

    targets = source_targets(sized.select("source", "size"), weights)
    passes = F.when(F.col("source_size") > 0, F.least(F.lit(REPEAT), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("int")
    targets = (
        targets.withColumn("n_blocks", F.least(F.lit(BLOCKS), F.ceil(F.col("n_docs") / BLOCK_DOCS)).cast("int"))
        .withColumn("passes", passes)
        .withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("passes") * F.col("source_size")))
    )
    targets = stages.save(targets, "targets")

    docs = sized.alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).select(
        "d.*", "t.n_blocks", "t.passes", "t.rest", "t.source_size", "t.target", F.pmod(F.col("d.h"), F.col("t.n_blocks")).cast("int").alias("block")
    )
    blocks = docs.groupBy("source", "block").agg(F.sum("size").alias("block_size"), F.first("passes").alias("passes"), F.first("rest").alias("rest"))
    permuted = Window.partitionBy("source").orderBy(_hash(F.col("source"), F.col("block"), SEED), "block")
    blocks = blocks.withColumn("through", F.sum("block_size").over(permuted.rowsBetween(Window.unboundedPreceding, 0)))
    blocks = blocks.withColumn("whole", F.col("through") <= F.col("rest")).withColumn("need", F.col("rest") - (F.col("through") - F.col("block_size")))
    # The boundary block holds the first block sum beyond the rest of the target.
    blocks = blocks.withColumn("edge", ~F.col("whole") & (F.col("need") > 0))
    copies = F.col("passes") + F.when(F.col("whole") & (F.col("rest") > 0), 1).otherwise(0) + F.when(F.col("edge"), 1).otherwise(0)
    draws = blocks.withColumn("copy", F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies)).otherwise(F.array().cast("array<int>"))))
    draws = draws.withColumn("key", _hash(F.col("source"), F.col("block"), F.col("copy")))
    shards = split_draws(draws.select("source", "block", "copy", "key")).groupBy("source", "block").agg(F.transform(F.sort_array(F.collect_list(F.struct("copy", "shard"))), lambda x: x["shard"]).alias("shards"))
    blocks = blocks.alias("b").join(shards.alias("s"), F.col("b.source").eqNullSafe(F.col("s.source")) & (F.col("b.block") == F.col("s.block")), "left").select("b.source", "b.block", "b.whole", "b.edge", "b.need", "b.rest", "s.shards")
    blocks = stages.save(blocks, "blocks")

    # Boundary blocks are cut and drawn in the same way once more.
    edge = blocks.where("edge").select("source", "block", "need")
    inner = docs.alias("d").join(edge.alias("e"), F.col("d.source").eqNullSafe(F.col("e.source")) & (F.col("d.block") == F.col("e.block"))).select("d.source", "d.block", "d.target", "d.h", "d.size", "e.need")
    # Rows that repeat (same id and text) share one decision.
    inner = inner.groupBy("source", "block", "target", "h", "need").agg(F.sum("size").alias("size"))
    inner = stages.save(inner, "edge")
    cuts = inner.groupBy("source", "block").agg(F.least(F.lit(BLOCKS), F.ceil(F.count("*") / BLOCK_DOCS)).cast("int").alias("cuts"))
    inner = inner.alias("i").join(cuts.alias("c"), F.col("i.source").eqNullSafe(F.col("c.source")) & (F.col("i.block") == F.col("c.block"))).select("i.*", F.pmod(_hash(F.col("i.h"), SEED, "cut"), F.col("c.cuts")).alias("cut"))
    parts = inner.groupBy("source", "block", "cut").agg(F.sum("size").alias("part_size"), F.first("need").alias("need"))
    permuted = Window.partitionBy("source", "block").orderBy(_hash(F.col("source"), F.col("block"), F.col("cut"), SEED), "cut")
    parts = parts.withColumn("through", F.sum("part_size").over(permuted.rowsBetween(Window.unboundedPreceding, 0)))
    parts = parts.select("source", "block", "cut", (F.col("through") <= F.col("need")).alias("all"), (F.col("need") - F.col("through") + F.col("part_size")).alias("left"))
    inner = inner.drop("need").alias("i").join(parts.alias("p"), F.col("i.source").eqNullSafe(F.col("p.source")) & (F.col("i.block") == F.col("p.block")) & (F.col("i.cut") == F.col("p.cut")))
    inner = inner.select("i.source", "i.block", "i.target", "i.h", "i.size", "p.all", F.col("p.left").alias("need"))
    taken = inner.where("all and size > 0").select("source", "block", "h", F.lit(1).alias("extra"))

    # Documents of the inner boundary blocks: fit as many as the rest holds, then smaller ones into what is
    # left; once in permuted order and once from the longest down, for where a long one is in the way.
    inner = inner.where("not all and need > 0").drop("all").withColumn("got", F.lit(False))
    inner = inner.withColumn("way", F.explode(F.array(F.lit(0), F.lit(1))))
    cell = Window.partitionBy("source", "block", "way")
    for turn in range(4):
        fits = ~F.col("got") & (F.col("size") <= F.col("need"))
        first = F.when((F.col("way") == 0) & F.lit(turn == 0), 0).otherwise(-F.col("size"))
        run = F.sum(F.when(fits, F.col("size")).otherwise(0)).over(cell.orderBy(first, _hash(F.col("h"), turn), "h").rowsBetween(Window.unboundedPreceding, 0))
        inner = inner.withColumn("run", run).withColumn("now", fits & (F.col("run") <= F.col("need")))
        inner = inner.withColumn("need", F.col("need") - F.coalesce(F.sum(F.when(F.col("now"), F.col("size"))).over(cell), F.lit(0)))
        inner = inner.withColumn("got", F.col("got") | F.col("now"))
    miss = F.struct(F.floor(F.col("need") / (F.col("target") * 0.005)).alias("miss"), F.col("way"))
    inner = inner.withColumn("best", F.min(miss).over(Window.partitionBy("source", "block")))
    inner = inner.where("way = best.way and got and size > 0").select("source", "block", "h", F.lit(1).alias("extra")).union(taken)

    out = docs.alias("d").join(blocks.alias("b"), F.col("d.source").eqNullSafe(F.col("b.source")) & (F.col("d.block") == F.col("b.block")))
    out = out.select("d.*", "b.whole", F.col("b.rest").alias("rest_b"), "b.shards")
    out = out.alias("d").join(inner.alias("i"), F.col("d.source").eqNullSafe(F.col("i.source")) & (F.col("d.block") == F.col("i.block")) & (F.col("d.h") == F.col("i.h")), "left")
    n = F.col("d.passes") + F.when((F.col("d.whole") & (F.col("d.rest_b") > 0)) | F.col("i.extra").isNotNull(), 1).otherwise(0)
    return out.select(
        "d.doc_id",
        "d.size",
        "d.source_size",
        F.col("d.target").alias("target"),
        n.cast("int").alias("copies"),
        (n * F.col("d.size")).cast("long").alias("taken"),
        F.slice(F.coalesce(F.col("d.shards"), F.array().cast("array<int>")), F.lit(1), n.cast("int")).alias("shards"),
        *[F.col(f"d.keep_{i}").alias(c) for i, c in enumerate(keep)],
    )


def draw_rows(documents: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """The mix itself: each document as often as it is taken, shard by shard, shuffled within a shard."""
    # The row goes along as one column, so no name of its columns can clash.
    packed = documents.select("doc_id", "source", "text", F.struct(*documents.columns).alias("kept_"))
    mixed = mix_sources(packed, weights, keep=("kept_",))
    rows = mixed.where("copies > 0").withColumn("shard_", F.explode("shards"))
    place = _hash(F.col("doc_id"), F.col("shard_"), SEED)
    return rows.repartition("shard_", place).sortWithinPartitions("shard_", place).select("kept_.*")
