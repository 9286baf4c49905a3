"""Mixing sources to target weights. DataFrame and SQL functions only.

Each source is dealt into blocks of documents by a hash. Its target gives whole passes over its blocks and a rest; the rest
takes blocks in permuted order and cuts the last of them between two documents. Then a splitting tree shares the drawn
blocks among the output shards: each node draws its left half's block counts from a multivariate hypergeometric
distribution, so that each shard gets its exact quota of blocks and on average the mix of the whole. A source's permuted
blocks are dealt to the shards by these counts, disjoint, and each shard is shuffled by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.llm._common import n_words, small, stored, table

WEIGHTS = (5, 2, 1)
#: No source is taken more often than this.
MOST = 3
SHARDS = 64
#: Words in a block; larger where there would be more than MAX_BLOCKS of them, so that the tables of blocks stay small.
BLOCK_WORDS, MAX_BLOCKS = 65_536, 1_000_000
#: Columns of the mix.
OWN = ("size", "source_size", "target", "taken", "draws")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """source, source_size and target of each row of sizes (source, source_size).

    The weights repeat over the sources by code point, null last; they share the sum of all sizes. A target stops at
    `most` times its source's size and the excess is shared again by weight until none is above. That is one water
    level: sorted by cap to weight, the first sources stop at their caps and the rest get the level times their weight.
    There is one row for each source, so that windows over all rows are small.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    by_cap = W.orderBy("ratio", F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1))
    ranked = ranked.withColumn("cap", F.col("source_size") * float(most)).withColumn("ratio", F.col("cap") / F.col("weight"))
    everything = W.partitionBy()
    ranked = ranked.withColumn("total", F.sum("source_size").over(everything).cast("double"))
    before = by_cap.rowsBetween(W.unboundedPreceding, -1)
    rest = by_cap.rowsBetween(W.currentRow, W.unboundedFollowing)
    ranked = ranked.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    ranked = ranked.withColumn("water", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "source", "level"))).over(everything)["level"])
    target = F.when(F.col("water").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("water") * F.col("weight")))
    return ranked.select("source", "source_size", target.alias("target"))


def shard_quotas(blocks: DataFrame, shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """shard, source_no, quota from blocks (source_no, n): the splitting tree, one level after the other, without a
    shuffle. A node holds the counts of its blocks by source; half of its shards get half of its blocks. Each block of a
    source goes left with the chance of a draw without replacement, so that the left count is hypergeometric given the
    sources before it."""
    node = blocks.agg(F.array_sort(F.collect_list(F.struct(F.col("source_no").cast("int").alias("s"), F.col("n").cast("long").alias("n")))).alias("parts"))
    node = node.select(F.lit(0).alias("lo"), F.lit(shards).alias("hi"), "parts")
    level = 0
    while 1 << level < shards:
        # left slots: the node's blocks by its share of shards
        draw = f"""aggregate(parts,
            named_struct('out', cast(array() AS array<struct<s:int,l:bigint,r:bigint>>), 'slots', cast(floor(total * div(hi - lo, 2) / greatest(hi - lo, 1)) AS bigint), 'left', total),
            (a, p) -> element_at(transform(array(aggregate(
                CASE WHEN p.n > 0 THEN sequence(1L, p.n) ELSE cast(array() AS array<bigint>) END,
                named_struct('got', 0L, 'left', a.left),
                (b, i) -> named_struct('got', b.got + CASE WHEN (xxhash64({seed}, {level}, lo, p.s, i) & 9007199254740991) / 9007199254740992D * b.left < a.slots - b.got THEN 1L ELSE 0L END, 'left', b.left - 1L))),
                b -> named_struct('out', concat(a.out, array(named_struct('s', p.s, 'l', b.got, 'r', p.n - b.got))), 'slots', a.slots - b.got, 'left', b.left)), 1),
            a -> a.out)""".replace("div(hi - lo, 2)", "((hi - lo) div 2)")
        node = node.withColumn("total", F.expr("aggregate(parts, 0L, (x, p) -> x + p.n)"))
        node = node.withColumn("split", F.expr(draw)).select("lo", "hi", "split", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
        node = node.where("side = 1 OR hi - lo > 1")
        node = node.select(
            F.expr("CASE WHEN side = 0 THEN lo ELSE lo + ((hi - lo) div 2) END").alias("lo"),
            F.expr("CASE WHEN side = 0 THEN lo + ((hi - lo) div 2) ELSE hi END").alias("hi"),
            F.expr("transform(split, p -> named_struct('s', p.s, 'n', CASE WHEN side = 0 THEN p.l ELSE p.r END))").alias("parts"),
        )
        level += 1
    return node.select(F.col("lo").alias("shard"), F.explode("parts").alias("p")).select("shard", F.col("p.s").alias("source_no"), F.col("p.n").alias("quota"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, shards: int = SHARDS, seed: int = 0, columns: tuple[str, ...] = ("doc_id",), block_words: int = BLOCK_WORDS) -> DataFrame:
    """`columns` of each row of docs (doc_id, source, text) with size, source_size, target, taken and draws, an array with
    the (shard, place) of each time that the mix takes the row; `place` orders a shard.

    Null texts and ids are as good as any: a null text has size 0, a null source is a source of its own and comes last.
    Repeated rows are rows of their own. All-empty sources have target 0 and are taken in no pass. An empty table gives an
    empty table. Columns that are not asked for are not read; of those asked for, size, source_size, target, taken and draws
    are the mix's own, all others may have any name. Rows are dealt by source and block, so that a source with a third of all
    rows is spread like any other, and so are null ids, equal ids and equal rows. Reruns agree, whatever the partitions:
    everything random is a hash. Only equal rows that fill a block alone are told apart by their place in the table.
    """
    keep = [c for c in columns if c.lower() not in OWN]
    held = F.struct(*([F.col(f"`{c}`") for c in keep] or [F.lit(0).alias("none")])).alias("_keep")
    rows = docs.select(held, F.col("source").alias("_source"), n_words().alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("_at"), F.xxhash64("text").alias("_text_hash"))
    rows = stored(rows, "sizes")
    many = rows.groupBy("_at", "_text_hash").agg(F.sum("size").alias("_n"), F.count("*").alias("_m")).where(f"_n > {block_words} AND _m > 1")
    many = stored(many.select("_at", "_text_hash", F.lit(True).alias("_many")), "equal-rows")
    if not many.isEmpty():
        own = F.when(F.col("_many"), F.xxhash64("_at", F.monotonically_increasing_id())).otherwise(F.col("_at"))
        rows = stored(rows.join(small(many), ["_at", "_text_hash"], "left").withColumn("_at", own).drop("_many"), "sizes")
    sizes = rows.groupBy(F.col("_source").alias("source")).agg(F.sum("size").alias("source_size"))
    plan = targets(sizes, weights, most)
    total = F.sum("source_size").over(W.partitionBy())
    plan = plan.withColumn("source_no", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    plan = plan.withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.greatest(F.lit(float(block_words)), total / MAX_BLOCKS)))).withColumn("n_blocks", F.col("n_blocks").cast("int"))
    plan = plan.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    plan = plan.withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    plan = stored(plan.withColumnRenamed("source", "_name"), "plan")
    rows = rows.join(small(plan), F.col("_source").eqNullSafe(F.col("_name"))).drop("_name")
    rows = rows.withColumn("block", F.pmod("_at", F.col("n_blocks").cast("long")))

    # blocks in permuted order, with the words before each
    block = rows.groupBy("source_no", "block").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first("passes").alias("passes"))
    order = W.partitionBy("source_no").orderBy(F.xxhash64(F.lit(seed + 1), "source_no", "block"), "block")
    block = block.withColumn("before", F.sum("words").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("words"))
    block = block.withColumn("drawn", F.col("passes") + F.when(F.col("before") < F.col("rest"), 1).otherwise(0))
    block = stored(block, "blocks")

    # each drawn block's rank within its source, pass by pass, and the shards' ranges of ranks
    drawn = block.where("drawn > 0").select("source_no", "block", F.explode(F.sequence(F.lit(1), "drawn")).alias("pass"))
    rank = F.row_number().over(W.partitionBy("source_no").orderBy("pass", F.xxhash64(F.lit(seed + 2), "source_no", "block", "pass"), "block")).cast("long")
    drawn = drawn.withColumn("rank", rank)
    quota = shard_quotas(block.groupBy("source_no").agg(F.sum("drawn").alias("n")), shards, seed)
    upto = F.sum("quota").over(W.partitionBy("source_no").orderBy("shard").rowsBetween(W.unboundedPreceding, 0))
    quota = quota.withColumn("upto", upto).where("quota > 0")
    ranks = quota.select("source_no", "shard", F.explode(F.sequence(F.col("upto") - F.col("quota") + 1, F.col("upto"))).alias("rank"))
    dealt = drawn.join(ranks, ["source_no", "rank"]).groupBy("source_no", "block").agg(F.array_sort(F.collect_list(F.struct("pass", "shard"))).alias("shards"))
    block = stored(block.select("source_no", "block", "before").join(dealt, ["source_no", "block"], "left"), "dealt")

    # within a block, a document of the rest is taken if its middle lies within it
    inside = W.partitionBy("source_no", "block").orderBy(F.xxhash64(F.lit(seed + 3), "_at", "_text_hash"), "_at", "_text_hash", "size").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_upto", F.sum("size").over(inside))
    rows = rows.join(small(block), ["source_no", "block"])
    times = F.col("passes") + F.when(F.col("before") + F.col("_upto") - F.col("size") / 2.0 <= F.col("rest"), 1).otherwise(0)
    times = F.when(F.col("target") > 0, times).otherwise(0)
    times = F.least(times, F.coalesce(F.size("shards"), F.lit(0)), F.lit(most))
    draws = F.expr("transform(slice(shards, 1, _times), x -> named_struct('shard', x.shard, 'place', xxhash64(_at, _text_hash, x.pass)))")
    rows = rows.withColumn("_times", times).withColumn("draws", F.when(F.col("_times") > 0, draws))
    return rows.select(*[F.col(f"_keep.`{c}`").alias(c) for c in keep], "size", "source_size", "target", (F.col("_times") * F.col("size")).cast("long").alias("taken"), "draws")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its source's target and the words that the mix takes of it. Null texts have size 0; null and
    repeated ids are rows like any other."""
    out = mixed(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", F.array_join(F.transform("draws", lambda x: x["shard"]), ",").alias("shards"))
