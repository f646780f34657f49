"""Mixing sources to target weights, in DataFrame operations only.

Words of each source are packed into blocks of ``block`` words: documents stand one behind the other in an order that a
hash of their ids sets. The mix is a sequence of output shards of ``shard_slots`` slots, and a slot takes one block.

1. Every slot of every source draws its shard: a pseudorandom permutation of all slots (a keyed Feistel network over a
   square, walked along until it is back in range) deals them out. Counted, this gives each shard's number of slots of
   each source: a multinomial draw, given that each source's total is met.
2. A source's slots are numbered through its shards by the running sums of these counts, and each slot's number goes
   through the source's own pseudorandom permutation of block indices, another one for each pass over its blocks.
3. Slots and blocks are joined by that index, and what a document gives is the sum over the slots that hold its words.

Hot sources: offsets of documents come from sums in two levels, over buckets of documents (as many as there are
documents in one, at 1,000,000 and more) and over the buckets of a source; slots are unfolded from chunks and from shards
that are dealt out first. No window or task ever holds
the rows of one source. Only the table of sources (one row each) is ordered as a whole.

Sizes are numbers of ``[^\\x20\\x09-\\x0D]+`` in the text. Null and empty texts have size 0 and are never taken. A null
source is a source of its own, the last in order. Repeated rows are documents of their own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.llm.common import cut, documents

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
BLOCK_WORDS = 1024
SHARD_SLOTS = 4096
CHUNK_SLOTS = 4096
BUCKET_ROWS = 1024
WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    return docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """Each source's share of all words by its weight, at most ``most`` times its size, the excess shared out again.

    Sources in code point order (null last) have the weights in turn. With k = most * size / weight, the shares are
    min(most * size, level * weight): in order of k, the level is the first that the remaining sources can all take.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.select("*", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).alias("nth"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("nth") % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(most))
    per = per.select("*", weight.alias("weight"), cap.alias("cap"))
    every = Window.orderBy(F.col("cap") / F.col("weight"), "nth")
    whole = every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    full = F.sum("source_size").over(whole).cast("double")
    before = F.coalesce(F.sum("cap").over(every.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    ahead = F.sum("weight").over(every.rowsBetween(0, Window.unboundedFollowing))
    per = per.select("*", ((full - before) / ahead).alias("level"))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    per = per.select("*", F.coalesce(F.first(fits, ignorenulls=True).over(whole), F.lit(0.0)).alias("common"))
    return per.select("source", "nth", "source_size", F.least("cap", F.col("common") * F.col("weight")).alias("target"), F.floor("cap").cast("long").alias("most"))


def _hash(*parts) -> Column:
    """60 bits of the MD5 of the parts, comma-joined: a hash that any SQL engine has."""
    return F.conv(F.substring(F.md5(F.concat_ws(",", *[p.cast("string") for p in parts])), 1, 15), 16, 10).cast("long")


def _walk(x: Column, n: Column, *key: Column) -> Column:
    """A pseudorandom permutation of 0 .. n - 1, applied to x."""
    side = F.floor(F.sqrt(n.cast("double"))) + 1

    def once(v: Column) -> Column:
        left, right = F.floor(v / side), v % side
        left = left.cast("long")
        for k in range(4):
            left, right = right, (left + _hash(right, F.lit(k), *key) % side) % side
        return left * side + right

    return F.aggregate(F.sequence(F.lit(1), F.lit(64)), once(x), lambda v, _: F.when(v >= n, once(v)).otherwise(v))


def goals(per_source: DataFrame, block: int, seed: int) -> DataFrame:
    """Each source's blocks, its goal in words, and the slots that takes: passes over all blocks, then part of a pass.

    All slots take whole blocks but those of the short block at the end of a source and the last slot of all. Columns
    ``base`` and ``all``: slots of the sources before this one, and of all.
    """
    n, size, goal = F.col("blocks"), F.col("source_size"), F.col("goal")
    s = per_source.where("source_size > 0").select(
        "nth", "source_size", F.ceil(size / block).cast("long").alias("blocks"), (size % block).alias("tail"),
        F.least(F.round("target").cast("long"), "most").alias("goal"),
    )
    s = s.select("*", F.floor(goal / size).cast("long").alias("passes"), (goal % size).alias("rest"))
    # where in the last pass the short block at the end of the source has its turn
    turn = F.when(F.col("tail") > 0, _hash(F.col("nth"), F.col("passes"), F.lit(seed), F.lit("tail")) % n).otherwise(n)
    s = s.select("*", turn.alias("turn"))
    reach, rest, tail = F.col("turn") * block, F.col("rest"), F.col("tail")
    part = (
        F.when(rest <= reach, F.ceil(rest / block))
        .when(rest <= reach + tail, F.col("turn") + 1)
        .otherwise(F.col("turn") + 1 + F.ceil((rest - reach - tail) / block))
    )
    s = s.select("*", (F.col("passes") * n + part.cast("long")).alias("slots")).where("slots > 0")
    by = Window.orderBy("nth")
    return s.select(
        "*", (F.sum("slots").over(by) - F.col("slots")).alias("base"),
        F.sum("slots").over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("all"),
    )


def shard_counts(goal: DataFrame, seed: int = 0, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """The draw: shard, nth, count (slots of this source in this shard). ``goal`` is the result of :func:`goals`."""
    deals = int(goal.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = goal.select("nth", "slots", "base", "all", F.explode(F.sequence(F.lit(0), F.floor((F.col("slots") - 1) / CHUNK_SLOTS).cast("long"))).alias("chunk"))
    # a number of partitions of its own, or the few small rows would be put together again
    chunks = chunks.repartition(deals, "nth", "chunk")
    first = F.col("chunk") * CHUNK_SLOTS
    each = chunks.select("nth", "base", "all", F.explode(F.sequence(first, F.least(first + CHUNK_SLOTS, F.col("slots")) - 1)).alias("i"))
    place = _walk(F.col("base") + F.col("i"), F.col("all"), F.lit(seed), F.lit("slots"))
    return each.groupBy(F.floor(place / shard_slots).cast("long").alias("shard"), "nth").agg(F.count("*").alias("count"))


def slots(per_source: DataFrame, block: int = BLOCK_WORDS, seed: int = 0, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """The mix: shard, place in it, source number, block index in the source, words taken from the block's start, length.

    ``per_source`` is the result of :func:`targets`. Places of a shard are 0, 1, ... and its sources are interspersed.
    """
    goal = cut(goals(per_source, block, seed))
    counts = cut(shard_counts(goal, seed, shard_slots))
    before = lambda w: F.sum("count").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("count")
    within = Window.partitionBy("shard")
    counts = counts.select(
        "*", before(Window.partitionBy("nth").orderBy("shard")).alias("from"), before(within.orderBy("nth")).alias("ahead"),
        F.sum("count").over(within).alias("filled"),
    )
    deals = int(per_source.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = counts.join(goal, "nth").repartition(deals, "shard", "nth")
    each = counts.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)).alias("k")).withColumn("i", F.col("from") + F.col("k"))
    n, tail = F.col("blocks"), F.col("tail")
    each = each.withColumns({"pass": F.floor(F.col("i") / n).cast("long"), "at": F.col("i") % n})
    # in a whole pass the short block comes last; in the part of a pass, in its turn
    turn = F.when(F.col("pass") < F.col("passes"), F.when(tail > 0, n - 1).otherwise(n)).otherwise(F.col("turn"))
    each = each.withColumn("turn", turn)
    fulls = n - F.when(tail > 0, 1).otherwise(0)
    behind = F.col("at") > F.col("turn")
    index = _walk(F.col("at") - F.when(behind, 1).otherwise(0), F.greatest(fulls, F.lit(1)), F.col("nth"), F.col("pass"), F.lit(seed))
    is_tail = F.col("at") == F.col("turn")
    done = F.col("at") * block - F.when(behind, F.lit(block) - tail).otherwise(0)
    length = F.when(is_tail, tail).otherwise(F.lit(block))
    take = F.when(F.col("pass") < F.col("passes"), length).otherwise(F.least(length, F.col("rest") - done))
    place = _walk(F.col("ahead") + F.col("k"), F.col("filled"), F.col("shard"), F.lit(seed), F.lit("places"))
    return each.select(
        "shard", place.alias("place"), "nth", F.when(is_tail, n - 1).otherwise(index).alias("index"),
        take.cast("long").alias("words"), length.cast("long").alias("length"),
    )


def packed(sizes: DataFrame, per_source: DataFrame, seed: int = 0, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Each document's first word in its source's sequence of words: columns of ``sizes``, nth and first."""
    rows = sizes.count()
    buckets = max(1, -(-rows // max(bucket_rows, math.isqrt(rows))))
    dealt = sizes.join(per_source.select(F.col("source").alias("of"), "nth", "source_size", "target"), F.col("source").eqNullSafe(F.col("of")))
    dealt = dealt.drop("of").withColumn("bucket", _hash(F.col("doc_id"), F.col("size"), F.lit(seed)) % F.lit(buckets))
    inner = Window.partitionBy("nth", "bucket").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    dealt = dealt.withColumn("inside", F.sum("size").over(inner) - F.col("size"))
    sums = dealt.groupBy("nth", "bucket").agg(F.sum("size").alias("words"))
    outer = Window.partitionBy("nth").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.select("nth", "bucket", (F.sum("words").over(outer) - F.col("words")).alias("ahead"))
    return dealt.join(sums.hint("merge"), ["nth", "bucket"]).withColumn("first", F.col("ahead") + F.col("inside")).drop("bucket", "inside", "ahead")


def mix(
    docs: DataFrame, weights=WEIGHTS, block: int = BLOCK_WORDS, seed: int = 0, shard_slots: int = SHARD_SLOTS, most: int = MOST_REPEATS,
    id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """What the mix takes of each row: doc_id, size, source_size, target (its source's), taken, slots, first_shard.

    ``slots`` counts the slots that hold any word of the row's, ``first_shard`` is the first shard with one (null: none).
    """
    sizes = cut(sized(docs, id_col, source_col, text_col))
    per_source = cut(targets(sizes, weights, most))
    placed = packed(sizes, per_source, seed)
    # a block is taken from its start: whole, or in the last slot of its source in part
    drawn = slots(per_source, block, seed, shard_slots).groupBy("nth", "index").agg(
        F.count_if(F.col("words") == F.col("length")).alias("times"), F.min(F.when(F.col("words") == F.col("length"), F.col("shard"))).alias("shard"),
        F.max(F.when(F.col("words") < F.col("length"), F.col("words")).otherwise(0)).alias("part"),
        F.min(F.when(F.col("words") < F.col("length"), F.col("shard"))).alias("part_shard"),
    )
    row = ["nth", "first", "doc_id", "size", "source_size", "target"]
    last = F.greatest(F.col("first"), F.col("first") + F.col("size") - 1)
    pieces = placed.select(*row, F.explode(F.sequence(F.floor(F.col("first") / block), F.floor(last / block))).alias("index"))
    start = F.greatest(F.col("first") - F.col("index") * block, F.lit(0))
    end = F.least(F.col("first") + F.col("size") - F.col("index") * block, F.lit(block))
    joined = pieces.withColumns({"start": start, "end": end}).join(drawn.hint("merge"), ["nth", "index"], "left")
    partly = F.greatest(F.least("end", "part") - F.col("start"), F.lit(0))
    some = joined.where("size > 0").groupBy(*row).agg(
        F.sum(F.coalesce(F.col("times") * (F.col("end") - F.col("start")) + partly, F.lit(0))).alias("taken"),
        F.sum(F.coalesce(F.col("times") + F.when(partly > 0, 1).otherwise(0), F.lit(0))).alias("slots"),
        F.min(F.least("shard", F.when(partly > 0, F.col("part_shard")))).alias("first_shard"),
    )
    zero = F.lit(0).cast("long")
    none = placed.where("size = 0").select("doc_id", "size", "source_size", "target", zero.alias("taken"), zero.alias("slots"), F.lit(None).cast("long").alias("first_shard"))
    return some.select("doc_id", "size", "source_size", "target", "taken", "slots", "first_shard").union(none)


def op4_source_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))
