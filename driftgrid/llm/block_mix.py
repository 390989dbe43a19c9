"""Mixing sources to target weights, by blocks of words and pseudorandom index permutations.

The words of each source, in a fixed order of its documents, are packed into blocks of fixed length.
Weights and sizes give each source a target, and the target a number of slots.  A permutation of
all slots deals them to output shards, so that the source counts of a shard are a multinomial draw
under the corpus totals.  Shards take their counts of each source one after the other.  The k-th slot of a source is mapped to a block by a permutation of the
source's block numbers, one per pass over the source, and blocks are joined to slots by their number.  The last
slot of a source takes only the words that are missing to its target.

All steps are DataFrame functions, with no list of slots or documents larger than a chunk.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftgrid.llm.common import WORD, bound, ready
from driftgrid.session import store
from driftgrid.spread import lookup

#: Words per block, slots per output shard.
BLOCK, SHARD = 256, 4096
#: Weights of the sources in order, repeating; passes over a source at most.
WEIGHTS, PASSES = (1, 2, 3), 3
#: Documents per bucket of the running sums, slots per chunk.
BUCKET_ROWS, CHUNK = 4096, 4096
#: Arithmetic of the permutations: a prime below 2^31 and multipliers.
PRIME, A, B, C, ROUNDS = 2147483647, 48271, 69621, 40692, 16


def whole(a: Column, b: Column) -> Column:
    """Integer quotient of numbers that are not negative."""
    return F.call_function("div", a, b)


def mixed(x: Column, seed: Column, r: Column) -> Column:
    """A number below PRIME that looks random."""
    h = F.pmod(F.pmod(x, F.lit(PRIME)) * A + whole(x, F.lit(PRIME)) * C + F.pmod(seed, F.lit(PRIME)) * B + r * 7919 + 1, F.lit(PRIME))
    return bound(h, lambda h: F.pmod(h * h + h * A + r, F.lit(PRIME)))


def permuted(x: Column, n: Column, seed: Column, inverse: bool = False) -> Column:
    """The place of ``x`` under a permutation of 0..n-1 (the swap-or-not shuffle).

    Each round pairs x with key - x modulo n and swaps the two by a coin that depends on the larger one; rounds
    undo themselves, so the inverse takes them backwards.
    """
    order = range(ROUNDS)[::-1] if inverse else range(ROUNDS)

    def step(now: Column, r: Column) -> Column:
        key = F.pmod(mixed(r, seed, F.lit(1).cast("long")) * PRIME + mixed(r, seed, F.lit(2).cast("long")), n)
        coin = lambda x: F.pmod(whole(mixed(x, seed, r), F.lit(8)), F.lit(2)) == 1
        return bound(F.pmod(key - now + n, n), lambda other: F.when(coin(F.greatest(now, other)), other).otherwise(now))

    return F.aggregate(F.array(*(F.lit(r).cast("long") for r in order)), x.cast("long"), step)


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(row, doc_id, source, size), stored.  Size: words of the text, 0 for null."""
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    return store(
        docs.select(
            F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), size.alias("size")
        )
    )


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, block: int = BLOCK) -> DataFrame:
    """One row per source: rank, source_size, weight, target, and how many slots reach the target, stored.

    Sources are ranked by code point, null last.  Shares follow the weights; a source whose share is above
    PASSES times its size stops there, and the rest is shared again.  In order of size per weight
    the sources that stop come first, so running sums find them.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_room = Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    before, after = by_room.rowsBetween(Window.unboundedPreceding, -1), by_room.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    size, exact = F.col("source_size"), "decimal(38,0)"
    whole_weights = F.array(*(F.lit(w).cast("long") for w in weights))
    rows = (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("rank", F.row_number().over(by_name).cast("long"))
        .withColumn("weight", F.get(whole_weights, F.pmod(F.col("rank") - 1, F.lit(len(weights))).cast("int")))
        .withColumn("total", F.sum("source_size").over(every))
        .withColumn("left", F.col("total") - PASSES * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("open", F.sum("weight").over(after))
        .withColumn("stops", F.col("weight").cast("decimal(18,0)") * F.col("left").cast("decimal(20,0)") > PASSES * size.cast("decimal(18,0)") * F.col("open").cast("decimal(19,0)"))
        .withColumn("shared", F.col("total") - F.coalesce(F.sum(F.when(F.col("stops"), PASSES * size)).over(every), F.lit(0)))
        .withColumn("sharing", F.coalesce(F.sum(F.when(~F.col("stops"), F.col("weight"))).over(every), F.lit(1)))
        .withColumn("target", F.when(F.col("stops"), (PASSES * size).cast("double")).otherwise(F.col("weight") * (F.col("shared").cast("double") / F.col("sharing"))))
        .withColumn("blocks", whole(size + block - 1, F.lit(block)))
        .withColumn("short", size - (F.col("blocks") - 1) * block)
        .withColumn("goal", F.least(F.floor(F.col("target") + 0.5), PASSES * size))
        .withColumn("passes", F.when(size > 0, whole(F.col("goal"), size)).otherwise(0).cast("long"))
        .withColumn("part", F.col("goal") - F.col("passes") * size)
    )
    # Where the short last block stands in the unfinished pass decides how many slots that pass needs.
    part, short = F.col("part"), F.col("short")
    at = F.col("at")
    rows = rows.withColumn("at", F.when(size > 0, permuted(F.col("blocks") - 1, F.col("blocks"), pass_seed(F.col("passes")), inverse=True)).otherwise(F.lit(0)))
    beyond = part - at * block - short
    rows = rows.withColumn(
        "some",
        F.when(part <= at * block, whole(part + block - 1, F.lit(block)))
        .when(beyond <= 0, at + 1)
        .otherwise(at + 1 + whole(beyond + block - 1, F.lit(block))),
    )
    some = F.col("some")
    return store(
        rows.withColumn("last", F.when(part <= at * block, part - (some - 1) * block).when(beyond <= 0, part - at * block).otherwise(beyond - (some - at - 2) * block))
        .withColumn("slots", F.col("passes") * F.col("blocks") + some)
        .withColumn("offset", F.sum("slots").over(by_name) - F.col("slots"))
        .withColumn("all_slots", F.sum("slots").over(every))
        .select("source", "rank", "weight", "source_size", "target", "blocks", "short", "passes", "part", "last", "slots", "offset", "all_slots")
    )


def pass_seed(passes: Column) -> Column:
    return F.col("rank") * 1009 + passes


def chunked(rows: DataFrame, slots: str, tasks: int, *keys: str) -> DataFrame:
    """``rows`` with k = 0..slots-1, dealt out in chunks before they become slots: a task gets about two chunks."""
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), whole(F.col(slots) - 1, F.lit(CHUNK))))
    first = F.col("chunk") * CHUNK
    parts = rows.filter(F.col(slots) > 0).withColumn("chunk", chunk).repartition(tasks, *(F.col(k) for k in keys), F.col("chunk"))
    return parts.withColumn("k", F.explode(F.sequence(first, F.least(first + CHUNK, F.col(slots)) - 1))).drop("chunk")


def task_count(sources: DataFrame) -> int:
    return (sources.agg(F.max("all_slots")).first()[0] or 0) // (2 * CHUNK) + 1


def shard_counts(sources: DataFrame, shard: int = SHARD) -> DataFrame:
    """(shard, rank, count, before, left): the slots that each output shard draws of each source, stored.

    A permutation of all slots deals them to shards, so the counts of a shard are a multinomial draw under the
    slots of the sources.  before: slots of the source in earlier shards; left: slots of earlier ranks in the shard.
    """
    each = chunked(sources.select("rank", "slots", "offset", "all_slots"), "slots", task_count(sources), "rank")
    slot = permuted(F.col("offset") + F.col("k"), F.col("all_slots"), F.lit(0).cast("long"))
    counts = each.groupBy(whole(slot, F.lit(shard)).alias("shard"), "rank").agg(F.count("*").alias("count"))
    earlier = Window.partitionBy("rank").orderBy("shard")
    lower = Window.partitionBy("shard").orderBy("rank")
    return store(
        counts.withColumn("before", F.sum("count").over(earlier) - F.col("count")).withColumn("left", F.sum("count").over(lower) - F.col("count"))
    )


def slots(sources: DataFrame, counts: DataFrame, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """(shard, slot, rank, pass, block, words, full): which block fills each slot of the output, and with how many words.

    The counts of a shard say how many blocks it takes of each source, those before it where the source goes on.
    A permutation within the shard mixes its sources.
    """
    names = ["slots", "blocks", "short", "part", "last", "all_slots"]
    rows = lookup(counts, sources.select("rank", *names), "rank")
    each = chunked(rows, "count", task_count(sources), "shard", "rank")
    room_of_shard = F.least(F.lit(shard).cast("long"), F.col("all_slots") - F.col("shard") * shard)
    each = each.withColumn("slot", F.col("shard") * shard + permuted(F.col("left") + F.col("k"), room_of_shard, F.col("shard") + 1))
    each = each.withColumn("k", F.col("before") + F.col("k"))
    each = each.withColumn("pass", whole(F.col("k"), F.col("blocks")))
    each = each.withColumn("block", permuted(F.pmod(F.col("k"), F.col("blocks")), F.col("blocks"), pass_seed(F.col("pass"))))
    room = F.when(F.col("block") == F.col("blocks") - 1, F.col("short")).otherwise(F.lit(block))
    cut = (F.col("k") == F.col("slots") - 1) & (F.col("part") > 0)
    return (
        each.withColumn("words", F.when(cut, F.col("last")).otherwise(room))
        .withColumn("full", F.col("words") == room)
        .select("shard", "slot", "rank", "pass", "block", "words", "full")
    )


def packed(docs: DataFrame, weights: Sequence[int] = WEIGHTS, block: int = BLOCK, shard: int = SHARD, **columns: str) -> DataFrame:
    """(shard, slot, rank, pass, block, words): the blocks of the mix by output shard and slot, one row per slot.

    Sources have their rank as in ``targets``; words counts from the start of the block.  Slots are numbered through all shards.
    """
    ready(docs.sparkSession)
    sources = targets(measured(docs, **columns), weights, block)
    return slots(sources, shard_counts(sources, shard), block, shard).drop("full")


def placed(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """Documents with the range [start, stop) of their words in their source.

    A source may hold a third of all rows, so its running sum is taken in buckets by id, whose number
    follows from the number of rows, and over the bucket totals.
    """
    buckets = sizes.count() // BUCKET_ROWS + 1
    names = sources.select(F.col("source").isNull().alias("_none"), F.coalesce("source", F.lit("")).alias("_name"), "rank", "source_size", "target")
    rows = sizes.select("row", "doc_id", "size", F.col("source").isNull().alias("_none"), F.coalesce("source", F.lit("")).alias("_name"))
    rows = lookup(rows, names, ["_none", "_name"]).drop("_none", "_name")
    rows = rows.withColumn("bucket", F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(buckets)))
    totals = rows.groupBy("rank", "bucket").agg(F.sum("size").alias("words"))
    totals = totals.withColumn("base", F.sum("words").over(Window.partitionBy("rank").orderBy("bucket")) - F.col("words")).drop("words")
    inside = Window.partitionBy("rank", "bucket").orderBy(F.col("doc_id").asc_nulls_last(), "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.withColumn("stop", F.sum("size").over(inside))
        .join(totals, ["rank", "bucket"])
        .withColumn("stop", F.col("stop") + F.col("base"))
        .withColumn("start", F.col("stop") - F.col("size"))
        .drop("base", "bucket")
    )


def pieces(spots: DataFrame, block: int = BLOCK) -> DataFrame:
    """(row, rank, block, start, stop): the parts of documents that lie in each block, as word ranges of the source."""
    first, last = whole(F.col("start"), F.lit(block)), whole(F.col("stop") - 1, F.lit(block))
    return spots.filter("size > 0").select("row", "rank", "start", "stop", F.explode(F.sequence(first, last)).alias("block")).select(
        "row", "rank", "block",
        F.greatest("start", F.col("block") * block).alias("start"),
        F.least("stop", (F.col("block") + 1) * block).alias("stop"),
    )


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, block: int = BLOCK, **columns: str) -> DataFrame:
    """(doc_id, size, source_size, target, taken), one row per input row.

    taken: words of the document in the mix, repeats counted.  A null or empty text has size 0 and is never
    taken, documents without source (null) form the last source, a null id stands last in its source, repeated rows
    are packed one after the other.  An empty table gives an empty result.  Reruns give the same
    rows.  Columns other than the named three are not looked at.
    """
    ready(docs.sparkSession)
    sizes = measured(docs, **columns)
    sources = targets(sizes, weights, block)
    spots = placed(sizes, sources)
    used = slots(sources, shard_counts(sources), block).groupBy("rank", "block").agg(
        F.count_if("full").alias("times"), F.max(F.when(~F.col("full"), F.col("words")).otherwise(0)).alias("head")
    )
    cut = F.least("stop", F.col("block") * block + F.col("head")) - F.col("start")
    taken = pieces(spots, block).join(used, ["rank", "block"]).groupBy("row").agg(
        F.sum((F.col("stop") - F.col("start")) * F.col("times") + F.greatest(cut, F.lit(0))).alias("taken")
    )
    return spots.join(taken, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, weights: Sequence[int] = WEIGHTS, block: int = BLOCK, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix as documents with the columns of ``docs``: one row per document and pass that takes words of it.

    A pass that takes all words keeps the text as it is; the others keep the words taken, with one blank
    between them.  Documents that the mix does not take go.  Nulls, ties and repeats as in ``mix``.
    """
    ready(docs.sparkSession)
    columns, row = docs.columns, "_row"
    while row in columns:
        row += "_"
    kept = store(docs.withColumn(row, F.monotonically_increasing_id()))
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    sizes = store(kept.select(F.col(row).alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), size.alias("size")))
    sources = targets(sizes, weights, block)
    spots = placed(sizes, sources)
    dealt = slots(sources, shard_counts(sources), block).select("rank", "block", "pass", "words")
    heads = F.least("stop", F.col("block") * block + F.col("words"))
    parts = (
        pieces(spots, block).join(dealt, ["rank", "block"]).withColumn("stop", heads).filter("stop > start")
        .groupBy("row", "pass").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("ranges"))
        .join(spots.select("row", "size", F.col("start").alias("base")), "row")
    )
    taken = F.aggregate("ranges", F.lit(0).cast("long"), lambda n, r: n + r["stop"] - r["start"])
    parts = parts.select(F.col("row").alias(row), F.when(taken < F.col("size"), F.transform("ranges", lambda r: F.struct((r["start"] - F.col("base")).cast("int").alias("a"), (r["stop"] - F.col("base")).cast("int").alias("b")))).alias(f"{row}ranges"))
    words = F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))
    some = F.element_at(F.transform(F.array(words), lambda w: F.array_join(F.flatten(F.transform(F.col(f"{row}ranges"), lambda r: F.slice(w, r["a"] + 1, r["b"] - r["a"]))), " ")), 1)
    return kept.join(parts, row).withColumn(text, F.when(F.col(f"{row}ranges").isNull(), F.col(text)).otherwise(some)).select(*columns)
