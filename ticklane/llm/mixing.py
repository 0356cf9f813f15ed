"""Mixing sources to target weights, with DataFrame operations only.

Every row gets a hash-random key; the rows of a source are put in the order of the key by hash ranges, sizes are summed
up to each row (within a range, and over the ranges before it), and each source is cut at exactly its budget: whole
epochs of the source, then the words of one more pass up to the budget.

The key is the md5 of a seed and the id, so that reruns agree and ranges need no sampling. Null texts have size 0 and are
taken 0 times; a null source is a source of its own and comes last; rows with equal ids, texts and sizes share a place in
the order (any of them may be the one that is cut); an empty table gives an empty mix; very long texts are only counted, and cut at the budget; columns named as a result are
replaced by it. Rows without an id count by the
hash of nothing; a copy of a whole row more than a hash range holds stays in one range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticklane.llm.common import SPACE, checkpointed, shuffle_width, words

#: The weights of the sources in the order of their names, repeating.
WEIGHTS = (5, 2, 1)
SHARE_PERCENT, MAX_EPOCHS = 150, 2
ROWS_A_RANGE, RANGES_A_BLOCK, BROADCAST_SOURCES = 2_000, 2_000, 10_000


def sizes(documents: DataFrame) -> DataFrame:
    """doc_id, source and size: the words of the text."""
    return documents.select("doc_id", "source", F.size(words(F.col("text"), SPACE)).cast("long").alias("size"))


def ranked(names: DataFrame, column: str) -> DataFrame:
    """Add rank, from 0, in ascending order, nulls last: a range sort, counts of the ranges, and ranks inside each."""
    cut = names.repartitionByRange(shuffle_width(names.sparkSession), F.asc_nulls_last(column))
    cut = checkpointed(cut.withColumn("part", F.spark_partition_id()))
    parts = cut.groupBy("part").count()  # one row for each partition
    before = parts.alias("a").join(F.broadcast(parts.alias("b")), F.col("b.part") < F.col("a.part"), "left").groupBy("a.part").agg(F.coalesce(F.sum("b.count"), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part").orderBy(F.asc_nulls_last(column))
    return cut.join(F.broadcast(before), "part").withColumn("rank", F.row_number().over(inside) - 1 + F.col("before")).drop("part", "before")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, rank, rows, source_size, target: the share of all words by weight, no source above ``max_epochs`` times its size,
    the excess shared again by weight until none is above."""
    totals = sized.groupBy("source").agg(F.count("*").alias("rows"), F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    table = ranked(totals, "source").select("source", "rank", "rows", "source_size", weight.alias("weight"), (F.col("source_size") * max_epochs).alias("most"))
    table = checkpointed(table.withColumn("full", F.lit(False)))
    asked = (table.agg(F.sum("source_size")).first()[0] or 0) * share_percent / 100
    while True:
        of = lambda value, which: F.coalesce(F.sum(F.when(which, F.col(value))), F.lit(0))
        filled, free, n_full = table.agg(of("most", F.col("full")), of("weight", ~F.col("full")), F.count(F.when(F.col("full"), 1))).first()
        share = F.col("weight") * F.lit(float(asked - filled)) / F.lit(float(free or 1))
        target = F.when(F.col("full"), F.col("most").cast("double")).otherwise(share)
        table = checkpointed(table.withColumn("target", target).withColumn("full", F.col("full") | (target > F.col("most"))))
        if table.where("full").count() == n_full:
            return table.select("source", "rank", "rows", "source_size", "target")


def mix(sized: DataFrame, goals: DataFrame, seed: str = "mix") -> DataFrame:
    """Add source_size, target and taken to rows (doc_id, source, size, ...): the words of each row that the mix takes."""
    keyed = sized.withColumn("key", F.md5(F.encode(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), "UTF-8")))
    few = goals.count() <= BROADCAST_SOURCES
    # else a plain join, whose skewed partitions Spark splits
    keyed = keyed.join(F.broadcast(goals) if few else goals, keyed["source"].eqNullSafe(goals["source"])).drop(goals["source"])
    ranges = F.ceil(F.col("rows") / F.lit(ROWS_A_RANGE))
    place = F.conv(F.substring("key", 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    keyed = keyed.withColumn("range", F.floor(place * ranges).cast("long"))
    inside = Window.partitionBy("rank", "range").orderBy("key", F.asc_nulls_first("doc_id"), "size").rowsBetween(Window.unboundedPreceding, -1)
    # sums of the ranges before, inside blocks of ranges and over the blocks before, so that no window holds all of a source
    sums = keyed.groupBy("rank", "range").agg(F.sum("size").alias("in_range")).withColumn("block", F.floor(F.col("range") / F.lit(RANGES_A_BLOCK)))
    ahead = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    blocks = sums.groupBy("rank", "block").agg(F.sum("in_range").alias("in_block"))
    blocks = blocks.select("rank", "block", F.coalesce(F.sum("in_block").over(ahead("rank", "block")), F.lit(0)).alias("blocks_before"))
    sums = sums.withColumn("ranges_before", F.coalesce(F.sum("in_range").over(ahead("rank", "block", "range")), F.lit(0)))
    offsets = sums.join(blocks, ["rank", "block"]).select("rank", "range", (F.col("blocks_before") + F.col("ranges_before")).alias("offset"))
    placed = keyed.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(offsets, ["rank", "range"], "left")
    before = F.col("offset") + F.col("inside")
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")).cast("long")).otherwise(F.lit(0))
    left = budget - epochs * F.col("source_size")
    taken = epochs * F.col("size") + F.least(F.greatest(left - before, F.lit(0)), F.col("size"))
    return placed.withColumn("taken", taken).drop("key", "rank", "rows", "range", "inside", "offset")


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    pieces = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    return F.array_join(F.slice(pieces, F.lit(1), n.cast("int")), "")


def written(documents: DataFrame) -> DataFrame:
    """Documents with size and taken to the rows of the mix: a copy for each epoch (column epoch), the last one cut."""
    copies = F.when(F.col("taken") > 0, F.sequence(F.lit(1).cast("long"), F.ceil(F.col("taken") / F.col("size"))))
    rows = documents.withColumn("epoch", F.explode(copies))
    part = F.col("taken") - (F.col("epoch") - 1) * F.col("size")
    return rows.withColumn("text", F.when(part < F.col("size"), first_words(F.col("text"), part)).otherwise(F.col("text")))
