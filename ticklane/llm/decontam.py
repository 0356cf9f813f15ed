"""Benchmark decontamination by a prefix-filtered set join, with DataFrame operations only.

A window is 10 consecutive words of an item, or a shorter item as a whole. Its shingles (pairs of neighbouring words) are
ordered by rarity among the items; a text that contains the window must contain the first of them, so that one shingle,
the necessary prefix for exact containment, is what texts are joined on. The window's length and the shingle's place in
it bound where it can stand, and the words there confirm it. The rarest shingles meet few other words, so little more than
true places ever leaves the scan. A window travels as its number; the ids of its items are joined to what is found.

Null texts have no words; null item ids count as the empty id; items without words have no window; equal items each count;
repeated documents give repeated rows; a very long text is scanned whole; empty tables give empty results or no hits; other
columns are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticklane.llm.common import NOT_ALNUM, ascii_lower, checkpointed, salted_lookup, words
from ticklane.llm.phrases import places

WINDOW = 10


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """Distinct windows as phrases: words, offset of the rarest pair, payload (the window's number) and item_ids (strings)."""
    listed = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words(ascii_lower(F.col("text")), NOT_ALNUM).alias("w")).where(F.size("w") > 0)
    pairs = listed.select("item_id", "w", F.posexplode("w").alias("pos", "a")).withColumn("b", F.get("w", F.col("pos") + 1)).where(F.col("b").isNotNull() | (F.size("w") == 1))
    rarity = pairs.groupBy("a", "b").agg(F.count("*").alias("n"))
    # every window's own pairs, the rarest first
    cut = listed.select("item_id", F.explode(F.when(F.size("w") <= size, F.array("w")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1))), lambda i: F.slice("w", i, size)))).alias("words"))
    cut = checkpointed(cut.groupBy("words").agg(F.collect_set("item_id").alias("item_ids")).withColumn("payload", F.monotonically_increasing_id()))
    spread = cut.select("words", "payload", F.posexplode("words").alias("offset", "a")).withColumn("b", F.get("words", F.col("offset") + 1)).where(F.col("b").isNotNull() | (F.size("words") == 1))
    spread = spread.join(rarity, spread["a"].eqNullSafe(rarity["a"]) & spread["b"].eqNullSafe(rarity["b"])).select("payload", "offset", "n")
    rarest = spread.groupBy("payload").agg(F.min_by("offset", F.struct("n", "offset")).alias("offset"))
    return checkpointed(cut.join(rarest, "payload").select("words", "offset", "payload", "item_ids"))


def find_contamination(documents: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """One row for each document: doc_id, content (hash of its text), n_words, hit_spans (merged, first word and length),
    n_hit and items (sorted ids of the items with occurring windows)."""
    texts = documents.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("content"), words(ascii_lower(F.col("text")), NOT_ALNUM).alias("w"))
    known = windows(items, size)
    found = places(texts, ["doc_id", "content"], known.drop("item_ids"))
    by_text = found.groupBy("doc_id", "content").agg(
        F.max("total").alias("n_words"), F.count("total").alias("copies"),
        F.array_sort(F.collect_set(F.when(F.col("start").isNotNull(), F.struct("start", "n_words")))).alias("hits"),
        F.collect_set("payload").alias("windows"),
    )
    by_text = checkpointed(by_text)
    hit = by_text.where(F.size("windows") > 0).select("doc_id", "content", F.explode("windows").alias("payload"))
    # a window in very many texts is dealt over several tasks
    named = salted_lookup(hit, "payload", F.struct("doc_id", "content"), known.select("payload", "item_ids"))
    named = named.groupBy("doc_id", "content").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("items"))
    named = named.select(F.col("doc_id").alias("named_id"), F.col("content").alias("named_content"), "items")
    by_text = by_text.join(named, F.col("doc_id").eqNullSafe(F.col("named_id")) & (F.col("content") == F.col("named_content")), "left")
    by_text = by_text.withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    none = F.array().cast("array<struct<first:bigint,last:bigint>>")

    def merged(acc, hit):
        begin, end = hit["start"], hit["start"] + hit["n_words"]
        touches = (F.size(acc) > 0) & (F.coalesce(F.element_at(acc, -1)["last"], F.lit(-1)) >= begin)
        grown = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.element_at(acc, -1)["first"].alias("first"), F.greatest(F.element_at(acc, -1)["last"], end).alias("last"))))
        return F.when(touches, grown).otherwise(F.concat(acc, F.array(F.struct(begin.alias("first"), end.alias("last")))))

    spans = F.when(F.size("hits") > 0, F.aggregate("hits", none, merged)).otherwise(none)
    by_text = by_text.withColumn("hit_spans", spans)
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda acc, s: acc + s["last"] - s["first"])
    return by_text.withColumn("n_hit", n_hit).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("doc_id", "content", "n_words", "hit_spans", "n_hit", "items")
