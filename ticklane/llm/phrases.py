"""Exact places of word phrases in texts, by one scan with a join on a pair of neighbouring words.

Used with DataFrame operations only: the words of each text are exploded with their places, and a hash of each pair of words
probes the phrases' table. A table whose bytes are within BROADCAST_BYTES is broadcast, and what the probe finds is confirmed
on the words themselves in the same stage; only true places leave it. A larger one is joined by a shuffle on the hash: places
alone travel, and what they find goes back to the texts to be confirmed. Either way texts are exploded once, whatever the
number of phrases.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticklane.llm.common import checkpointed

#: Bytes of phrases, with 64 more for each, up to which they are broadcast.
BROADCAST_BYTES = 48 << 20


def pair_key(first: Column, second: Column) -> Column:
    return F.xxhash64(first, second)


def probes(texts: DataFrame, keys: list[str], single: bool, *columns: str) -> DataFrame:
    """Of each word of texts: pos, word and key, the hash of its pair with the next word; with ``single`` also a row for the word
    alone. The empty word at the end stands for the text itself; no word is empty."""
    rows = texts.select(*keys, "w", F.posexplode(F.concat("w", F.array(F.lit("")))).alias("pos", "word"))
    alone, pair = pair_key(F.col("word"), F.lit(None).cast("string")), pair_key(F.col("word"), F.get("w", F.col("pos") + 1))
    key = F.explode(F.array_distinct(F.array(pair, alone))) if single else pair  # the last word's pair is the word alone
    return rows.select(*keys, *columns, "pos", "word", key.alias("key"))


def places(texts: DataFrame, keys: list[str], phrases: DataFrame, broadcast_bytes: int | None = None) -> DataFrame:
    """All places of phrases, and one row more for each text that tells its number of words.

    texts: ``keys`` and w (array of words); texts with equal keys have equal words. phrases: words (array, not empty), offset (of
    the word whose pair with the next one is looked up; 0 for phrases of one word) and payload, which is small. Rows: ``keys``,
    start and n_words (long; of phrases) and payload, or total (long) alone in each text's own row.
    """
    look = F.get("words", F.col("offset"))
    table = phrases.where(F.size("words") > 0).select(
        F.col("words").alias("p_words"), F.col("offset").cast("int").alias("p_offset"), F.col("payload").alias("p_payload"),
        F.when(F.size("words") > 1, pair_key(look, F.get("words", F.col("offset") + 1))).otherwise(pair_key(look, F.lit(None).cast("string"))).alias("p_key"),
    )
    table = checkpointed(table)
    weight = F.octet_length(F.array_join("p_words", " ")) + F.octet_length(F.to_json(F.struct("p_payload"))) + 64
    size, single = table.agg(F.sum(weight), F.max((F.size("p_words") == 1).cast("int"))).first()
    begin = F.col("pos") - F.col("p_offset")
    same = F.when(begin >= 0, F.slice("w", F.greatest(begin, F.lit(0)) + 1, F.size("p_words")) == F.col("p_words")).otherwise(False)
    own = lambda rows, total: rows.select(*keys, F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("n_words"), F.lit(None).cast(table.schema["p_payload"].dataType).alias("payload"), total.cast("long").alias("total"))
    hit = [*keys, begin.cast("long").alias("start"), F.size("p_words").cast("long").alias("n_words"), F.col("p_payload").alias("payload"), F.lit(None).cast("long").alias("total")]
    if (size or 0) <= (BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes):
        rows = probes(texts, keys, bool(single), "w")
        end = table.sparkSession.range(1).select(F.lit(None).cast("array<string>").alias("p_words"), F.lit(0).alias("p_offset"), F.lit(None).cast(table.schema["p_payload"].dataType).alias("p_payload"), pair_key(F.lit(""), F.lit(None).cast("string")).alias("p_key"))
        found = rows.join(F.broadcast(table.unionByName(end)), (F.col("key") == F.col("p_key")) & F.when(F.col("p_words").isNull(), F.col("word") == "").otherwise(same))
        none = F.col("p_words").isNull()
        return found.select(
            *keys, F.when(~none, begin.cast("long")).alias("start"), F.when(~none, F.size("p_words").cast("long")).alias("n_words"),
            F.col("p_payload").alias("payload"), F.when(none, F.col("pos").cast("long")).alias("total"))
    found = probes(texts, keys, bool(single)).join(table, F.col("key") == F.col("p_key")).drop("word", "key", "p_key")
    back = reduce(lambda a, b: a & b, (found[c].eqNullSafe(texts[c]) for c in keys))
    true = found.join(texts.dropDuplicates(keys), back).where(same).select(*(found[c] for c in keys), *hit[len(keys) :])
    return true.distinct().unionByName(own(texts, F.size("w")))
