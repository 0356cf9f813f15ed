"""Spelling variants: each frequent word's nearest more frequent spelling, without making pairs of words.

Two words are near if one inserted, deleted or replaced code point tells them apart. Words that differ in one place share the
wildcard group (place, what is before it, what is after it); a group keeps its size and its two best words, so a member
knows how many near words it has there and the best one that is not itself. A word with one code point deleted that is a word
itself is near to it, so deletions are joined to the vocabulary. Counts and best words of all places are then added up.

Words are ranked by number, then by code points, in one distributed sort, and rank and 128-bit keys travel in place of words:
a key is a sum of hashes of (place, letter), so that all of a word's keys cost its length, and a word of 100 000 letters gives
100 000 rows of fixed size. Keys of different groups agree with a probability of about 1e-38 for a pair. A group holds at most as many
words as the alphabet has letters (90), since its members differ in one letter: no group grows with the data. Occurrences of
hot words are summed in each task before they are shuffled.

A null text has no words and an empty table gives an empty result. A null id counts as the empty text in the hash of a run.
Repeated rows count each. Ties of number go to the smallest word. Other columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticklane.llm import spans as S
from ticklane.llm.common import ascii_lower, bounded_batches, checkpointed

#: The letters of words, all of which are single bytes in Latin-1.
LETTERS = r"A-Za-zÀ-ÿ"
MIN_LETTERS, MIN_COUNT, MIN_RATIO, DROPPED_OF = 7, 2, 10, 31
KEY = ["key_a", "key_b"]
#: Letters whose keys are made at once; one longer word is handled alone.
PIECE_LETTERS = 200_000
ODD = np.uint64(0x9E3779B97F4A7C15)


def dropped(run: Column, doc_id: Column) -> Column:
    """The run, less one letter for one in DROPPED_OF by the hash of document and run."""
    h = F.crc32(F.encode(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run), "UTF-8"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % DROPPED_OF == 0, F.concat(run.substr(F.lit(1), at), run.substr(at + 2, F.length(run)))).otherwise(run)


def vocabulary(documents: DataFrame, least: int = MIN_LETTERS, often: int = MIN_COUNT) -> DataFrame:
    """word, n and rank (0 upwards with gaps; the most frequent first, ties by code points) of the words of documents (doc_id, text)."""
    # shorter runs make no word, as a run only ever loses a letter
    runs = F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))
    run = documents.select("doc_id", F.explode(runs).alias("run")).select("doc_id", ascii_lower(F.col("run")).alias("run"))
    found = run.select(dropped(F.col("run"), F.col("doc_id")).alias("word")).where(F.length("word") >= least)
    counted = checkpointed(found.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= often))
    return checkpointed(counted.orderBy(F.col("n").desc(), "word").withColumn("rank", F.monotonically_increasing_id()))


def word_keys(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two 64-bit keys, as columns, of each whole word, of each letter's wildcard group and of the word without the letter; and
    whether a letter is the first of equal ones in a row (deleting another of them gives the same word).

    Word i is data[bounds[i]:bounds[i + 1]] in Latin-1."""
    length = np.diff(bounds)
    start, end = np.repeat(bounds[:-1], length), np.repeat(bounds[1:], length)
    at = np.arange(len(data))
    place = (at - start).astype(np.uint64)
    sums = lambda x: np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
    whole, wild, less = [], [], []
    with np.errstate(over="ignore"):
        for seed in (np.uint64(0x51), np.uint64(0xA7)):
            term = lambda place, letter, seed=seed: S.mixed(S.mixed((place * np.uint64(512) + letter) * ODD + seed) ^ (seed * ODD))
            here = term(place, data.astype(np.uint64))
            left = term(place - np.uint64(1), data.astype(np.uint64))  # of a letter that has moved one place to the left
            own, moved = sums(here), sums(left)
            total = own[bounds[1:]] - own[bounds[:-1]]
            whole.append(total)
            wild.append(np.repeat(total, length) - here + term(place, np.uint64(256)))
            less.append(own[at] - own[start] + moved[end] - moved[at + 1])
    new = np.ones(len(data), bool)
    new[1:] = (data[1:] != data[:-1]) | (at[1:] == start[1:])
    return np.stack(whole, 1), np.stack(wild, 1), np.stack(less, 1), new


def keyed(words: DataFrame, kind: str) -> DataFrame:
    """Rows (key_a, key_b, rank) of words (word, rank): one a word (``whole``), one a letter for its wildcard group (``wild``) or
    one for each different word that a deletion leaves (``less``)."""

    bounded_batches(words.sparkSession)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            latin = [w.encode("latin-1") for w in batch.column(0).to_pylist()]
            size, rank = np.array(list(map(len, latin))), batch.column(1).to_numpy()
            piece = np.cumsum(size) // PIECE_LETTERS
            for at in np.split(np.arange(len(latin)), np.flatnonzero(np.diff(piece)) + 1):
                letters, own = np.frombuffer(b"".join(latin[at[0] : at[-1] + 1]), np.uint8), np.repeat(rank[at], size[at])
                whole, wild, less, new = word_keys(letters, np.concatenate([[0], np.cumsum(size[at])]))
                keys, of = {"whole": (whole, rank[at]), "wild": (wild, own), "less": (less[new], own[new])}[kind]
                a, b = np.ascontiguousarray(keys.T).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(of)], [*KEY, "rank"])

    return words.select("word", "rank").mapInArrow(run, "key_a long, key_b long, rank long")


def replacements(words: DataFrame) -> DataFrame:
    """rank, near and best of each word in each wildcard group of several words."""
    group = Window.partitionBy(*KEY).orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    held = keyed(words, "wild").select("rank", F.count("*").over(group).alias("size"), F.first("rank").over(group).alias("top"), F.nth_value("rank", 2).over(group).alias("second"))
    return held.where("size > 1").select("rank", (F.col("size") - 1).alias("near"), F.when(F.col("rank") == F.col("top"), F.col("second")).otherwise(F.col("top")).alias("best"))


def indels(words: DataFrame) -> DataFrame:
    """rank, near and best of each word, and of what a deletion leaves of it, where that is a word: at most a row a letter."""
    shorter = keyed(words, "whole").withColumnRenamed("rank", "shorter")
    met = keyed(words, "less").join(shorter, KEY)
    ends = F.array(F.struct(F.col("rank").alias("of"), F.col("shorter").alias("best")), F.struct(F.col("shorter").alias("of"), F.col("rank").alias("best")))
    return met.select(F.explode(ends).alias("end")).select(F.col("end.of").alias("rank"), F.lit(1).cast("long").alias("near"), "end.best")


def roots(forms: DataFrame) -> DataFrame:
    """rank and root: the last form of each word of forms (rank, up), by doubling. A form is MIN_RATIO times as frequent, so there is
    no circle, and no way is longer than the digits of the largest number: the rounds are few."""
    reached = checkpointed(forms.select("rank", F.col("up").alias("root")))
    while True:
        on = reached.select(F.col("rank").alias("root"), F.col("root").alias("further"))
        now = checkpointed(reached.join(on, "root", "left").select("rank", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        reached = now.drop("moved")
        if now.where("moved").isEmpty():
            return reached


def variants(words: DataFrame, ratio: int = MIN_RATIO) -> DataFrame:
    """word, n, n_near (near words), form (the best near word, if ``ratio`` times as frequent), form_n and root (the form's form, and so
    on) of words (word, n, rank)."""
    near = replacements(words).unionByName(indels(words)).groupBy("rank").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))
    known = lambda rank, **named: words.select(F.col("rank").alias(rank), *(F.col(c).alias(name) for c, name in named.items()))
    found = checkpointed(words.join(near, "rank", "left"))
    forms = found.where("best IS NOT NULL").join(known("best", n="form_n", word="form"), "best").where(F.col("form_n") >= ratio * F.col("n"))
    forms = checkpointed(forms.select("rank", F.col("best").alias("up"), "form", "form_n"))
    root = roots(forms).join(known("root", word="root_word"), "root").select("rank", F.col("root_word").alias("root"))
    whole = found.join(forms.drop("up").join(root, "rank"), "rank", "left")
    return whole.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
