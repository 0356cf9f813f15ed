"""License scans by diagonal voting.

All rolling 3-word grams of the texts are joined to the places of equal grams in license notices; votes are counted by
diagonal (place in the text minus place in the notice), neighbouring diagonals are merged, which allows for a word put in or
left out, and a merged span stands if its grams cover enough of the notice's words. Short marks of a license are looked
for as exact phrases in the same scan.

Null texts have no words; a text with nothing found has no labels and score 0; equal votes count once; repeated documents
give repeated rows; a very long text is scanned whole; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ticklane.llm.common import NOT_ALNUM, ascii_lower, words
from ticklane.llm.phrases import places

#: Marks that name a license where they stand, and the label of each.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Public license notices, as words, and the label of each.
NOTICES = [
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under the creative commons attribution sharealike license"),
    ("gpl", "this work is licensed under the gnu general public license version"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
GRAM, NEIGHBOUR, MIN_COVERAGE = 3, 2, 0.7
PAYLOAD = "kind string, label string, notice int, at int, size int"


def phrase_table(spark: SparkSession, notices=NOTICES, phrases=PHRASES) -> DataFrame:
    """Phrases and 3-grams of notices, for ``places``; a few hundred rows."""
    rows = [(p.split(), 0, ("phrase", label, -1, 0, len(p.split()))) for p, label in phrases.items()]
    for i, (label, notice) in enumerate(notices):
        w = notice.split()
        rows += [(w[j : j + GRAM], 0, ("gram", label, i, j, len(w))) for j in range(len(w) - GRAM + 1)]
    return spark.createDataFrame(rows, f"words array<string>, offset int, payload struct<{PAYLOAD.replace(' ', ':').replace(',:', ',')}>")


def find_licenses(documents: DataFrame, notices=NOTICES, phrases=PHRASES) -> DataFrame:
    """One row for each document: doc_id, content (hash of its text), n_words, and spans: structs of kind (phrase or
    notice), label, first_word, last_word (first words of the first and last gram; for phrases of each place) and coverage."""
    texts = documents.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("content"), words(ascii_lower(F.col("text")), NOT_ALNUM).alias("w"))
    votes = places(texts, ["doc_id", "content"], phrase_table(documents.sparkSession, notices, phrases))
    keys = ["doc_id", "content"]
    votes = votes.select(*keys, "start", "total", "payload.*").repartition(*keys)  # so that all groups below stay where they are
    # a phrase's place is a diagonal of its own
    votes = votes.withColumn("diagonal", F.col("start") - F.when(F.col("kind") == "gram", F.col("at")).otherwise(0))
    lines = votes.groupBy(*keys, "kind", "label", "notice", "size", "diagonal").agg(
        F.collect_set("at").alias("ats"), F.min("start").alias("first"), F.max("start").alias("last"), F.max("total").alias("total"), F.count("total").alias("copies"))
    order = Window.partitionBy(*keys, "kind", "label", "notice", "size").orderBy("diagonal")
    far = F.col("diagonal") - F.lag("diagonal").over(order) > F.when(F.col("kind") == "gram", NEIGHBOUR).otherwise(0)
    lines = lines.withColumn("far", F.coalesce(far, F.lit(True)).cast("int")).withColumn("span", F.sum("far").over(order))
    spans = lines.groupBy(*keys, "kind", "label", "notice", "size", "span").agg(
        F.flatten(F.collect_list("ats")).alias("ats"), F.min("first").alias("first"), F.max("last").alias("last"), F.max("total").alias("total"), F.sum("copies").alias("copies"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("ats", lambda a: F.sequence(a, a + GRAM - 1))))) / F.col("size")
    spans = spans.withColumn("coverage", F.when(F.col("kind") == "gram", covered).otherwise(1.0))
    span = F.struct(F.when(F.col("kind") == "gram", "notice").otherwise("phrase").alias("kind"), "label", F.col("first").alias("first_word"), F.col("last").alias("last_word"), "coverage")
    per_text = spans.groupBy(*keys).agg(
        F.max("total").alias("n_words"), F.max("copies").alias("copies"),
        F.array_sort(F.collect_list(F.when(F.col("kind").isNotNull() & (F.col("coverage") >= MIN_COVERAGE), span))).alias("spans"))
    return per_text.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*keys, "n_words", "spans")
