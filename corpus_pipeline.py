"""A corpus pipeline over documents: language ID, quality rules, near-dedup, benchmark decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with the columns of its input whatever their
names; the last one returns the rows of the mix: a row for each epoch of a document (column epoch, from 1), the last one cut
at the source's exact budget, with the document's size and taken words. Columns of documents with these names go.
Near-dedup decides by id and text, all other stages by row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticklane.llm import decontam, langid, mixing, neardup, quality
from ticklane.llm.common import checkpointed, table

#: SQL has no Viterbi decoding and no learned weights, so there is no SQL; tests hold near-dedup and decontamination against brute force, not run() or the mix.
ORACLE_SQL = None
#: A text goes if no language has this share of its letters.
MIN_LANGUAGE_SHARE = 0.5
#: Ids of rejected documents that are broadcast at most; more of them are joined by a shuffle.
BROADCAST_ROWS = 500_000


def _packed(docs: DataFrame) -> DataFrame:
    """The row as one column, beside what the operators read, so that no column's name can clash."""
    return docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), "doc_id", "text")


def _small(rows: DataFrame) -> DataFrame:
    rows = checkpointed(rows)
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fit(docs.select("doc_id", "text", "lang"))
    labelled = langid.label_languages(_packed(docs), model, keep=["row"], with_spans=False)
    return labelled.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SHARE)).select("row.*")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    field = quality.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return quality.apply_rules(_packed(docs), field, keep=["row"], with_lines=False).where("kept").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    content = F.xxhash64(F.coalesce("text", F.lit("")))
    found = neardup.near_duplicates(docs.select("doc_id", "text"), k=5, percent=80, by_id=False)
    gone = _small(found.where("not kept").select(F.col("doc_id").alias("gone_id"), "content").distinct())
    packed = _packed(docs).withColumn("hash", content)
    return packed.join(gone, (F.col("hash") == F.col("content")) & (F.col("doc_id") == F.col("gone_id")), "left_anti").select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontam.find_contamination(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    gone = _small(found.where("n_hit > 0").select(F.col("doc_id").alias("gone_id"), "content").distinct())
    packed = _packed(docs).withColumn("hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    return packed.join(gone, (F.col("hash") == F.col("content")) & F.col("doc_id").eqNullSafe(F.col("gone_id")), "left_anti").select("row.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    sized = mixing.sizes(docs)
    goals = mixing.targets(sized)
    wide = docs.select("doc_id", "source", F.size(mixing.words(F.col("text"), mixing.SPACE)).cast("long").alias("size"), "text", F.struct(*(docs[f"`{c}`"] for c in docs.columns if c.lower() not in ("text", "size", "taken", "epoch"))).alias("row"))
    return mixing.written(mixing.mix(wide, goals)).select("row.*", "text", "size", "taken", "epoch")


STAGES = [("language ID", language_id), ("quality rules", quality_rules), ("MinHash near-dedup", near_dedup), ("benchmark decontamination", decontamination), ("mixing", mixed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
