"""Filter interaction audit: what each filter of a set removes, in every order they could be applied.

A filter that comes next after an already-applied subset is an edge of the lattice of subsets: n * 2^(n-1) edges for n
filters, 80 for five. A row counts in every edge: it is still there if it passes the subset, and removed there if it also
fails the filter. Rows of a part with the same failures and marks count alike, so they are counted once by failure pattern
(at most 2^n for each part and mark, by Spark's partial aggregation, however many rows a part holds), and each pattern then
goes into its edges. An order of the filters is a path through the lattice, so its steps are edges joined by (subset, next
filter), and the total over all orders weighs each edge by the orders that pass it. No order is ever walked over the rows.

A null text is the empty text, which fails a filter for length and equals other empty texts. A null part is the empty
string. A row without an id equals no smaller id and makes no other row a repeat; it has no labels. Rows of one id and
text don't repeat each other. Labels of one id given twice hold if one of them does. An empty table has no parts and gives
no rows. Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ticklane.llm.common import SPACE, checkpointed, salted_lookup, words

#: The filters of the audit, one letter each.
FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITAL_PERCENT = 200, 50, 2


def lattice(n: int) -> list[tuple[int, int]]:
    """The edges: (bits of the filters applied, bit of the next one)."""
    return [(applied, 1 << f) for f in range(n) for applied in range(1 << n) if not applied >> f & 1]


def orders(spark: SparkSession, filters: str) -> DataFrame:
    """filter_order, step (from 1), applied and next of each step of each permutation: n! * n rows."""
    rows = []
    for order in permutations(range(len(filters))):
        name, applied = "".join(filters[f] for f in order), 0
        for step, f in enumerate(order, 1):
            rows.append((name, step, applied, 1 << f))
            applied |= 1 << f
    return spark.createDataFrame(rows, "filter_order string, step int, applied int, next int")


def failures(tests: list[Column]) -> Column:
    """Bit i is set where test i holds; an unknown one is not set."""
    return sum((F.when(F.coalesce(t, F.lit(False)), F.lit(1 << i)).otherwise(F.lit(0)) for i, t in enumerate(tests)), F.lit(0))


def lattice_edges(rows: DataFrame, filters: str, marks: list[str]) -> DataFrame:
    """Rows (part, fails, and a boolean column for each mark) counted in each edge of their part: part, applied, next, kept,
    removed, redundant (fails the next filter, removed before), unique_fails (fails it alone), <mark>_lost (removed here) and
    shapley (removed by the filter, summed over all orders)."""
    n = len(filters)
    counted = rows.groupBy("part", "fails", *marks).agg(F.count("*").alias("n"))
    edges = F.array(*(F.struct(F.lit(a).alias("applied"), F.lit(b).alias("next")) for a, b in lattice(n)))
    met = counted.repartition("part").withColumn("edge", F.explode(edges)).select("part", "fails", "n", *marks, "edge.*")
    there, fails = F.col("fails").bitwiseAND(F.col("applied")) == 0, F.col("fails").bitwiseAND(F.col("next")) != 0
    total = lambda which: F.sum(F.when(which, F.col("n")).otherwise(F.lit(0)))
    summed = met.groupBy("part", "applied", "next").agg(
        total(there & ~fails).alias("kept"), total(there & fails).alias("removed"), total(~there & fails).alias("redundant"),
        total(F.col("fails") == F.col("next")).alias("unique_fails"), *(total(there & fails & F.col(m)).alias(f"{m}_lost") for m in marks),
    )
    before = F.bit_count("applied")
    passing = F.element_at(F.array(*(F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n))), (before + 1).cast("int"))
    return summed.withColumn("shapley", F.sum(F.col("removed") * passing).over(Window.partitionBy("part", "next")))


def audit(rows: DataFrame, filters: str, marks: list[str]) -> DataFrame:
    """part, filter_order and step of every order of the filters, with the counts of the edge it passes; zeros included."""
    edges = lattice_edges(rows, filters, marks)
    paths = F.broadcast(orders(rows.sparkSession, filters))  # n! * n rows, whatever the data
    return edges.join(paths, ["applied", "next"]).drop("applied", "next")


def document_failures(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """part (the source), fails (bits of FILTERS), good and toxic of each document (doc_id, text, source); labels (doc_id, quality,
    toxic).

    Texts are read once and travel as a SHA-256 digest. The rows of one text or id are dealt over several tasks."""
    cut = documents.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    cut = cut.withColumn("words", words(F.col("text"), SPACE))
    n_words, capitals = F.size("words"), F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    own = [
        n_words < MIN_WORDS, 100 * F.size(F.array_distinct("words")) < MIN_DISTINCT_PERCENT * n_words,
        F.lit(100).cast("long") * capitals > F.lit(MAX_CAPITAL_PERCENT).cast("long") * F.length("text"), F.col("text").rlike("[#$%&*|]"),
    ]
    digest = F.unhex(F.sha2(F.encode("text", "UTF-8"), 256))
    read = checkpointed(cut.select("doc_id", "part", failures(own).alias("fails"), digest.alias("digest"), F.monotonically_increasing_id().alias("row")))
    firsts = read.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
    known = salted_lookup(read, "digest", F.col("row"), firsts, "left")
    repeat = F.when(F.col("doc_id") > F.col("first"), F.lit(1 << len(own))).otherwise(F.lit(0))
    marked = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = salted_lookup(known.withColumn("fails", F.col("fails") + repeat), "doc_id", F.col("row"), marked, "left")
    return rows.select("part", "fails", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
