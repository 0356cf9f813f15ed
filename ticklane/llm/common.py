"""Table access, shared-folder checkpoints and the word rules that several operators use."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The two word patterns of the contracts, as Java/RE2 character classes of what is *not* in a word.
SPACE = r"[\x20\x09-\x0D]+"
NOT_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Tasks over which the rows of one key are dealt.
SALTS = 16
#: Bytes of sampling rates by label that are broadcast at most; more of them meet the rows by a shuffle.
BROADCAST_RATES = 8 << 20
BATCH_SETTING, ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, through Spark's reader only, so that any file system it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage in the folder that ``spark.checkpoint.dir`` names. Where none is set, a local session (tests) takes a
    temporary one, and a cluster raises, since its executors share no folder of the driver's."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoints-"))
    return df.checkpoint(eager=True)


def salted_lookup(rows: DataFrame, key: str, spread: Column, looked: DataFrame, how: str = "inner") -> DataFrame:
    """Rows joined to ``looked`` (one row for each key), with each key's rows dealt over SALTS tasks by the hash of ``spread``,
    so that a key may hold any share of the rows. A looked-up row is repeated for the parts that its key's rows have."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    near = salted.select(key, "salt").distinct().join(looked, key)
    return salted.join(near, [key, "salt"], how).drop("salt")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column, separators: str) -> Column:
    """Array of the maximal runs without ``separators``; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separators), "")


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; the folds of the contracts. A null id counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % modulus


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's limit on the bytes of an Arrow batch to ARROW_BYTES, where it is above.

    A task holds a batch in the JVM, outside its heap, and again in its Python worker, in parts more than once, so Spark's
    64 MB would be several times that for each core. A longer text is a batch of its own."""
    number, unit = re.fullmatch(r"(-?\d+)\s*([a-z]*)", spark.conf.get(BATCH_SETTING).strip().lower()).groups()
    size = int(number) << {"k": 10, "m": 20, "g": 30, "t": 40}.get(unit[:1], 0)
    if not 0 < size <= ARROW_BYTES:
        spark.conf.set(BATCH_SETTING, str(ARROW_BYTES))


def map_texts(df: DataFrame, text: str, keep: list[str], fields: str, start) -> DataFrame:
    """Add columns made from a text column, batch by batch, in Arrow.

    ``start()`` runs once in each task and returns a function from the Arrow column of texts to a dict of Arrow arrays
    named as in ``fields`` (DDL). Columns of ``keep`` pass through; one with the name of a result is replaced by it.
    """
    import pyarrow as pa
    from pyspark.sql import types as T

    made = T.StructType.fromDDL(fields)
    taken = {f.name.lower() for f in made}
    kept = [c for c in dict.fromkeys(keep) if c.lower() not in taken]
    source = df.select(*[df[f"`{c}`"].alias(f"k{i}") for i, c in enumerate(kept)], df[f"`{text}`"].cast("string").alias("t"))
    out = T.StructType([*(T.StructField(c, df.schema[c].dataType, True) for c in kept), *made])
    n, names = len(kept), [f.name for f in out]
    bounded_batches(df.sparkSession)

    def run(batches):
        work = start()
        for batch in batches:
            if batch.num_rows:
                got = work(batch.column(n))
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], *(got[name] for name in names[n:])], names)
        del work
        pa.default_memory_pool().release_unused()  # workers live on, and the next stage's share the executor with the JVM

    return source.mapInArrow(run, out)


def fitting_sample(rows: DataFrame, label: str, per_label: int, last: Column | None = None) -> DataFrame:
    """A bounded sample of rows for fitting: about ``per_label`` of each label, chosen by a hash of doc_id, the same ones in
    each run. Rows without an id or a label are left out, and rows for which
    ``last`` holds make up only for what a label's other rows lack. Rows don't move where the rates are few."""
    last = F.lit(False) if last is None else last
    usable = rows.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).withColumn("last", last)
    counts = usable.groupBy(label, "last").count().groupBy(label).agg(F.sum("count").alias("all"), F.coalesce(F.sum(F.when(~F.col("last"), F.col("count"))), F.lit(0)).alias("others"))
    lacking = F.greatest(F.lit(0.0), F.lit(float(per_label)) - F.col("others"))
    rates = counts.select(
        label, F.try_divide(F.lit(float(per_label)), F.col("others")).alias("rate"), F.try_divide(lacking, F.col("all") - F.col("others")).alias("last_rate"))
    rates = checkpointed(rates)  # a row a label
    labels, size = rates.agg(F.count("*"), F.sum(F.octet_length(F.col(label).cast("string")))).first()
    few = labels * 64 + (size or 0) <= BROADCAST_RATES
    joined = usable.join(F.broadcast(rates), label) if few else salted_lookup(usable, label, F.col("doc_id"), rates)
    rated = joined.withColumn("rate", F.when(F.col("last"), F.col("last_rate")).otherwise(F.col("rate")))
    spread = F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    return rated.where(spread < F.col("rate")).drop("rate", "last_rate", "last")


def fitting_texts(documents: DataFrame, picked: DataFrame, label: str, per_class: int, max_chars: int) -> DataFrame:
    """Different texts (doc_id, text) of the picked ids with their label, at most ``2 * per_class`` labelled 0 and as many others.

    One text of each id comes first, then the rest, both in the order of a hash, so that copies or other texts of one id
    and rows of one class take no place from the others."""
    short = documents.select("doc_id", "text").where(F.length("text") <= max_chars)
    rows = checkpointed(short.join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id", "text"]).withColumn("place", F.xxhash64("doc_id", "text")))
    first = rows.groupBy("doc_id").agg(F.min("place").alias("first"))
    ordered = rows.join(F.broadcast(first), "doc_id").withColumn("later", F.col("place") != F.col("first")).drop("first")
    of = lambda kind: ordered.where(kind).orderBy("later", "place").limit(2 * per_class).drop("later", "place")
    return of(F.col(label) == 0).unionByName(of(F.col(label) != 0))
