"""Language-model scores with deleted interpolation.

p(w | v) = l2 c(v w) / c(v) + l1 c(w) / N + l0 / (V + 1): maximum-likelihood estimates of the pair and of the word, and a
uniform share, mixed with weights that depend on how often the context v was seen (a bucket for each power of two). The
weights come from expectation-maximisation on a part of the training texts held back from the counts: its own counts are
deleted (subtracted) from those of all training texts.

Counting and look-up are one exchange. Texts are worked in batches of some megabytes; a batch sends each slice of the key
space the sorted distinct keys (64-bit hashes of words and of pairs) it has, with their counts, as one packed row, so that
a word as common as you like is one number from each batch. A slice adds up all batches and answers each with the totals
of its keys. The answers are written to the shared folder, and meet the texts again by a hash of the batch's contents. What a slice holds grows with the input and falls with the number of slices, which follows the number of rows.

Null and empty texts are the end token alone; rows repeat as often as in the input; with no training text all counts
are 0 and the score is the uniform one. The input must read the same twice (a stored table does); if it doesn't, the query
stops with an error rather than give wrong scores.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticklane.llm import spans as S
from ticklane.llm.common import bounded_batches, checkpointed, remainder, shuffle_width

BATCH_BYTES, ROWS_A_SLICE = 5_000_000, 4_000
#: Words have even keys, pairs odd ones.
BEGIN, END = np.uint64(2), np.uint64(4)
BUCKETS, BIN, LOWEST = 48, 0.05, -999
UNUSED, TRAIN, TUNE = 0, 1, 2


@dataclass
class Tokens:
    """Some texts as tokens, the last of each text END: the distinct keys in order, and of each token the numbers of its
    key, of the key before it (BEGIN for the first) and of the pair's key; tokens in each text."""

    keys: np.ndarray
    word: np.ndarray
    before: np.ndarray
    pair: np.ndarray
    sizes: np.ndarray


def tokens(texts: S.Texts) -> Tokens:
    n = len(texts)
    start, end, text = texts.runs(S.SPACES)
    hashes = S.span_hashes(S.LOWERED[texts.data], start, end) & ~np.uint64(1)
    word = np.full(len(hashes) + n, END, np.uint64)
    word[np.arange(len(hashes)) + text] = hashes
    sizes = np.bincount(text, minlength=n) + 1
    before = np.concatenate([[BEGIN], word[:-1]])
    begins = np.cumsum(sizes) - sizes
    before[begins] = BEGIN
    with np.errstate(over="ignore"):
        pair = S.mixed(before * np.uint64(0x9E3779B97F4A7C15) + S.mixed(word)) | np.uint64(1)
    keys, number = np.unique(np.concatenate([word, pair, [BEGIN]]), return_inverse=True)
    of_word, of_pair = number[: len(word)], number[len(word) : -1]
    of_before = np.concatenate([number[-1:], of_word[:-1]])
    of_before[begins] = number[-1]
    return Tokens(keys, of_word, of_before, of_pair, sizes)


def batches(stream, only: int | None) -> Iterator[tuple[pa.RecordBatch, np.ndarray, S.Texts, str]]:
    """Of Arrow batches (doc_id, text, part): rows, parts, texts and name of each batch; those of the tuning part apart."""
    for batch in stream:
        part = batch.column(2).to_numpy(zero_copy_only=False)
        for tune in (True,) if only == TUNE else (False, True):
            rows = np.flatnonzero((part == TUNE) == tune)
            if len(rows):
                own, of = batch.take(pa.array(rows)), part[rows]
                for texts in S.pieces(own.column(1), BATCH_BYTES):
                    at = slice(texts.first, texts.first + len(texts))
                    name = hashlib.blake2b(texts.data.tobytes() + texts.bounds.tobytes() + of[at].tobytes(), digest_size=12).hexdigest()
                    yield own.slice(texts.first, len(texts)), of[at], texts, name


def packed(counts: np.ndarray) -> bytes:
    return zstandard.compress(counts.astype(np.uint64).tobytes(), 1)


def unpacked(blob: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(blob), np.uint64).astype(np.int64)


def packed_keys(keys: np.ndarray) -> bytes:
    """The first key and the steps between sorted keys, which take six bytes in all but the smallest batches."""
    if not len(keys):
        return b""
    steps = np.diff(keys)
    wide = len(steps) and int(steps.max()) >> 48
    return keys[:1].tobytes() + (steps.tobytes() if wide else steps.view(np.uint8).reshape(-1, 8)[:, :6].tobytes())


def unpacked_keys(blob: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(blob, np.uint8)[8:]
    steps = np.zeros((n - 1, 8), np.uint8)
    if n > 1:
        steps[:, : len(raw) // (n - 1)] = raw.reshape(n - 1, -1)
    with np.errstate(over="ignore"):
        return np.cumsum(np.concatenate([np.frombuffer(blob[:8], np.uint64), steps.view(np.uint64).ravel()]), dtype=np.uint64)


def slice_cuts(keys: np.ndarray, slices: int) -> np.ndarray:
    """Where each slice of the key space begins in sorted keys, and their end."""
    bound = (np.arange(1, slices, dtype=object) * (1 << 64) // slices).astype(np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, bound), [len(keys)]])


def requests(slices: int):
    def run(stream):
        for _, part, texts, name in batches(stream, None):
            t = tokens(texts)
            used = np.repeat(part != UNUSED, t.sizes)
            seen = np.bincount(t.word[used], minlength=len(t.keys)) + np.bincount(t.pair[used], minlength=len(t.keys))
            seen[np.searchsorted(t.keys, BEGIN)] += int((part != UNUSED).sum())
            held = seen if (part == TUNE).any() else np.zeros_like(seen)
            cuts = slice_cuts(t.keys, slices)
            cut = lambda x, pack: [pack(x[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * slices), pa.array(range(slices), pa.int32()), pa.array(cut(t.keys, packed_keys), pa.binary()), pa.array(cut(seen, packed), pa.binary()), pa.array(cut(held, packed), pa.binary())],
                ["batch", "slice", "keys", "seen", "held"],
            )

    return run


def answer(table: pa.Table) -> pa.Table:
    """Totals of one slice: for each row the counts of its keys over all rows; and one row of the slice's own sums."""
    names, parts = table.column("batch").to_pylist(), table.column("slice").to_pylist()
    seen, held = ([unpacked(x) for x in table.column(name).to_pylist()] for name in ("seen", "held"))
    keys = [unpacked_keys(x, len(n)) for x, n in zip(table.column("keys").to_pylist(), seen, strict=True)]
    cuts = np.cumsum([len(k) for k in keys])[:-1]
    distinct, which = np.unique(np.concatenate(keys), return_inverse=True)
    total = lambda parts: np.bincount(which, weights=np.concatenate(parts), minlength=len(distinct)).astype(np.int64)
    seen, held = total(seen), total(held)
    word = (distinct & np.uint64(1) == 0) & (distinct != BEGIN) & (seen > 0)
    back = lambda x: [packed(y) for y in np.split(x[which], cuts)]
    own = [int(seen[word].sum()), int(word.sum()), int(held[word].sum())]
    return pa.table(
        {
            "batch": pa.array([*names, None], pa.string()), "slice": pa.array([*parts, parts[0]], pa.int32()), "seen": pa.array([*back(seen), b""], pa.binary()),
            "held": pa.array([*back(held), b""], pa.binary()), "sums": pa.array([*[None] * len(names), own], pa.list_(pa.int64())),
        }
    )


ANSWER = "batch string, slice int, seen binary, held binary, sums array<long>"


def carried(only: int | None):
    """The batches again, whole: ids and texts."""

    def run(stream):
        for own, _, _, name in batches(stream, only):
            lists = [pa.ListArray.from_arrays(pa.array([0, own.num_rows], pa.int32()), own.column(i)) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array([name]), *lists], ["batch", "ids", "texts"])

    return run


def looked_up(rows: pa.Table, answers: pa.Table) -> Iterator[tuple[list, np.ndarray, list[np.ndarray], list[np.ndarray]]]:
    """Of each batch: ids, tokens in each text, and counts (word, context, pair) in all training texts and in the tuning part."""
    if rows.num_rows and not answers.num_rows:
        raise ValueError("the input didn't read the same twice; write it to a table first")
    if not rows.num_rows:
        return
    _, one = np.unique(answers.column("slice").to_numpy(), return_index=True)  # equal batches have equal answers
    seen, held = (np.concatenate([unpacked(x) for x in answers.column(name).take(pa.array(one)).to_pylist()]) for name in ("seen", "held"))
    for i in range(rows.num_rows):
        column = rows.column("texts").chunk(0).slice(i, 1).flatten() if rows.column("texts").num_chunks == 1 else pa.concat_arrays(rows.column("texts").slice(i, 1).chunks).flatten()
        (texts,) = S.pieces(column, 1 << 62)
        t = tokens(texts)
        yield rows.column("ids")[i].as_py(), t.sizes, [seen[k] for k in (t.word, t.before, t.pair)], [held[k] for k in (t.word, t.before, t.pair)]


def bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.ceil(np.log2(context + 1)).astype(int), BUCKETS - 1)


def tuning_bins(total: int, types: int):
    """Held-back pairs by context bucket and by the ratios of the pair and word estimates to the uniform one, in steps of BIN."""

    def run(key, rows: pa.Table, answers: pa.Table) -> pa.Table:
        out: dict[tuple, int] = {}
        for _, _, seen, held in looked_up(rows, answers):
            word, context, pair = (a - b for a, b in zip(seen, held, strict=True))
            uniform = 1.0 / (types + 1)
            with np.errstate(divide="ignore", invalid="ignore"):
                of = lambda p: np.where(p > 0, np.round(np.log10(p / uniform) / BIN), LOWEST).astype(int)
                by_pair, by_word = of(np.where(context > 0, pair / np.maximum(context, 1), 0)), of(word / max(total, 1))
            cells, n = np.unique(np.stack([bucket(context), by_pair, by_word]), axis=1, return_counts=True)
            for cell, k in zip(cells.T.tolist(), n.tolist(), strict=True):
                out[tuple(cell)] = out.get(tuple(cell), 0) + k
        columns = list(zip(*[(*c, n) for c, n in out.items()], strict=True)) or [[]] * 4
        return pa.table({name: pa.array(x, pa.int64()) for name, x in zip(("bucket", "by_pair", "by_word", "n"), columns, strict=True)})

    return run


def learned_weights(cells: np.ndarray, rounds: int = 100) -> np.ndarray:
    """BUCKETS x 3 weights (uniform, word, pair) by expectation-maximisation over the bins (bucket, by_pair, by_word, n);
    a bucket without data takes the weights of the nearest one with data."""
    weights = np.full((BUCKETS, 3), np.nan)
    for b in range(BUCKETS):
        own = cells[cells[:, 0] == b]
        if not len(own):
            continue
        like = np.column_stack([np.ones(len(own)), *(np.where(own[:, i] > LOWEST, 10.0 ** (own[:, i] * BIN), 0.0) for i in (2, 1))])
        w = np.array([0.1, 0.4, 0.5])
        for _ in range(rounds):
            share = like * w
            share /= share.sum(1, keepdims=True)
            w = (share * own[:, 3:]).sum(0) + [0.5, 0.05, 0.05]
            w /= w.sum()
        weights[b] = w
    known = np.flatnonzero(~np.isnan(weights[:, 0]))
    if not len(known):
        return np.tile([0.1, 0.4, 0.5], (BUCKETS, 1))
    return weights[known[np.abs(np.arange(BUCKETS)[:, None] - known).argmin(1)]]


def token_scores(word, context, pair, weights: np.ndarray, total: int, types: int) -> np.ndarray:
    """log10 p of each token."""
    w = weights[bucket(context)]
    p = w[:, 0] / (types + 1) + w[:, 1] * word / max(total, 1) + w[:, 2] * pair / np.maximum(context, 1)
    return np.log10(p)


def scores(weights: np.ndarray, total: int, types: int):
    def run(key, rows: pa.Table, answers: pa.Table) -> pa.Table:
        out: dict[str, list] = {"doc_id": [], "n_tokens": [], "n_known": [], "base_score": [], "score": []}
        for ids, sizes, (word, context, pair), _ in looked_up(rows, answers):
            begins = np.cumsum(sizes) - sizes
            base = np.log10((word + 0.1) / (total + 0.1 * (types + 1)))
            out["doc_id"] += ids
            for name, x in (("n_tokens", np.ones(len(word), np.int64)), ("n_known", (word > 0).astype(np.int64)), ("base_score", base), ("score", token_scores(word, context, pair, weights, total, types))):
                out[name].append(np.add.reduceat(x, begins))
        join = lambda name, kind: pa.array(np.concatenate(out[name]) if out[name] else [], kind)
        return pa.table({"doc_id": pa.array(out["doc_id"], rows.schema.field("ids").type.value_type), "n_tokens": join("n_tokens", pa.int64()), "n_known": join("n_known", pa.int64()), "base_score": join("base_score", pa.float64()), "score": join("score", pa.float64())})

    return run


def learnable(doc_id):
    """Part of each text under op5's rule: scored only, counted, or counted and held back for the weights."""
    fold = remainder(doc_id, 10)
    return F.when(fold == 0, UNUSED).when(fold == 1, TUNE).otherwise(TRAIN)


def score_texts(documents: DataFrame, part_of) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row (doc_id, text)."""
    spark = documents.sparkSession
    bounded_batches(spark)  # from here on, so that both reads are cut into the same batches
    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), part_of(F.col("doc_id")).alias("part"))
    slices = max(2 * shuffle_width(spark), documents.count() // ROWS_A_SLICE)
    asked = rows.mapInArrow(requests(slices), "batch string, slice int, keys binary, seen binary, held binary")
    answers = checkpointed(asked.groupBy("slice").applyInArrow(answer, ANSWER))
    sums = answers.where(F.col("batch").isNull()).agg(*(F.sum(F.get("sums", F.lit(i))) for i in range(3))).first()
    total, types, tuned = (int(x or 0) for x in sums)
    replies = answers.where(F.col("batch").isNotNull()).drop("sums").groupBy("batch")
    again = lambda only: rows.mapInArrow(carried(only), f"batch string, ids array<{kind}>, texts array<string>").groupBy("batch")
    bins = again(TUNE).cogroup(replies).applyInArrow(tuning_bins(max(total - tuned, 1), types), "bucket long, by_pair long, by_word long, n long")
    cells = bins.groupBy("bucket", "by_pair", "by_word").agg(F.sum("n").alias("n")).toPandas().to_numpy()
    weights = learned_weights(cells)
    scored = again(None).cogroup(replies).applyInArrow(scores(weights, total, types), f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", (part_of(F.col("doc_id")) == UNUSED).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
