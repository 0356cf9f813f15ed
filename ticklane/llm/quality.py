"""Quality rules: counts over words and lines, and a linear-chain conditional random field that marks each line of a text
as content or boilerplate (Viterbi); a text whose content lines hold too small a share of its words is rejected.

The field's weights are learned from weak labels of single lines, made from a bounded sample of texts labelled good or bad
as wholes. Boilerplate are the lines of bad texts, and lines that stand in several texts of the sample among other neighbours
(menus, footers, notices; lines of near copies keep their neighbours); all other lines of good texts are content. Beside the
texts as they are, the field sees good texts with a run of a bad text's lines put in at a hash-chosen place, so that it learns
how labels change inside a text. The base rules are exact counts.

Null and empty texts have no words and so fail the base rules; a very long text is one sequence like others; rows repeat as
often as in the input; an empty table gives an empty result; ties in decoding go to content; without labels of both classes no
line is boilerplate. Columns named as a result are replaced by it.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticklane.llm import spans as S
from ticklane.llm.common import fitting_sample, fitting_texts, map_texts
from ticklane.llm.sequences import viterbi

SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
ENDINGS = np.zeros(256, bool)
ENDINGS[[ord(c) for c in ".!?:;\"')"]] = True
UPPER, LOWER, DIGIT = S.byte_set((0x41, 0x5A)), S.byte_set((0x61, 0x7A)), S.byte_set((0x30, 0x39))
REPEAT_WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT, MIN_CONTENT = 8, 20, 30, 0.5
N_FEATURES = 14
#: Texts in which a line stands, and the share of them in which its neighbours differ, from which it is one of many texts.
SHARED_TEXTS, OTHER_NEIGHBOURS = 3, 0.5
#: Lines of a bad text that are put into a good one at most.
SPLICED_LINES = 6
BLANKS = "\t\n\x0b\x0c\r "


@dataclass
class Measured:
    """Counts of the texts of a piece, and of their lines with a word: features, words, text."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    line_features: np.ndarray
    line_words: np.ndarray
    line_text: np.ndarray

    @property
    def base_failed(self) -> np.ndarray:
        return (self.n_words < MIN_WORDS) | (100 * self.n_repeat_words > MAX_REPEAT_PERCENT * self.n_words)


def repeated_windows(hashes: np.ndarray, text: np.ndarray, n: int, k: int = REPEAT_WINDOW) -> np.ndarray:
    """For each word, whether it is in a window of k words that stands twice or more in its text."""
    covered = np.zeros(len(hashes), bool)
    grams = S.rolling(hashes, k)
    if len(grams):
        whole = text[: len(grams)] == text[k - 1 :]
        at = np.flatnonzero(whole)
        key = S.within_text(text[at], grams[at], n)
        _, group, size = np.unique(key, return_inverse=True, return_counts=True)
        twice = at[size[group] > 1]
        steps = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(steps, twice, 1)
        np.add.at(steps, twice + k, -1)
        covered = np.cumsum(steps)[:-1] > 0
    return covered


def measure(texts: S.Texts) -> Measured:
    data, n = texts.data, len(texts)
    start, end, text = texts.runs(S.SPACES)
    hashes = S.span_hashes(data, start, end)
    repeat = repeated_windows(hashes, text, n)
    upto = lambda mask: np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    heads = upto((data & 0xC0) != 0x80)
    word_chars = heads[end] - heads[start]
    symbols = upto(SYMBOLS[data])
    line_start, line_end, line_text = texts.lines()
    first_word = np.searchsorted(start, line_start)
    line_words = np.searchsorted(start, line_end) - first_word
    keep = line_words > 0
    line_start, line_end, line_text, first_word, line_words = (x[keep] for x in (line_start, line_end, line_text, first_word, line_words))
    line_key = S.within_text(line_text, S.span_hashes(data, line_start, line_end), n)
    _, first, group = np.unique(line_key, return_index=True, return_inverse=True)
    again = np.ones(len(line_key), bool)
    again[first] = False
    over = lambda mask: (lambda c: c[line_end] - c[line_start])(upto(mask[data]))
    of_words = lambda values: (lambda c: c[first_word + line_words] - c[first_word])(upto(values))
    size = np.maximum(1, line_end - line_start)
    cased = np.maximum(1, over(UPPER) + over(LOWER))
    twin = np.zeros(len(start), bool)
    twin[1:] = (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])
    edge = line_text[1:] != line_text[:-1]
    opens, closes = np.append(True, edge), np.append(edge, True)
    last_byte = data[end[first_word + line_words - 1] - 1] if len(line_start) else np.zeros(0, np.uint8)
    features = np.column_stack([
        np.log1p(line_words) / 5, 10 * over(SYMBOLS) / size, 10 * over(data_mask(b"|")) / size, 10 * over(data_mask(b"!")) / size,
        over(UPPER) / cased, 5 * over(DIGIT) / size, again, of_words(repeat) / np.maximum(1, line_words), ENDINGS[last_byte],
        of_words(word_chars) / np.maximum(1, line_words) / 10, of_words(twin) / np.maximum(1, line_words), opens[: len(line_start)], closes[: len(line_start)], np.ones(len(line_start)),
    ])
    return Measured(
        np.bincount(text, minlength=n), S.sums(word_chars, text, n), symbols[texts.bounds[1:]] - symbols[texts.bounds[:-1]],
        np.bincount(line_text[again], minlength=n), S.sums(repeat, text, n), features.astype(float), line_words, line_text,
    )


def data_mask(chars: bytes) -> np.ndarray:
    mask = np.zeros(256, bool)
    mask[list(chars)] = True
    return mask


@dataclass
class LineField:
    """Weights of boilerplate (label 1) against content (label 0), and the transition scores."""

    weights: np.ndarray
    transitions: np.ndarray

    def content_share(self, m: Measured, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Share of each text's words in content lines, and the lines' labels."""
        scores = np.column_stack([np.zeros(len(m.line_text)), m.line_features @ self.weights])
        labels = viterbi(scores, np.bincount(m.line_text, minlength=n), self.transitions)
        content = np.bincount(m.line_text, weights=m.line_words * (labels == 0), minlength=n)
        return content / np.maximum(1, m.n_words), labels


def likelihood_gradient(params: np.ndarray, x: np.ndarray, y: np.ndarray, mask: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Gradient of the weighted log likelihood of the labels y (sequences x lines), from the marginals of forward and backward
    passes over all sequences at once."""
    length = mask.shape[1]
    pairs = mask[:, 1:] & mask[:, :-1]
    w, trans = params[: x.shape[2]], params[x.shape[2] :].reshape(2, 2)
    emit = np.stack([np.zeros(mask.shape), x @ w], 2)
    forward, backward = np.zeros_like(emit), np.zeros_like(emit)
    forward[:, 0] = emit[:, 0]
    for t in range(1, length):
        moved = np.logaddexp(forward[:, t - 1, 0, None] + trans[0], forward[:, t - 1, 1, None] + trans[1]) + emit[:, t]
        forward[:, t] = np.where(mask[:, t, None], moved, forward[:, t - 1])
    for t in range(length - 2, -1, -1):
        ahead = backward[:, t + 1] + emit[:, t + 1]
        moved = np.logaddexp(trans[:, 0] + ahead[:, 0, None], trans[:, 1] + ahead[:, 1, None])
        backward[:, t] = np.where(mask[:, t + 1, None], moved, backward[:, t + 1])
    total = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
    bad = np.exp(forward[..., 1] + backward[..., 1] - total[:, None])
    gap = np.where(mask, y - bad, 0) * weight[:, None]
    grad_trans = np.zeros((2, 2))
    for a in (0, 1):
        for b in (0, 1):
            p = np.exp(forward[:, :-1, a] + trans[a, b] + emit[:, 1:, b] + backward[:, 1:, b] - total[:, None])
            grad_trans[a, b] = (np.where(pairs, ((y[:, :-1] == a) & (y[:, 1:] == b)) - p, 0) * weight[:, None]).sum()
    return np.concatenate([np.einsum("st,stf->f", gap, x), grad_trans.ravel()])


def train_field(sequences: list[tuple[np.ndarray, np.ndarray, int]], steps: int = 300, rate: float = 0.1, ridge: float = 1e-3) -> LineField:
    """Maximum likelihood by gradient steps (Adam). A sequence is the features of a text's lines, their labels and what kind of
    text it is; all kinds weigh the same."""
    length = max(len(f) for f, _, _ in sequences)
    x = np.zeros((len(sequences), length, N_FEATURES))
    mask = np.zeros((len(sequences), length), bool)
    y = np.zeros((len(sequences), length), int)
    for i, (f, labels, _) in enumerate(sequences):
        x[i, : len(f)], mask[i, : len(f)], y[i, : len(f)] = f, True, labels
    kinds = Counter(kind for *_, kind in sequences)
    weight = np.array([1 / (len(kinds) * kinds[kind]) for *_, kind in sequences])
    params = np.zeros(N_FEATURES + 4)
    mean, square = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, steps + 1):
        grad = likelihood_gradient(params, x, y, mask, weight) - ridge * params
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad**2
        params += rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return LineField(params[:N_FEATURES], params[N_FEATURES:].reshape(2, 2))


def fit(documents: DataFrame, labels: DataFrame, per_class: int = 1500, max_chars: int = 16_000, max_lines: int = 48) -> LineField | None:
    """Fit on a bounded sample: about ``per_class`` labelled texts of each class, of up to ``max_chars`` characters; lines
    after the ``max_lines``-th of a sampled text begin another sequence."""
    known = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    picked = fitting_sample(known, "quality", per_class)  # some thousand ids
    rows = fitting_texts(documents, picked, "quality", per_class, max_chars).toPandas()
    rows = rows.sort_values(["doc_id", "text"]).drop_duplicates("text").reset_index(drop=True)
    made = weak_labels(list(zip(rows.text, (rows.quality == 0).tolist(), strict=True)))
    sequences, first = [], 0
    for texts in S.pieces(pa.array([text for text, *_ in made], pa.string())):
        m = measure(texts)
        ends = np.cumsum(np.bincount(m.line_text, minlength=len(texts)))
        for i, lines in enumerate(np.split(m.line_features, ends[:-1])):
            _, labels, kind = made[first + i]
            sequences += [(lines[a : a + max_lines], labels[a : a + max_lines], kind) for a in range(0, len(lines), max_lines)]
        first += len(texts)
    return train_field(sequences) if rows.quality.eq(0).nunique() == 2 and sequences else None


def weak_labels(texts: list[tuple[str, bool]]) -> list[tuple[str, np.ndarray, int]]:
    """Texts to learn from (text, label of each line with a word, kind) from different texts that are bad or not: all of them
    (kinds 0 and 1), and good ones with a run of a bad one's lines inside (kind 2)."""
    split = [[line for line in text.split("\n") if line.strip(BLANKS)] for text, _ in texts]
    stands, before, after = Counter(), defaultdict(set), defaultdict(set)
    for lines in split:
        around = [None, *lines, None]
        for line in set(lines):
            stands[line] += 1
        for i, line in enumerate(lines):
            before[line].add(around[i])
            after[line].add(around[i + 2])
    # on either side other lines each time, or the text's edge
    varied = lambda side, n: side == {None} or len(side) >= OTHER_NEIGHBOURS * n
    shared = {line for line, n in stands.items() if n >= SHARED_TEXTS and varied(before[line], n) and varied(after[line], n)}
    labels = [np.array([bad or line in shared for line in lines], int) for lines, (_, bad) in zip(split, texts, strict=True)]
    made = [("\n".join(lines), y, int(bad)) for lines, y, (_, bad) in zip(split, labels, texts, strict=True)]
    bad_ones = [lines for lines, (_, bad) in zip(split, texts, strict=True) if bad and lines]
    for lines, y, (text, bad) in zip(split, labels, texts, strict=True):
        if not bad and lines and bad_ones:
            spread = int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "big")
            source = bad_ones[spread % len(bad_ones)]
            begin, at = (spread >> 20) % len(source), (spread >> 40) % (len(lines) + 1)
            run = source[begin : begin + 1 + (spread >> 10) % SPLICED_LINES]
            made.append(("\n".join([*lines[:at], *run, *lines[at:]]), np.concatenate([y[:at], np.ones(len(run), int), y[at:]]), 2))
    return made


FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean, line_is_content array<boolean>"


def apply_rules(documents: DataFrame, field: LineField | None, text: str = "text", keep: list[str] | None = None, with_lines: bool = True) -> DataFrame:
    """Add the counts, base_failed, content_share, kept and line_is_content (of the lines with a word, in order)."""

    def start():
        def work(column):
            parts: dict[str, list] = {}
            for texts in S.pieces(column):
                m, n = measure(texts), len(texts)
                share, labels = field.content_share(m, n) if field else (np.ones(n), np.zeros(len(m.line_text), int))
                made = {"n_words": m.n_words, "word_chars": m.word_chars, "n_symbols": m.n_symbols, "n_dup_lines": m.n_dup_lines, "n_repeat_words": m.n_repeat_words}
                made |= {"base_failed": m.base_failed, "content_share": share, "kept": ~m.base_failed & (share >= MIN_CONTENT)}
                if with_lines:
                    cuts = np.cumsum(np.bincount(m.line_text, minlength=n))[:-1]
                    made["line_is_content"] = [part.tolist() for part in np.split(labels == 0, cuts)]
                for name, values in made.items():
                    parts.setdefault(name, []).append(values)
            return {name: pa.array(sum(x, []), pa.list_(pa.bool_())) if name == "line_is_content" else pa.array(np.concatenate(x)) for name, x in parts.items()}

        return work

    fields = FIELDS if with_lines else FIELDS.rpartition(",")[0]
    return map_texts(documents, text, documents.columns if keep is None else keep, fields, start)
