"""Language of spans and of whole texts: script ranges narrow the candidates of each word, and Viterbi with a switching
penalty over the words' scores labels spans.

A word is a maximal run of letters of the lower-cased text. Its score in a language is the log probability of its
character 4-grams (hashed to 2**15 cells, with the space before and after it), learned from a bounded sample; a language
in which the word's script is not in use gets a large deduction. The language of a text is the label with most letters.

Nulls and texts without letters get ``und`` with score 0 and no spans; a tie between languages goes to the lesser name;
rows repeat as often as in the input; with nothing to learn from, every text is ``und``; a very long text is one sequence; an
empty table gives an empty result; columns named as a result are replaced by it. The model grows with the number of
languages: 128 KB for each, on the driver and in each task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticklane.llm import spans as S
from ticklane.llm.common import fitting_sample, map_texts, remainder
from ticklane.llm.sequences import viterbi

CELLS = 1 << 15
#: First code points of ranges of scripts (Unicode blocks), by name; letters elsewhere are "other".
SCRIPTS = [
    (0x0041, 0x024F, "latin"), (0x0370, 0x03FF, "greek"), (0x0400, 0x052F, "cyrillic"), (0x0530, 0x058F, "armenian"),
    (0x0590, 0x05FF, "hebrew"), (0x0600, 0x077F, "arabic"), (0x0900, 0x097F, "devanagari"), (0x0980, 0x09FF, "bengali"),
    (0x0B80, 0x0BFF, "tamil"), (0x0E00, 0x0E7F, "thai"), (0x10A0, 0x10FF, "georgian"), (0x1100, 0x11FF, "hangul"),
    (0x1E00, 0x1EFF, "latin"), (0x1F00, 0x1FFF, "greek"), (0x3040, 0x30FF, "kana"), (0x3400, 0x9FFF, "han"),
    (0xAC00, 0xD7AF, "hangul"), (0x20000, 0x323AF, "han"),
]
NAMES = sorted({name for *_, name in SCRIPTS})
#: A share of a language's letters under which a script is not in use in it.
IN_USE, WRONG_SCRIPT = 0.01, 50.0
_TABLES: list[np.ndarray] = []


def tables() -> tuple[np.ndarray, np.ndarray]:
    """Of every code point: whether it is a letter, and its script (0: other). Made once in each Python worker."""
    if not _TABLES:
        letter = np.zeros(0x110000, bool)
        letter[:] = [chr(i).isalpha() for i in range(0x110000)]
        script = np.zeros(0x110000, np.uint8)
        for low, high, name in SCRIPTS:
            script[low : high + 1] = 1 + NAMES.index(name)
        _TABLES.extend((letter, script))
    return _TABLES[0], _TABLES[1]


def letters_of(texts: S.Texts):
    """Of the letters of a piece: 4-gram cells, scripts, and where words begin; of the words: the texts they are in."""
    letter, script = tables()
    points = np.frombuffer(texts.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    bounds = np.concatenate([[0], np.cumsum((texts.data & 0xC0) != 0x80)])[texts.bounds]
    inside = letter[points]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    edges = bounds[1:-1][(bounds[1:-1] > 0) & (bounds[1:-1] < len(points))]
    begin[edges] = inside[edges]
    at = np.flatnonzero(inside)
    c = np.concatenate([[32, 32], np.where(inside, points, 32), [32]]).astype(np.uint32)  # a letter at i is c[i + 2]
    first = begin[at]
    two = c[at + 2]
    one = np.where(first, 32, c[at + 1])
    zero = np.where(one == 32, 32, c[at])
    second = np.concatenate([[False], first[:-1]]) & ~first
    zero = np.where(second, 32, zero)
    last = np.concatenate([first[1:], [True]]) if len(at) else first
    three = np.where(last, 32, c[at + 3])
    with np.errstate(over="ignore"):
        h = ((zero * np.uint32(0x01000193) ^ one) * np.uint32(0x01000193) ^ two) * np.uint32(0x01000193) ^ three
        cells = (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - 15)
    starts = np.flatnonzero(first)
    text = np.searchsorted(bounds, at[starts], side="right") - 1
    return cells, script[points[at]], starts, text


@dataclass
class LanguageModel:
    """Log probabilities (languages x cells) and the scripts in use (languages x scripts)."""

    languages: list[str]
    log_p: np.ndarray
    in_use: np.ndarray
    switch: float = 12.0

    def label(self, texts: S.Texts):
        """Span labels of all words of a piece, and letters of each word."""
        cells, script, starts, text = letters_of(texts)
        sizes = np.diff(np.append(starts, len(cells)))
        scores = np.zeros((len(starts), len(self.languages)), np.float32)
        block = 500_000
        w = 0
        while w < len(starts):  # so many letters at a time
            upto = max(w + 1, int(np.searchsorted(starts, starts[w] + block)))
            a, b = starts[w], starts[upto] if upto < len(starts) else len(cells)
            scores[w:upto] = np.add.reduceat(self.log_p[cells[a:b]], starts[w:upto] - a, axis=0)
            w = upto
        allowed = self.in_use[:, script[starts]].T if len(starts) else np.zeros(scores.shape, bool)
        scores -= WRONG_SCRIPT * (~allowed & allowed.any(1)[:, None])
        lengths = np.bincount(text, minlength=len(texts))
        return viterbi(scores, lengths, self.switch), sizes, text, lengths


def fit(documents: DataFrame, per_language: int = 1500, max_chars: int = 20_000) -> LanguageModel:
    """Learn from a sample of about ``per_language`` texts of each lang value, of up to ``max_chars`` characters; longer ones
    make up for what a value lacks.

    Counts are made on the executors; the driver gets languages x cells numbers at most."""
    texts = documents.select("doc_id", "lang", "text").where(F.col("text").isNotNull())
    sample = fitting_sample(texts, "lang", per_language, last=F.length("text") > max_chars).select("lang", "text")

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for texts in S.pieces(pc.utf8_lower(batch.column(1))):
                cells, script, starts, text = letters_of(texts)
                owner = np.repeat(text, np.diff(np.append(starts, len(cells))))
                for name in set(langs[texts.first : texts.first + len(texts)]):
                    of = np.isin(owner, [i for i in range(len(texts)) if langs[texts.first + i] == name])
                    seen = np.concatenate([np.bincount(cells[of], minlength=CELLS), np.bincount(script[of], minlength=len(NAMES) + 1)])
                    total[name] = total.get(name, 0) + seen
        for name, seen in total.items():
            at = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(seen[at], pa.int64())], ["lang", "cell", "n"])

    rows = sample.mapInArrow(count, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(rows["lang"].unique().tolist())
    seen = np.zeros((len(languages), CELLS + len(NAMES) + 1))
    seen[rows["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(int), rows["cell"].to_numpy(int)] = rows["n"]
    grams, scripts = seen[:, :CELLS] + 0.1, seen[:, CELLS:]
    log_p = np.log(grams / grams.sum(1, keepdims=True)).T.astype(np.float32)
    return LanguageModel(languages, log_p, scripts >= IN_USE * np.maximum(1, scripts.sum(1, keepdims=True)))


def label_languages(documents: DataFrame, model: LanguageModel, text: str = "text", keep: list[str] | None = None, with_spans: bool = True) -> DataFrame:
    """Add lang_pred, score (share of the letters in spans of that language) and lang_spans: runs of words, numbered from
    0 in the text, with their language."""

    def start():
        names = np.array([*model.languages, "und"])
        k = len(model.languages)

        def work(column):
            pred, score, runs = [], [], []
            for texts in S.pieces(pc.utf8_lower(column)):
                n = len(texts)
                if not k:
                    pred.append(np.zeros(n, int)), score.append(np.zeros(n)), runs.extend([] for _ in range(n))
                    continue
                labels, sizes, owner, lengths = model.label(texts)
                share = np.bincount(owner * k + labels, weights=sizes, minlength=n * k).reshape(n, k)
                top, all_ = share.argmax(1), share.sum(1)
                pred.append(np.where(all_ > 0, top, k))
                score.append(share[np.arange(n), top] / np.maximum(all_, 1))
                if with_spans:
                    runs.extend(_runs(labels, owner, lengths, names))
            out = {"lang_pred": pa.array(names[np.concatenate(pred)], pa.string()), "score": pa.array(np.concatenate(score), pa.float64())}
            if with_spans:
                out["lang_spans"] = pa.array(runs, pa.list_(pa.struct([("first_word", pa.int64()), ("words", pa.int64()), ("lang", pa.string())])))
            return out

        return work

    fields = "lang_pred string, score double" + ", lang_spans array<struct<first_word: bigint, words: bigint, lang: string>>" * with_spans
    return map_texts(documents, text, documents.columns if keep is None else keep, fields, start)


def _runs(labels, owner, lengths, names) -> list[list[dict]]:
    new = np.ones(len(labels), bool)
    new[1:] = (labels[1:] != labels[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(labels)))
    first = (np.cumsum(lengths) - lengths)[owner[at]]
    out: list[list[dict]] = [[] for _ in lengths]
    for i, a, n in zip(owner[at], at - first, size, strict=True):
        out[i].append({"first_word": int(a), "words": int(n), "lang": str(names[labels[a + (np.cumsum(lengths) - lengths)[i]]])})
    return out


def learnable(documents: DataFrame) -> DataFrame:
    """The rows that op3 may learn from."""
    return documents.where(remainder(F.col("doc_id"), 5) != 0)
