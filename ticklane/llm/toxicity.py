"""Toxicity by compression distance: windows of each text are compressed with a zstandard dictionary trained on ordinary
text and with one trained on toxic text, and the differences in length are held against calibrated thresholds.

Each dictionary is trained on the texts of its own class, all words of them: the ordinary one, large, on windows of ordinary
texts, the toxic one, small, on whole toxic texts, so that what many of them share comes first. A window is compressed with
the ordinary dictionary alone (behind as many unused bytes), and with the toxic one in front of it; both searches are
deep enough to find the nearest match, so common text costs the same in both and the difference is what the toxic dictionary
saves. The threshold is the number of saved bytes from which a window counts, the one of 1..TOP whose counts tell the classes
of calibration texts, which the dictionaries have not seen, apart best; a logistic curve over the text's counted windows and
all its windows, shifted to the share of toxic texts among all labelled ones, is the score.

Null and empty texts have no window and get the score of such a text; very long texts are windows like others; repeated rows
repeat; an empty table gives an empty result; without labels of both classes every score is 0. Columns named as a result
are replaced by it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticklane.llm import spans as S
from ticklane.llm.common import fitting_sample, fitting_texts, map_texts, remainder

WINDOW, STRIDE, TOP = 8, 4, 14
#: Bytes of the dictionaries, and of the segments and pieces that the toxic one is chosen by.
ORDINARY_BYTES, TOXIC_BYTES, SEGMENT, PIECE = 262_144, 4_096, 12, 6
#: Tables large enough for every place of the dictionaries, and a search for the longest of several matches.
SEARCH = dict(window_log=21, hash_log=18, chain_log=19, search_log=5, min_match=4, target_length=16, strategy=zstandard.STRATEGY_LAZY, write_content_size=False, write_checksum=False, write_dict_id=False)


def window_spans(texts: S.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of WINDOW words, one each STRIDE words, the last ones shorter: byte start, end, text."""
    start, end, text = texts.runs(S.SPACES)
    n = np.bincount(text, minlength=len(texts))
    first = np.cumsum(n) - n
    at = np.flatnonzero((np.arange(len(start)) - first[text]) % STRIDE == 0)
    last = np.minimum(at + WINDOW, first[text[at]] + n[text[at]]) - 1
    return start[at], end[last], text[at]


def _plain(part: S.Texts) -> np.ndarray:
    return np.where(S.SPACES[part.data], 32, S.LOWERED[part.data]).astype(np.uint8)


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    kept = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    search = zstandard.ZstdCompressionParameters(**SEARCH)
    kept.precompute_compress(compression_params=search)
    return zstandard.ZstdCompressor(dict_data=kept, compression_params=search)


def _lengths(compressor, data: bytes, segments: bytes, n: int) -> np.ndarray:
    made = compressor.multi_compress_to_buffer(zstandard.BufferWithSegments(data, segments))
    return np.fromiter(map(len, made), np.int64, n)


def window_counts(column, ordinary, toxic) -> np.ndarray:
    """Texts x (TOP + 1): windows that the toxic dictionary makes shorter by at least 1..TOP bytes, and all windows."""
    out = []
    for texts in S.pieces(column):
        start, end, text = window_spans(texts)
        n = len(texts)
        counts = np.zeros((n, TOP + 1))
        if len(start):
            plain = _plain(texts)
            # with the space on either side
            start, end = np.maximum(start - 1, 0), np.minimum(end + 1, len(plain))
            data, segments = plain.tobytes(), np.stack([start, end - start], 1).astype(np.uint64).tobytes()
            gain = _lengths(ordinary, data, segments, len(start)) - _lengths(toxic, data, segments, len(start))
            for d in range(1, TOP + 1):
                counts[:, d - 1] = np.bincount(text[gain >= d], minlength=n)
            counts[:, TOP] = np.bincount(text, minlength=n)
        out.append(counts)
    return np.concatenate(out) if out else np.zeros((0, TOP + 1))


@dataclass
class ToxicityModel:
    """The two dictionaries, the saved bytes from which a window counts, and the curve: weights of the logs of the counted and
    of all windows, and the intercept."""

    ordinary: bytes
    toxic: bytes
    threshold: int = 1
    weights: np.ndarray | None = None

    def compressors(self):
        return _compressor(bytes(len(self.toxic)) + self.ordinary), _compressor(self.toxic + self.ordinary)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_facts(counts, self.threshold) @ self.weights[:-1] + self.weights[-1], -700, 700)))


def _facts(counts: np.ndarray, threshold: int) -> np.ndarray:
    return np.log1p(counts[:, [threshold - 1, TOP]])


def _trained(samples: list[bytes], size: int, **choice) -> bytes:
    try:
        return zstandard.train_dictionary(size, samples, level=3, **choice).as_bytes()
    except zstandard.ZstdError:  # too few samples
        return b" ".join(samples)[-size:]


def _windows(texts: list[str]) -> list[bytes]:
    out = []
    for part in S.pieces(pa.array(texts, pa.string())):
        plain, (start, end, _) = _plain(part), window_spans(part)
        out += [plain[max(a - 1, 0) : b + 1].tobytes() for a, b in zip(start[::2], end[::2], strict=True)]
    return out


def train(toxic: list[str], ordinary: list[str], calibration: list[tuple[str, int]], toxic_share: float) -> ToxicityModel:
    """Dictionaries from the texts of the two classes; threshold and curve from the calibration texts, for a corpus of which
    ``toxic_share`` is toxic."""
    whole = [plain.tobytes() for text in toxic for part in S.pieces(pa.array([text])) for plain in (_plain(part),)]
    model = ToxicityModel(_trained(_windows(ordinary), ORDINARY_BYTES), _trained(whole, TOXIC_BYTES, k=SEGMENT, d=PIECE))
    counts = window_counts(pa.array([t for t, _ in calibration], pa.string()), *model.compressors())
    y = np.array([y for _, y in calibration], float)
    odds = lambda share: np.log(share / (1 - share))
    best = np.inf
    for threshold in range(1, TOP + 1):
        facts = _facts(counts, threshold)
        w = logistic(facts, y)
        z = facts @ w[:-1] + w[-1]
        loss = np.mean(np.logaddexp(0, np.where(y == 1, -z, z)))
        if loss < best:
            best, model.threshold = loss, threshold
            model.weights = np.append(w[:-1], w[-1] + odds(toxic_share) - odds(y.mean()))
    return model


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01, steps: int = 30) -> np.ndarray:
    """Newton's method with a ridge, on standardised columns; weights for the raw columns, the intercept last."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hessian = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, z.T @ (p - y) + ridge * w)
        w -= np.clip(step, -5, 5)
    raw = w[:-1] / scale
    return np.append(raw, w[-1] - raw @ mean)


def fit(documents: DataFrame, labels: DataFrame, per_class: int = 4000, max_chars: int = 16_000) -> ToxicityModel | None:
    """Fit on a bounded sample: about ``per_class`` labelled texts of each class of up to ``max_chars`` characters.

    A document with labels that differ counts as toxic. One text in four calibrates, the others train dictionaries."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = known.agg(F.avg((F.col("toxic") != 0).cast("int"))).first()[0]
    picked = fitting_sample(known, "toxic", per_class)  # some thousand ids
    rows = fitting_texts(documents, picked, "toxic", per_class, max_chars).toPandas()
    rows = rows.sort_values(["doc_id", "text"]).drop_duplicates("text").reset_index(drop=True)
    rows["toxic"] = (rows.toxic != 0).astype(int)
    held = rows.groupby("toxic").cumcount() % 4 == 0
    train_on, calibrate = rows[~held], rows[held]
    toxic, ordinary = (train_on[train_on.toxic == y].text.tolist() for y in (1, 0))
    if not toxic or not ordinary or calibrate.toxic.nunique() < 2:
        return None
    return train(toxic, ordinary, list(zip(calibrate.text, calibrate.toxic, strict=True)), share)


def score_toxicity(documents: DataFrame, model: ToxicityModel | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add score (0 to 1), windows and toxic_windows (those at or above the threshold)."""

    def start():
        tools = model.compressors() if model else None

        def work(column):
            counts = window_counts(column, *tools) if tools else np.zeros((len(column), TOP + 1))
            scores = model.scores(counts) if model else np.zeros(len(column))
            marked = counts[:, model.threshold - 1 if model else 0]
            return {"score": pa.array(scores), "windows": pa.array(counts[:, TOP].astype(np.int64)), "toxic_windows": pa.array(marked.astype(np.int64))}

        return work

    return map_texts(documents, text, documents.columns if keep is None else keep, "score double, windows long, toxic_windows long", start)


def learnable(labels: DataFrame) -> DataFrame:
    """The labels that op10 may learn from."""
    return labels.where(remainder(F.col("doc_id"), 5) != 0)
