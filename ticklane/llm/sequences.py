"""Viterbi decoding of many sequences at once."""

from __future__ import annotations

import numpy as np


def viterbi(scores: np.ndarray, lengths: np.ndarray, step: float | np.ndarray) -> np.ndarray:
    """Best label of each item. scores: items x labels, the sequences one after another, ``lengths`` items each.

    ``step`` is a label x label matrix added for each pair of neighbours, or a number: the price of any change of label.
    All sequences take their t-th step together, longest first, so Python's work is one step per place, not per item.
    The lower label wins a tie; a tie between staying and changing stays.
    """
    n, k = scores.shape
    best = np.zeros(n, np.int64)
    if n == 0 or k == 1:
        return best
    begins = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    begins, sizes = begins[order], lengths[order]
    live = int((sizes > 0).sum())
    begins, sizes = begins[:live], sizes[:live]
    going = np.searchsorted(-sizes, -np.arange(1, int(sizes[0]) + 1), side="right")  # sequences with a t-th item
    back = np.zeros((n, k), np.uint8 if k < 256 else np.int16)
    total = scores[begins].astype(np.float64)
    flat = np.isscalar(step)
    ks = np.arange(k)
    for t in range(1, int(sizes[0])):
        m = going[t]
        before = total[:m]
        at = begins[:m] + t
        if flat:
            top = before.argmax(1)
            change = before[np.arange(m), top] - step
            stay = before >= change[:, None]
            back[at] = np.where(stay, ks, top[:, None])
            total[:m] = np.where(stay, before, change[:, None]) + scores[at]
        else:
            through = before[:, :, None] + step
            top = through.argmax(1)
            back[at] = top
            total[:m] = np.take_along_axis(through, top[:, None, :], 1)[:, 0] + scores[at]
    label = total.argmax(1)
    for t in range(int(sizes[0]) - 1, -1, -1):
        m = going[t]
        at = begins[:m] + t
        best[at] = label[:m]
        if t:
            label[:m] = back[at, label[:m]]
    return best
