"""Token counts of whole texts by a public tokenizer, its file a parameter.

Each task encodes its Arrow batches and gives back lengths only. A batch is cut to groups of about equal bytes, so that what
the library holds for a group is bounded however long the texts are, and a text above ``PIECE_CHARS`` is split at places
where the tokenizer starts a new word whatever stands around them: its parts' counts add up to the whole text's. Byte-level
BPE cuts words by its fixed pattern, in which nothing that holds a visible character goes on into white space, and CJK
letters never share a word with CJK stops. A text without such places (one endless word) is encoded whole, and so is every text
of tokenizers with another way of cutting, or whose added tokens take white space beside them.

A null text is the empty text: 0 bytes, 0 tokens. Repeated rows are counted each; an empty table gives no rows. Strings of
special tokens inside texts are what the library's default makes of them, and none is added.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ticklane.llm.common import map_texts

#: Characters after which the next safe place is taken, and bytes in a group of texts or parts.
PIECE_CHARS, GROUP_BYTES = 50_000, 500_000
#: A visible ASCII character, or a CJK letter, before ASCII white space; a CJK letter before a CJK stop.
SAFE = re.compile("(?<=[!-~ぁ-ゖァ-ヺ一-鿿])(?=[ \t\n\r])|(?<=[ぁ-ゖァ-ヺ一-鿿])(?=[、。，])")


def splittable(path: str) -> bool:
    """Whether ``SAFE`` places are word starts for the tokenizer: byte-level BPE by the usual pattern on the text as it is."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    cut = spec.get("pre_tokenizer") or {}
    plain = not spec.get("normalizer") and cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
    wide = any(t.get("lstrip") or t.get("rstrip") or re.search(r"\s|[　-￿]", t["content"]) for t in spec.get("added_tokens") or [])
    return bool(plain and not wide)


@lru_cache(maxsize=4)
def counter(path: str):
    """A function from a list of texts to their token counts, kept by each Python worker, and whether texts may be split."""
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in pieces.encode(texts, num_threads=1)], False
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: list(map(len, tokenizer.encode_batch_fast(texts, add_special_tokens=False))), splittable(path)


def parts(text: str, limit: int = PIECE_CHARS) -> list[str]:
    """The text in parts of ``limit`` characters and what is left to the next safe place."""
    out, begin = [], 0
    while len(text) - begin > limit and (cut := SAFE.search(text, begin + limit)):
        out.append(text[begin : cut.start()])
        begin = cut.start()
    return [*out, text[begin:]] if begin else [text]


def counts(texts: list[str], count, split: bool, limit: int = PIECE_CHARS, group: int = GROUP_BYTES) -> np.ndarray:
    """Token counts of some texts, encoded in groups of about equal bytes."""
    cut = [parts(t, limit) if split and len(t) > limit else [t] for t in texts]
    owner = np.repeat(np.arange(len(cut)), [len(c) for c in cut])
    flat = [p for c in cut for p in c]
    size = np.array([len(p.encode()) for p in flat], np.int64)
    upto = np.cumsum(size)
    groups = max(1, -(-int(upto[-1]) // group)) if len(flat) else 1
    place = np.minimum((upto - size) * groups // max(1, int(upto[-1]) if len(flat) else 1), groups - 1)
    total = np.zeros(len(texts), np.int64)
    edges = np.flatnonzero(np.diff(place)) + 1
    for at in np.split(np.arange(len(flat)), edges):
        if len(at):
            np.add.at(total, owner[at], np.array(count(flat[at[0] : at[-1] + 1]), np.int64))
    return total


def count_tokens(documents: DataFrame, path: str, keep: list[str], text: str = "text") -> DataFrame:
    """The columns of ``keep``, n_bytes (UTF-8) and n_tokens of each row's text."""

    def start():
        count, split = counter(path)

        def work(column):
            column = column.fill_null("")
            made = np.zeros(len(column), np.int64)
            size = np.concatenate([[0], np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))])
            first = 0
            while first < len(column):  # a few groups' texts become Python strings at a time
                last = max(first + 1, int(np.searchsorted(size, size[first] + 4 * GROUP_BYTES, "right")) - 1)
                made[first:last] = counts(column.slice(first, last - first).to_pylist(), count, split)
                first = last
            return {"n_bytes": pa.array(np.diff(size)), "n_tokens": pa.array(made)}

        return work

    return map_texts(documents, text, keep, "n_bytes long, n_tokens long", start)
