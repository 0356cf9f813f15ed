"""Filter audit, token counts and spelling variants: edge cases, and brute-force versions on small tables."""

import itertools
import random
import zlib
from collections import Counter

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ticklane.llm import audit, spelling, tokens
from ticklane.llm.queries import QUERIES

BPE = public_tokenizers.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(BPE)
LONG = "Der lange Text, mit vielen  Wörtern\n\n " * 9000


def test_lattice_has_an_edge_for_each_subset_and_next_filter(spark):
    assert len(set(audit.lattice(5))) == 80
    steps = audit.orders(spark, audit.FILTERS).collect()
    assert len(steps) == 600 and len({s.filter_order for s in steps}) == 120
    assert {(s.applied, s.next) for s in steps} == set(audit.lattice(5))


def _audit_by_hand(docs, labels):
    """Each order walked over each document."""
    marks = {}
    for i, q, t in labels:
        if i is not None:
            a, b = marks.get(i, (False, False))
            marks[i] = (a or q == 1, b or t == 1)
    rows = []
    for i, text, source in docs:
        text = text or ""
        w = [x for x in text.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if x]
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text),
            "D": any(c in "#$%&*|" for c in text), "E": i is not None and any(j is not None and j < i and (other or "") == text for j, other, _ in docs),
        }
        rows.append((source or "", fails, *marks.get(i, (False, False))))
    out = {}
    for part, order in itertools.product({r[0] for r in rows}, map("".join, itertools.permutations("ABCDE"))):
        mine = [r for r in rows if r[0] == part]
        for step, f in enumerate(order, 1):
            gone = [any(r[1][x] for x in order[: step - 1]) for r in mine]
            here = [r for r, g in zip(mine, gone, strict=True) if r[1][f] and not g]
            out[part, order, step] = [
                sum(not g and not r[1][f] for r, g in zip(mine, gone, strict=True)), len(here), sum(g and r[1][f] for r, g in zip(mine, gone, strict=True)),
                sum(r[1][f] and sum(r[1].values()) == 1 for r in mine), sum(r[2] for r in here), sum(r[3] for r in here),
            ]
    sums = Counter()
    for (part, order, step), v in out.items():
        sums[part, order[step - 1]] += v[1]
    return {(*k, *v, sums[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_against_every_order_walked_by_hand(spark):
    rng = random.Random(4)
    texts = [None, "", " \n", "a b c", "SHOUT " * 250, " ".join(f"w{i}" for i in range(250)), " ".join(f"w{i} #" for i in range(250)), "same words " * 300, "é ü 漢字 #", LONG]
    docs = [(rng.choice([None, *range(30)]), rng.choice(texts), rng.choice([None, "", "hot", "hot", "hot", "s1"])) for _ in range(160)]
    labels = [(rng.choice([None, *range(40)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(40)]
    rows = spark.createDataFrame([(*d, 1, "x", True) for d in docs], "doc_id long, text string, source string, fails int, words string, good boolean")
    marks = spark.createDataFrame([(*x, 5) for x in labels], "doc_id long, quality int, toxic int, part int")
    got = audit.audit(audit.document_failures(rows, marks), audit.FILTERS, ["good", "toxic"])
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    found = [tuple(r[c] for c in names) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == _audit_by_hand(docs, labels)
    assert dict(got.dtypes) == dict.fromkeys(names[3:], "bigint") | {"part": "string", "filter_order": "string", "step": "int"}


def test_audit_of_empty_tables(spark):
    rows = spark.createDataFrame([], "doc_id long, text string, source string")
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(audit.document_failures(rows, marks), audit.FILTERS, ["good", "toxic"]).count() == 0


PIECES = ["Hello", " world", "  ", "\n\n", "\t", " ", "don't", "'ll", "<|endoftext|>", " <|endoftext|> ", "<|endof", "日本語の文章、です。", "123", "é", "x y", "​ ", "...", "🙂", "\x1c", "\x85 ", "--- \r\n"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=60), st.integers(1, 25), st.integers(1, 200))
def test_parts_have_the_tokens_of_the_whole(pieces, limit, group):
    text = "".join(pieces)
    count, split = tokens.counter(BPE)
    assert split and "".join(tokens.parts(text, limit)) == text
    whole = len(PLAIN.encode(text, add_special_tokens=False).ids) if text else 0
    assert list(tokens.counts([text, "", text], count, True, limit, group)) == [whole, 0, whole]


def test_tokens_against_the_library(spark):
    texts = [None, "", " ", "one", "<|endoftext|>", "a<|endoftext|>b <|endoftext|> c", LONG, "x" * 70_000, "漢字、" * 30_000, LONG, "é" * 100]
    rows = spark.createDataFrame([(i, t, 3, 4) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int, n_bytes int")
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in tokens.count_tokens(rows, BPE, ["doc_id", "n_tokens"]).collect()}
    assert got == {i: (len((t or "").encode()), len(PLAIN.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(texts)}
    assert tokens.count_tokens(rows.limit(0), BPE, ["doc_id"]).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_tokenizers_encode_whole_texts(spark, name):
    path = public_tokenizers.path(name)
    assert not tokens.splittable(path)
    texts = ["Hello  World", LONG[:200_000], "", None]
    got = {r.doc_id: r.n_tokens for r in tokens.count_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, ["doc_id"]).collect()}
    if name.endswith(".json"):
        other = Tokenizer.from_file(path)
        plain = lambda t: len(other.encode(t, add_special_tokens=False).ids)
    else:
        import sentencepiece

        plain = lambda t: len(sentencepiece.SentencePieceProcessor(model_file=path).encode(t))
    assert got == {i: plain(t or "") for i, t in enumerate(texts)}


def test_token_query_on_the_smallest_tables(spark):
    sf = "/root/testdata/sf0.001"
    want = {r.doc_id: len(PLAIN.encode(r.text or "", add_special_tokens=False).ids) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op12_token_counts"](spark, sf).collect()
    assert {r.doc_id: r.n_tokens for r in got} == want and all(r.over_limit == (r.n_tokens > 512) for r in got)


def _near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def _variants_by_hand(docs, least, often, ratio):
    """All pairs of words."""
    seen = Counter()
    for doc_id, text in docs:
        run = ""
        for c in (text or "") + " ":
            if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c.lower() if c.isascii() else c
            elif run:
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                seen[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
                run = ""
    n = {w: k for w, k in seen.items() if len(w) >= least and k >= often}
    near = {w: [v for v in n if _near(w, v)] for w in n}
    best = {w: min(vs, key=lambda v: (-n[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in best.items() if n[v] >= ratio * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n[w], len(near[w]), n.get(form.get(w))) for w in n}


@pytest.mark.parametrize("seed", range(3))
def test_variants_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    base = ["receive", "receiver", "recieve", "aaaaaaa", "aaaaaaaa", "ééééééé", "Àéîõüÿz", "Straßen", "straßen", "bookkeeper", "×÷×÷×÷×"]
    def word():
        w = rng.choice(base)
        for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
            i = rng.randrange(len(w))
            w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("aeAéÿ") + w[i:], w[:i] + rng.choice("aeré") + w[i + 1 :]])
        return w
    docs = [(rng.choice([None, *range(50)]), " ".join(word() for _ in range(rng.randrange(60)))) for _ in range(60)]
    docs += [(1, None), (2, ""), (3, "receive " * 4000), (4, "receivr " * 300 + "recivr_abcdefg " * 25 + "abcdefh abcdefh"), (4, "short words only no"), (5, "x" * 30_000 + " " + "x" * 30_000)]
    rows = spark.createDataFrame([(*d, 1, "f") for d in docs], "doc_id long, text string, n int, form string")
    for ratio in (10, 2):
        got = spelling.variants(spelling.vocabulary(rows), ratio)
        found = [tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in got.collect()]
        assert len(found) == len(set(found)) and set(found) == _variants_by_hand(docs, 7, 2, ratio)
    assert dict(got.dtypes) == {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"}


def test_variants_of_nothing(spark):
    rows = spark.createDataFrame([(1, None), (2, "few short words")], "doc_id long, text string")
    for some in (rows, rows.limit(0)):
        assert spelling.variants(spelling.vocabulary(some)).count() == 0
