"""Edge cases and brute-force versions of the ten operators on small tables, and SQL at the smallest scale."""

import collections
import math
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from compare import same
from ticklane.llm import chat, common, decontam, html_text, langid, licenses, lm, mixing, neardup, quality, spans, toxicity
from ticklane.llm.common import fitting_texts, table
from ticklane.llm.components import components
from ticklane.llm.phrases import places
from ticklane.llm.queries import ORACLE_SQL, QUERIES
from ticklane.llm.sequences import viterbi

SF = "/root/testdata/sf0.001"
SPACE, ALNUM = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = "der lange text mit vielen worten " * 3000
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "One"), (5, "one"), (6, "é ü 漢字 кот"), (7, LONG), (8, LONG), (None, "no id here"), (9, "a\n\na\nb"), (9, "a\n\na\nb")]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns whose names clash with results."""
    rows = [(i, t, "en", None if i == 4 else "s", 1.5, True, 7) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double, kept boolean, size long")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    same(QUERIES[name](spark, SF), ORACLE_SQL[name], SF)


def test_chat_trees_and_round_trip(spark):
    nodes = [("r", None, 0.0, "user", "hi [INST]"), ("a", "r", 1.0, "assistant", "x<|im_end|>\n"), ("b", "r", 2.0, "assistant", "</s> <=|im_start|>"), ("c", "b", None, "user", None), ("d", "gone", 1.0, "sys\n^0", "q"), ("e", "f", 1.0, "user", ""), ("f", "e", 1.0, "user", "")]
    rows = spark.createDataFrame(nodes, "id string, parent_id string, score double, role string, text string")
    done = chat.format_paths(chat.reply_paths(rows, branches=2), rows).withColumn("turns", chat.read_back(F.col("formatted"))).withColumn("loss", chat.under_mask(F.col("formatted"), F.col("loss_spans")))
    got = {r.path_id: r for r in done.collect()}
    assert set(got) == {"a", "c", "d"} and (got["c"].branch, got["a"].branch) == (1, 2)
    assert [(t.role, t.text) for t in got["c"].turns] == [("user", "hi [INST]"), ("assistant", "</s> <=|im_start|>"), ("user", "")]
    assert got["c"].loss == "</s> <=|im_start|>" and got["a"].loss == "x<|im_end|>\n" and [t.role for t in got["d"].turns] == ["sys\n^0"]
    assert "[INST]" not in got["c"].formatted and "</s>" not in got["c"].formatted
    assert chat.reply_paths(rows.limit(0)).count() == 0


def test_near_dedup_when_the_largest_component_changes(spark):
    """Components A (600), B and C (500 each) of one cluster; the first round's hubs link B with C, which is then the largest. A node of A and one
    of C, neither of them a hub of that round, have equal sets and must still meet."""
    n, name = 1600, lambda v: "A" if v < 600 else "B" if v < 1100 else "C"
    turn = F.pmod(F.xxhash64("node", F.lit(3)), F.lit(1 << 30)) / F.lit(float(1 << 30)) * F.lit(n)
    by_turn = {r.node: r.turn for r in spark.range(n).select(F.col("id").alias("node")).withColumn("turn", turn).collect()}
    pick = lambda part, hub: next(v for v in sorted(by_turn) if name(v) == part and (by_turn[v] < neardup.FIRST_HUBS) == hub)
    hub_b, some_c, late_a, late_c = pick("B", True), pick("C", True), min((v for v in by_turn if name(v) == "A"), key=by_turn.get), pick("C", False)
    own = {v: [10 * v + k for k in range(5)] for v in range(n)}
    own[some_c], own[late_c] = own[hub_b], own[late_a]
    sets = spark.createDataFrame([(v, np.array(sorted(x), np.uint64).tobytes()) for v, x in own.items()], "node long, shingles binary")
    start = {"A": 0, "B": 600, "C": 1100}
    of = spark.createDataFrame([(v, start[name(v)]) for v in range(n)], "node long, component long")
    clustered = spark.createDataFrame([(v, 0, 40, n, 40 * n) for v in range(n)], "node long, cluster long, size long, n long, bytes long")
    join = lambda of, more: components(of.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    assert by_turn[late_a] < neardup.FIRST_HUBS <= by_turn[late_c]
    ended = neardup.linked_apart(clustered, of, sets, 80, join)
    assert {r.component for r in ended.select("component").distinct().collect()} == {0}


def test_chat_long_thread_and_null_id(spark):
    rows = spark.createDataFrame([(None, i, "user", str(i)) for i in range(37)], "conv_id long, turn long, role string, text string")
    messages = chat.as_chain(rows)
    (got,) = chat.format_paths(chat.reply_paths(messages), messages).withColumn("t", chat.read_back(F.col("formatted"))).collect()
    assert got.n_turns == 37 and [t.text for t in got.t] == [str(i) for i in range(37)]


@pytest.mark.parametrize("html, expected", [
    (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"),
    ("<body><nav><a href=x>menu</a></nav><header>site</header><div class='ad-box'>buy</div><article><h1>T &lt;1&gt;</h1><p>first  <b>bold</b>\n text<p>second<div class=comments><p>me too</div></article><aside>more</aside><footer>(c)</footer>", "T <1>\n\nfirst bold text\n\nsecond"),
    ("<body><div id=content><section><p>alpha beta gamma delta</p><p>epsilon zeta eta theta</p></section><section><p>iota kappa lambda mu nu</p></section></div><div id=menu><a>x</a><a>y</a></div></body>", "alpha beta gamma delta\n\nepsilon zeta eta theta\n\niota kappa lambda mu nu"),
    ("<p>unclosed <script>var a='<p>no</p>'", "unclosed"),
])
def test_html(html, expected):
    assert html_text.main_text(html) == expected


@pytest.mark.parametrize("attr", ["class=content-sidebar-wrap", "class='has-sidebar'", "class=no-sidebar", "class=menu-open", "id=legal-guide"])
@pytest.mark.parametrize("tag", ["main", "article", "div"])
def test_html_layout_wrappers_named_like_unwanted_blocks(attr, tag):
    text, ad = "the quick brown fox jumps over the lazy dog", "<div class=ad>buy now</div><div class=sidebar><p>a short note</p></div>"
    page = f"<body><div {attr}><{tag}><p>{text}</p><p>{text}</p>{ad}</{tag}></div>{ad}<p class=notice>cookies</p></body>"
    assert html_text.main_text(page) == f"{text}\n\n{text}"


LINE, LINKS = "the quick brown fox jumps over the lazy dog " * 6, "<ul>" + "<li><a href=x>some other story</a>" * 8 + "</ul>"
BODY = "".join(f"<p>{i} {LINE}</p>" for i in range(6))
PLAIN = [f"{i} {LINE}".strip() for i in range(6)]


@pytest.mark.parametrize("html, expected", [
    (f"<main><h1>T</h1><article>{BODY}</article><section><p>the rest</p></section></main>", ["T", *PLAIN, "the rest"]),
    (f"<body><article>{BODY}</article><div><p>beside {LINE}</p></div><div>{LINKS}</div></body>", [*PLAIN, f"beside {LINE}".strip()]),
    (f"<body>{LINKS}<h1>A title of forty characters or thereabouts</h1><div>{BODY}</div></body>", ["A title of forty characters or thereabouts", *PLAIN]),
    (f"<body><div><div class=title><h1>Title</h1></div><p>by me</p><div>{BODY}</div>{LINKS}</div></body>", ["Title", "by me", *PLAIN]),
    (f"<body><div>{BODY}</div><h2>Next</h2>loose <b>words</b><ul><li>low</ul>{LINKS}<div>{BODY}</div>{LINKS}</body>", [*PLAIN, "Next", "loose words", "low", *PLAIN]),
    (f"<body><section>{BODY}</section><div><section><p>two {LINE}</p></section><section><p>three {LINE}</p></section></div></body>", [*PLAIN, f"two {LINE}".strip(), f"three {LINE}".strip()]),
    (f"<body><div>{BODY}</div>{LINKS}{LINE * 3}</body>", [*PLAIN, (LINE * 3).strip()]),
    (f"<body><div>{BODY}</div><div>{LINE * 3}{LINKS}</div></body>", [*PLAIN, (LINE * 3).strip()]),
    (f"<body>{LINE * 3}<br><br>{LINE * 2}</body>", [(LINE * 5).strip()]),
])
def test_html_density_on_all_branches(html, expected):
    assert html_text.main_text(html).split("\n\n") == expected


@pytest.mark.parametrize("attr", ["class=copyright-law", "id=legal-history", "class='related-work share-prices'", "id=comment-on-method", "class=skip-lists"])
def test_html_names_that_only_hold_an_unwanted_word(attr):
    html = f"<body><nav><a href=x>menu</a></nav><article>{BODY}<section {attr}><p>of that matter</p></section></article><div {attr}><p>beside {LINE}</p></div></body>"
    assert html_text.main_text(html).split("\n\n") == [*PLAIN, "of that matter", f"beside {LINE}".strip()]
    alone = f"<body><article {attr}>{BODY}</article></body>"
    assert html_text.main_text(alone).split("\n\n") == PLAIN


def test_html_hidden_forms_and_comments():
    html = f"<body><form action=x><div>{BODY}<div hidden>secret</div><p aria-hidden=true>icon<p style=x>shown</div><select><option>a</select></form><form><label>name</label></form><div class='comments-list'>{BODY}</div><footer><p>(c) {LINE}</p></footer></body>"
    assert html_text.main_text(html).split("\n\n") == [*PLAIN, "shown"]
    assert html_text.main_text("<body><nav><a href=x>only</a> <a href=y>links</a></nav></body>") == "" and html_text.main_text("<article>x</article><nav><a>y</a></nav>") == "x"


REPLY = "<cite><a href=u>{0}</a></cite> <time>today</time><p>I agree with {0}, and {1}</p>"
REPLIES = [REPLY.format(name, LINE) for name in ("Ann", "Bo", "Cy")]


@pytest.mark.parametrize("extra", [
    "<ol class='commentlist'><li>me too</li></ol>", "<div id='respond'><h3>Leave a reply</h3><form><label>Name</label></form></div>", "<div class='legal-notice'>All rights reserved</div>",
    "<div class='share-buttons'><a href=x>Tweet</a> <a href=y>Share</a></div>", "<div style='display:none'>secret</div>", "<p style='color:red; Visibility : hidden !important'>secret</p>",
    "<h3>3 replies</h3><ul class=x>" + "".join(f"<li>{r}</li>" for r in REPLIES) + "</ul>", "<section><h2>What others say</h2>" + "".join(f"<div>{r}</div>" for r in REPLIES) + "</section>",
    "<div>" + "".join(f"<article><span class=author>{n}</span><div>{LINE}</div></article>" for n in "abc") + "</div>",
])
def test_html_what_an_article_may_hold_besides(extra):
    assert html_text.main_text(f"<body><article>{BODY}{extra}</article></body>").split("\n\n") == PLAIN
    assert html_text.main_text(f"<body><article>{BODY}{extra}<p>the end of it</p></article></body>").split("\n\n") == [*PLAIN, "the end of it"]


@pytest.mark.parametrize("kept, texts", [
    ("<ul><li><time>1990</time><p>founded</p></li><li><time>1995</time><p>sold</p></li></ul>", ["1990", "founded", "1995", "sold"]),
    ("<div><blockquote>to be <cite>W. S.</cite></blockquote><blockquote>or not <cite>W. S.</cite></blockquote></div>", ["to be W. S.", "or not W. S."]),
    ("<div><div><cite>Ann</cite><h3>Part one</h3><p>of hers</p></div><div><cite>Bo</cite><h3>Part two</h3><p>of his</p></div></div>", ["Ann", "Part one", "of hers", "Bo", "Part two", "of his"]),
    ("<ul><li><cite>One book</cite> by one</li></ul>", ["One book by one"]), ("<p style='display:block;border:none'>shown</p>", ["shown"]),
])
def test_html_shapes_that_are_no_comments(kept, texts):
    assert html_text.main_text(f"<body><article>{BODY}{kept}</article></body>").split("\n\n") == [*PLAIN, *texts]
    alone = "".join(f"<div>{r}</div>" for r in REPLIES)
    assert "I agree with Bo" in html_text.main_text(f"<body><div>{alone}</div></body>")


@pytest.mark.parametrize("html, expected", [
    (f"<html><head><title>t</title><meta charset=utf-8>{BODY}", PLAIN), (f"<head><title>t</title><div>{BODY}</div></body></html>", PLAIN), (f"<head>first {LINE}<p>second {LINE}", [f"first {LINE}".strip(), f"second {LINE}".strip()]),
    (f"<p>before {LINE}</p><body class=x>{BODY}", [f"before {LINE}".strip(), *PLAIN]), (f"<head><style>p{{}}</style></head><p>before {LINE}</p></body>{BODY}</html><p>after {LINE}", [f"before {LINE}".strip(), *PLAIN, f"after {LINE}".strip()]),
    (f"<body>{BODY}<head><p>late {LINE}</p></head></body>", [*PLAIN, f"late {LINE}".strip()]),
])
def test_html_head_and_body_tags_left_out(html, expected):
    assert html_text.main_text(html).split("\n\n") == expected


def test_html_density_against_a_recursive_version(spark):
    """Densities, sums and the chosen node of every page, from their definition, by recursion."""

    def count(node):
        chars = tags = link_chars = link_tags = 0
        for c in node.children:
            if isinstance(c, str):
                chars += len(" ".join(c.split()))
            else:
                below = count(c)
                link = c.tag == "a" or c.marked
                chars, tags, link_chars, link_tags = chars + below[0], tags + 1 + below[1], link_chars + below[2], link_tags + link + below[3]
        return (chars, tags, chars, tags) if node.tag == "a" or node.marked else (chars, tags, link_chars, link_tags)

    def density(node):
        chars, tags, link_chars, link_tags = count(node)
        ratio = (chars + 1) / (link_chars + 1) * (tags + 1) / (link_tags + 1)
        return chars / max(1, tags) * math.log(ratio, (chars + 1) * (tags + 1)) if chars else 0.0

    def total(node):
        return sum(density(c) for c in node.children if not isinstance(c, str)) or density(node)

    pages = [r.html for r in table(spark, "/root/testdata/sf0.01", "pages").where("html IS NOT NULL").orderBy("page_id").limit(200).collect()]
    assert len(pages) == 200
    for page in pages:
        builder = html_text.TreeBuilder()
        builder.feed(page)
        body = builder.body
        body.parent = None
        html_text.settle_marks(body)
        html_text.mark_replies(body)
        order = html_text.measure(body)
        html_text.densities(order)
        assert all(math.isclose(n.density, density(n), abs_tol=1e-9) and math.isclose(n.total, total(n), abs_tol=1e-9) for n in order)
        best = max(order, key=total)
        assert best is max(order, key=lambda n: n.total) or math.isclose(total(best), max(n.total for n in order))


def test_html_density_decides(spark, monkeypatch):
    """Without densities, pages keep what the density leaves out."""
    pages = [r.html for r in table(spark, SF, "pages").collect()]
    with_density = [html_text.main_text(p) for p in pages]
    monkeypatch.setattr(html_text, "densities", lambda order: None)
    assert sum(a != html_text.main_text(p) for a, p in zip(with_density, pages, strict=True)) >= 0.9 * len(pages)


@pytest.mark.parametrize("tags", ["<div>", "<b>", "<div><b>", "<ul><li>", "<a>"])
def test_html_deep_pages(tags):
    """50 000 elements deep, and as many end tags of an element that is open far above, in seconds."""
    n = 50_000
    began = time.monotonic()
    for html in (f"<p><i>first</i>{tags * n}deep text{'</i>' * n}", f"<body>{tags * n}{LINE}{'</div></b></li></ul></a>' * n}<p>after {LINE}"):
        assert ("deep text" if "deep" in html else "after") in html_text.main_text(html) or tags == "<a>"
    assert time.monotonic() - began < 30


def test_html_advert_longer_than_a_short_article():
    assert html_text.main_text("<body><div class=ad>a long advert of many words about nothing</div><article><p>short</article></body>") == "short"


def test_html_query_keeps_rows(spark):
    rows = spark.createDataFrame([(1, None, None, "x"), (1, "u", "<p>hello world</p>", "y")], "page_id long, url string, html string, text string")
    assert sorted(r.text for r in html_text.extract_main_text(rows).collect()) == ["", "hello world"]
    assert html_text.extract_main_text(rows.limit(0)).count() == 0


def test_viterbi_against_brute_force():
    rng = np.random.default_rng(1)
    lengths = np.array([0, 3, 1, 5, 0, 4])
    scores, step = rng.normal(size=(13, 3)), rng.normal(size=(3, 3))
    for cost in (0.7, step):
        pair = -cost * (1 - np.eye(3)) if np.isscalar(cost) else cost
        got, at = viterbi(scores, lengths, cost), 0
        for n in lengths:
            own = scores[at : at + n]
            value = lambda path, own=own: sum(own[i, k] for i, k in enumerate(path)) + sum(pair[a, b] for a, b in zip(path, path[1:]))
            if n:
                best = max((tuple(p) for p in np.ndindex(*[3] * n)), key=value)
                assert value(tuple(got[at : at + n])) == pytest.approx(value(best))
            at += n


def test_language_spans_and_edges(spark, odd):
    made = {"en": "the quick brown fox jumps over the lazy dog and runs away with the other animals", "de": "der schnelle braune fuchs springt über den faulen hund und läuft davon mit den anderen", "ru": "быстрая коричневая лиса прыгает через ленивую собаку и убегает"}
    train = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(list(made.items()) * 5)], "doc_id long, text string, lang string")
    model = langid.fit(train)
    rows = spark.createDataFrame([(1, made["en"] + " " + made["de"] + " " + made["de"], 0), (2, None, 0), (3, "123 !", 0), (4, made["ru"], 0)], "doc_id long, text string, score int")
    got = {r.doc_id: r for r in langid.label_languages(rows, model).collect()}
    assert [s.lang for s in got[1].lang_spans] == ["en", "de"] and got[1].lang_pred == "de" and 0.5 < got[1].score < 0.8
    assert sum(s.words for s in got[1].lang_spans) == len(rows.first().text.split())
    assert (got[2].lang_pred, got[3].lang_pred, got[4].lang_pred, got[4].score) == ("und", "und", "ru", 1.0)
    assert langid.label_languages(odd, langid.fit(train.limit(0))).where("lang_pred <> 'und'").count() == 0
    assert langid.label_languages(odd, model).count() == len(ODD) and langid.label_languages(odd.limit(0), model).count() == 0


def test_language_held_out_accuracy(spark):
    got = QUERIES["op3_language_id"](spark, "/root/testdata/sf0.01").join(table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_language_sample_with_rates_broadcast_or_shuffled(spark, monkeypatch):
    """Both ways choose the same rows, rows of ``last`` among them."""
    rows = [(i, None if i % 11 == 0 else f"l{i % 3}", "long " * 40 if i % 3 == 2 or i % 7 == 0 else "short") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    draw = lambda: sorted((r.doc_id, r.lang, r.text) for r in common.fitting_sample(docs, "lang", 50, last=F.length("text") > 100).collect())
    few = draw()
    monkeypatch.setattr(common, "BROADCAST_RATES", -1)
    assert few == draw() and {r[1] for r in few} == {"l0", "l1", "l2"} and any("long" in r[2] for r in few)


def test_language_of_long_texts_only(spark):
    rows = [(i, "de", "der lange text mit vielen worten " * 4) for i in range(40)] + [(100 + i, "xx", "zogu wabi muke tolo " * 8) for i in range(40)]
    rows += [(200 + i, "yy", None if i else "quaru pliko senna drovi " * 8) for i in range(40)] + [(300 + i, "de", "zogu wabi " * 50) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = langid.fit(docs, per_language=40, max_chars=150)
    assert model.languages == ["de", "xx", "yy"]
    fresh = spark.createDataFrame([(1, "muke tolo zogu wabi"), (2, "mit vielen worten"), (3, "senna drovi quaru")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in langid.label_languages(fresh, model).collect()} == {1: "xx", 2: "de", 3: "yy"}


def test_mixing_edges(spark, odd):
    sized = mixing.sizes(odd)
    got = mixing.mix(sized, mixing.targets(sized)).collect()
    assert len(got) == len(ODD) and all(0 <= r.taken <= 2 * r.size for r in got)
    by = collections.defaultdict(int)
    for r in got:
        by[r.source] += r.taken
    assert all(by[r.source] == math.floor(r.target) for r in got)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix(sized, mixing.targets(sized)).collect()), key=repr)
    assert mixing.mix(sized.limit(0), mixing.targets(sized.limit(0))).count() == 0
    cut = spark.createDataFrame([(" a  b\nc d", 4, 6)], "text string, size long, taken long")
    assert [(r.epoch, r.text) for r in mixing.written(cut).orderBy("epoch").collect()] == [(1, " a  b\nc d"), (2, " a  b")]


def test_lm_against_brute_force(spark, odd):
    got = lm.score_texts(odd.select("doc_id", "text"), lm.learnable).collect()
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10
    tokens = lambda t: re.findall(SPACE, (t or "").translate(ASCII)) + ["\n"]
    seen = collections.Counter(w for i, t in ODD if fold(i) for w in tokens(t))
    n, v = sum(seen.values()), len(seen)
    want = sorted((str(i), len(tokens(t)), sum(w in seen for w in tokens(t)), round(sum(math.log10((seen[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t)), 6)) for i, t in ODD)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want and {r.train_tokens for r in got} == {n}
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert lm.score_texts(odd.limit(0).select("doc_id", "text"), lm.learnable).count() == 0


def test_lm_score_against_plain_deleted_interpolation(spark):
    """Counts, mixture weights by expectation-maximisation and every text's score, computed one token at a time."""
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").select("doc_id", "text").where("length(text) < 4000").collect()] + [(901, None), (902, "new words only")]
    got = {r.doc_id: r for r in lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), lm.learnable).collect()}
    fold = {i: zlib.crc32(str(i).encode()) % 10 for i, _ in rows}
    pairs = {i: list(zip(["<s>", *w], w)) for i, t in rows for w in [[*re.findall(SPACE, (t or "").translate(ASCII)), "</s>"]]}
    word, pair, context, held_word, held_pair, held_context = (collections.Counter() for _ in range(6))
    for i, of in pairs.items():
        for v, w in of if fold[i] else []:
            word[w] += 1; pair[v, w] += 1; context[v] += 1  # noqa: E702
            if fold[i] == 1:
                held_word[w] += 1; held_pair[v, w] += 1; held_context[v] += 1  # noqa: E702
    total, types, tuned = sum(word.values()), len(word), sum(held_word.values())
    bucket = lambda n: math.ceil(math.log2(n + 1))
    step = lambda p: round(math.log10(p * (types + 1)) / lm.BIN) if p > 0 else None
    cells = collections.Counter()
    for i, of in pairs.items():
        for v, w in of if fold[i] == 1 else []:
            c, p, n = (x[k] - y[k] for x, y, k in ((word, held_word, w), (pair, held_pair, (v, w)), (context, held_context, v)))
            cells[bucket(n), step(p / n if n else 0), step(c / (total - tuned))] += 1
    weights = {}
    for b in {b for b, *_ in cells}:
        own, w = [(x, y, n) for (k, x, y), n in cells.items() if k == b], [0.1, 0.4, 0.5]
        for _ in range(100):
            sums = [0.5, 0.05, 0.05]
            for x, y, n in own:
                parts = [w[0], 0 if y is None else w[1] * 10 ** (y * lm.BIN), 0 if x is None else w[2] * 10 ** (x * lm.BIN)]
                sums = [s + n * p / sum(parts) for s, p in zip(sums, parts)]
            w = [s / sum(sums) for s in sums]
        weights[b] = w
    near = lambda b: weights[min(weights, key=lambda k: (abs(k - b), k))]
    for i, of in pairs.items():
        score = sum(math.log10(near(bucket(context[v]))[0] / (types + 1) + near(bucket(context[v]))[1] * word[w] / total + near(bucket(context[v]))[2] * pair[v, w] / max(context[v], 1)) for v, w in of)
        assert got[i].train_tokens == total and got[i].n_known == sum(word[w] > 0 for _, w in of) and got[i].score == pytest.approx(score, rel=1e-9)


def test_lm_mixture_and_packing():
    weights = lm.learned_weights(np.array([[1, 40, 10, 50], [3, lm.LOWEST, 10, 50]]))
    assert np.allclose(weights.sum(1), 1) and weights[1, 2] > 0.9 and weights[3, 2] < 0.05
    total = sum(10 ** lm.token_scores(np.array([c]), np.array([4]), np.array([p]), weights, 8, 3)[0] for c, p in ((5, 1), (2, 3), (1, 0), (0, 0)))
    assert total == pytest.approx(1)
    for keys in (np.array([], np.uint64), np.array([5], np.uint64), np.array([1, 2**63], np.uint64), np.sort(np.random.default_rng(0).integers(0, 2**63, 4000).astype(np.uint64)) * np.uint64(2)):
        assert (lm.unpacked_keys(lm.packed_keys(keys), len(keys)) == keys).all()


def brute_components(rows, k, percent):
    sets = {i: neardup.shingles(t or "", k) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_near_duplicates_against_brute_force(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(300)]
    base = rng.choice(vocabulary, 120)
    rows = [(i, " ".join(rng.choice(vocabulary, rng.integers(0, 40)))) for i in range(60)]
    for i in range(60, 220):  # copies with more and more words changed, so that links chain and some just miss
        text = base.copy()
        text[rng.choice(120, int(rng.integers(0, 9)), replace=False)] = "z" + str(i)
        rows.append((i, " ".join(text)))
    rows += [(300, "One"), (301, "one"), (302, "two"), (303, None), (304, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in neardup.near_duplicates(df, 2, 80).collect()}
    want = brute_components(rows, 2, 80)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


@pytest.mark.parametrize("hubs", [64, 1])
def test_near_duplicates_with_repeated_ids_against_brute_force(spark, monkeypatch, hubs):
    """Ids with several texts link what any of their texts links; many small rounds of hubs find what one large one finds."""
    monkeypatch.setattr(neardup, "FIRST_HUBS", hubs)
    monkeypatch.setattr(neardup, "MORE_HUBS", 2 if hubs == 1 else 8)
    rng = np.random.default_rng(11)
    vocabulary = [f"w{i}" for i in range(500)]
    rows = []
    for family in range(12):
        base = rng.choice(vocabulary, 100)
        for j in range(8):
            text = base.copy()
            text[rng.choice(100, int(rng.integers(0, 10)), replace=False)] = f"z{family}_{j}"
            rows.append((100 * family + j, " ".join(text)))
        rows.append((100 * family + 3, " ".join(rng.choice(vocabulary, 60))))
    rows += [(5000, "same words here"), (5000, "other text"), (5001, "other  TEXT"), (5002, "same words here"), (5003, "b a b"), (5004, "a b a"), (5002, "same words here")]
    sets = [neardup.shingles(t, 2) for _, t in rows]
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(rows[a][0]), root(rows[b][0])))
                parent[y] = x
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == sorted((i, len(s), root(i), i == root(i)) for (i, _), s in zip(rows, sets, strict=True))


def test_components_of_a_long_path_and_a_large_star(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1400)] + [(2000, 2000), (1400, 1000)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(301)} | {i: 1000 for i in range(1000, 1401)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_edges(spark, odd):
    got = neardup.near_duplicates(odd.select("doc_id", "text"), 2, 80).collect()
    assert len(got) == len(ODD) and {r.doc_id: r.component_id for r in got} | {None: None} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6, 7: 7, 8: 7, 9: 9, None: None}
    assert neardup.near_duplicates(odd.limit(0).select("doc_id", "text"), 2, 80).count() == 0


def test_estimate_follows_similarity():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 48, 1000).astype(np.uint64)
    errors = []
    for keep in (1000, 889, 700):
        other = np.concatenate([base[:keep], rng.integers(0, 1 << 48, 1000 - keep).astype(np.uint64)])
        sign = neardup.packed(neardup.minima(np.concatenate([np.sort(base), np.sort(other)]), np.array([0, 1000]))).view(np.uint64)
        x = sign[0] ^ sign[1]
        apart = np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum()
        errors.append(((1 - apart / neardup.MINIMA) - 0.25) / 0.75 - keep / (2000 - keep))
    assert max(map(abs, errors)) < 0.12


def test_quality_counts_against_brute_force():
    texts = [t for _, t in ODD] + ["a b c d e f g h " * 3, "x# y$ <z>\nx# y$ <z>\n\n \n"]

    def brute(t):
        w, lines = re.findall(SPACE, t or ""), [x for x in (t or "").split("\n") if re.search(SPACE, x)]
        grams = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        hit = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit)

    for part in spans.pieces(pa.array(texts, pa.string()), 500):
        m = quality.measure(part)
        for i in range(len(part)):
            assert tuple(int(x[i]) for x in (m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words)) == brute(texts[part.first + i])


def test_quality_keeps_clean_and_rejects_junk(spark, odd):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op7_quality_rules"](spark, sf).join(table(spark, sf, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality")), "doc_id").where("not base_failed")
    rows = {r.quality: (r["count"], r.kept) for r in got.groupBy("quality").agg(F.count("*").alias("count"), F.count_if("kept").alias("kept")).collect()}
    assert rows[1][1] >= 0.99 * rows[1][0] and rows[0][1] <= 0.1 * rows[0][0]
    assert quality.apply_rules(odd, None).count() == len(ODD) and quality.apply_rules(odd.limit(0), None).count() == 0


def test_line_field_gradient_against_brute_force():
    """Marginals by forward and backward passes equal those summed over all labellings."""
    rng = np.random.default_rng(8)
    x, mask, y = rng.normal(size=(3, 4, 3)), np.array([[1, 1, 1, 1], [1, 1, 0, 0], [1, 0, 0, 0]], bool), rng.integers(0, 2, (3, 4))
    params, weight = rng.normal(size=7), np.array([0.2, 0.5, 0.3])

    def log_likelihood(p):
        w, trans, total = p[:3], p[3:].reshape(2, 2), 0.0
        for i in range(3):
            n = int(mask[i].sum())
            value = lambda path: sum(x[i, t] @ w * path[t] for t in range(n)) + sum(trans[a, b] for a, b in zip(path, path[1:]))  # noqa: B023, E731
            total += weight[i] * (value(y[i, :n]) - math.log(sum(math.exp(value(path)) for path in np.ndindex(*[2] * n))))
        return total

    step = 1e-6
    want = [(log_likelihood(params + step * e) - log_likelihood(params - step * e)) / (2 * step) for e in np.eye(7)]
    assert quality.likelihood_gradient(params, x, y, mask, weight) == pytest.approx(want, abs=1e-6)


def test_lines_of_a_mixed_text_get_mixed_labels(spark):
    """Junk lines inside a good text are boilerplate, its own lines content, and the share counts words."""
    sf = "/root/testdata/sf0.01"
    documents, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    field = quality.fit(documents, labels)
    good = documents.join(labels.where("quality = 1"), "doc_id").where("size(split(text, '\n')) between 3 and 12").orderBy("doc_id").limit(40).collect()
    junk = ["a | b | c | d | e | f | g | h | i | j", "BUY!! NOW!! THE!! THIS!! AND!! THAT!! NOW!! THE!!", "x### y$$$ z%%% w*** the&&& of### and$$$ to%%%"]
    texts = [(i, "\n".join([*own[: len(own) // 2], *junk, *own[len(own) // 2 :]])) for i, own in enumerate(r.text.split("\n") for r in good)]
    rows = quality.apply_rules(spark.createDataFrame(texts, "doc_id long, text string"), field).collect()
    right = n = 0
    for r in rows:
        lines = [x for x in r.text.split("\n") if re.search(SPACE, x)]
        assert len(lines) == len(r.line_is_content)
        content = sum(len(re.findall(SPACE, x)) for x, good_line in zip(lines, r.line_is_content) if good_line)
        assert r.content_share == pytest.approx(content / r.n_words)
        right += sum(not y for x, y in zip(lines, r.line_is_content) if x in junk)
        n += sum(x in junk for x in lines)
    assert right >= 0.9 * n and sum(0 < r.content_share < 1 for r in rows) >= 0.9 * len(rows)


def test_weak_labels_by_line():
    own = ["one two three", "four five six", "seven eight"]
    texts = [("\n".join(["menu", f"{i} {own[i]}", f"end {i}"]), False) for i in range(3)] + [("junk\nmore junk", True)]
    made = quality.weak_labels(texts)
    assert [y.tolist() for _, y, kind in made if kind == 0] == [[1, 0, 0]] * 3 and [y.tolist() for _, y, kind in made if kind == 1] == [[1, 1]]
    mixed = [(t.split("\n"), y.tolist()) for t, y, kind in made if kind == 2]
    assert len(mixed) == 3 and all(len(t) == len(y) and all(bool(label) == (line == "menu" or "junk" in line) for line, label in zip(t, y)) for t, y in mixed)
    copies = quality.weak_labels([(f"a b\nc d\ne f\n{i}", False) for i in range(9)])  # near copies aren't menus
    assert all(y.sum() == 0 for _, y, _ in copies)


def test_toxicity_dictionaries_are_of_their_class_and_thresholds_count(spark):
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(3000)]
    text = lambda bad: " ".join(np.insert(rng.choice(words, 60).astype("<U12"), 30, "zzyzxq" if bad else "plain"))
    made = [(text(i % 2), i % 2) for i in range(1200)]
    model = toxicity.train([t for t, y in made[:900] if y], [t for t, y in made[:900] if not y], made[900:], 0.5)
    assert b"zzyzxq" in model.toxic and b"zzyzxq" not in model.ordinary and len(model.toxic) <= toxicity.TOXIC_BYTES
    column = pa.array([t for t, _ in made[900:]] + [None, ""], pa.string())
    counts = toxicity.window_counts(column, *model.compressors())
    ordinary, toxic = model.compressors()
    for i in (0, 1, 5):  # the counts are those of windows compressed one by one
        w = made[900 + i][0].split()
        cut = [" ".join(w[a : a + 8]) for a in range(0, len(w), 4)]
        spaced = [(" " if a else "") + x + (" " if 4 * a + 8 < len(w) else "") for a, x in enumerate(cut)]
        gains = [len(ordinary.compress(x.encode())) - len(toxic.compress(x.encode())) for x in spaced]
        assert counts[i].tolist() == [sum(g >= d for g in gains) for d in range(1, toxicity.TOP + 1)] + [len(gains)]
    assert counts[-2:].sum() == 0


def test_licenses(spark, odd):
    texts = ["Released under the MIT License.", "licensed under the Apache License, new Version 2.0", "CC BY and cc-by; All Rights Reserved", "licensed under the sun", None, "the general public license"]
    got = {r.doc_id: r for r in licenses.find_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    labels = {i: sorted({s.label for s in r.spans}) for i, r in got.items()}
    assert labels == {0: ["mit"], 1: ["apache"], 2: ["cc-by", "reserved"], 3: [], 4: [], 5: ["gpl"]}
    assert [(s.first_word, s.kind) for s in got[2].spans if s.label == "cc-by"] == [(0, "phrase"), (3, "phrase")] and got[5].spans[0].first_word == 1
    assert licenses.find_licenses(odd.select("doc_id", "text")).count() == len(ODD) and licenses.find_licenses(odd.limit(0)).count() == 0


def test_licenses_against_brute_force(spark):
    """Base places by a plain search; votes by diagonal, merged and measured one text at a time."""
    rng = np.random.default_rng(9)
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    for i in range(60):  # notices with words left out, put in and changed, twice in one text, across its end
        w = " and ".join(licenses.NOTICES[j][1] for j in rng.integers(0, len(licenses.NOTICES), 2)).split()
        for at in rng.integers(0, len(w), int(rng.integers(0, 6))):
            w[at] = ["", f"{w[at]} extra", "other"][int(rng.integers(3))]
        rows.append((10_000 + i, " ".join(w[: int(rng.integers(5, 60))]) + " CC-BY"))
    grams = collections.defaultdict(list)
    for n, (_, notice) in enumerate(licenses.NOTICES):
        w = notice.split()
        for j in range(len(w) - 2):
            grams[tuple(w[j : j + 3])].append((n, j))

    def brute(text):
        w = re.findall(ALNUM, (text or "").translate(ASCII))
        base = sorted((i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split())
        votes = collections.defaultdict(list)
        for i in range(len(w) - 2):
            for n, j in grams.get(tuple(w[i : i + 3]), ()):
                votes[n].append((i - j, j))
        labels = {label for _, label in base}
        for n, own in votes.items():
            label, size, span = licenses.NOTICES[n][0], len(licenses.NOTICES[n][1].split()), []
            for d, j in [*sorted(own), (math.inf, 0)]:
                if span and d - span[-1][0] > 2:
                    if len({k + x for _, k in span for x in range(3)}) / size >= 0.7:
                        labels.add(label)
                    span = []
                span.append((d, j))
        return len(w), [i for i, _ in base], sorted({label for _, label in base}), sorted(labels)

    found = licenses.find_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {r.doc_id: (r.n_words, sorted(s.first_word for s in r.spans if s.kind == "phrase"), sorted({s.label for s in r.spans if s.kind == "phrase"}), sorted({s.label for s in r.spans})) for r in found}
    assert got == {i: brute(t) for i, t in rows} and sum(len(x[3]) > len(x[2]) for x in got.values()) > 20


def test_decontamination_edges(spark, odd):
    items = spark.createDataFrame([(1, "one"), (2, None), (3, "vielen worten der lange text mit vielen worten der lange text"), (None, "漢字 кот"), (4, "no id here"), (10, "ONE")], "item_id long, text string")
    got = decontam.find_contamination(odd.select("doc_id", "text"), items).collect()
    assert len(got) == len(ODD)
    by = {r.doc_id: r for r in got}
    assert by[4].items == ["1", "10"] and by[4].n_hit == 1 and by[6].items == [""] and by[6].n_hit == 2 and by[None].items == ["4"]
    assert by[7].items == ["3"] and by[7].n_hit == 18000 - 4 - 0 or by[7].n_hit > 17900
    assert decontam.find_contamination(odd, items.limit(0)).where("n_hit > 0").count() == 0 and decontam.find_contamination(odd.limit(0), items).count() == 0


def test_places_by_broadcast_and_by_shuffle_against_brute_force(spark):
    rng = np.random.default_rng(6)
    texts = [(i, rng.choice(list("abcd"), int(n)).tolist()) for i, n in enumerate(rng.integers(0, 12, 40))] + [(None, ["a", "b"]), (0, None), (50, ["a"] * 3), (50, ["a"] * 3)]
    texts[41] = (60, [])
    phrases = [(["a"], 0, 1), (["a", "b"], 0, 2), (["b", "c", "a"], 1, 3), (["d"], 0, 4), (["a", "a"], 0, 5), (["c", "c", "d", "a"], 2, 6)]
    df, ph = spark.createDataFrame(texts, "id long, w array<string>"), spark.createDataFrame(phrases, "words array<string>, offset int, payload long")
    want = collections.Counter((i, a, p, None) for i, w in set((i, tuple(w)) for i, w in texts) for words, _, p in phrases for a in range(len(w) - len(words) + 1) if list(w[a : a + len(words)]) == words)
    total = collections.Counter((i, None, None, len(w)) for i, w in texts)
    for limit in (1 << 20, 0):
        got = collections.Counter((r.id, r.start, r.payload, r.total) for r in places(df, ["id"], ph, limit).collect())
        assert set(got) == set(want) | set(total) and all(got[k] == n for k, n in total.items())


def test_toxicity(spark, odd):
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(400)]
    text = lambda bad: " ".join([*rng.choice(words, 40), *(["zzyzxq", "qwrtpl"] if bad else []), *rng.choice(words, 40)])
    made = [(text(i % 2), i % 2) for i in range(900)]
    model = toxicity.train([t for t, y in made[:600] if y], [t for t, y in made[:600] if not y], made[600:], 0.5)
    fresh = [(i, text(i % 2)) for i in range(200)]
    got = {r.doc_id: r.score >= 0.5 for r in toxicity.score_toxicity(spark.createDataFrame(fresh, "doc_id long, text string"), model).collect()}
    assert sum(got[i] == bool(i % 2) for i in got) >= 190
    for m in (model, None):
        rows = toxicity.score_toxicity(odd, m).collect()
        assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.fit(odd, spark.createDataFrame([], "doc_id long, toxic int")) is None


@pytest.mark.parametrize("repeated", [lambda i: "same words again", lambda i: f"other words {i} again"])
def test_fits_with_one_id_in_most_rows(spark, repeated):
    rows = [(0, repeated(i)) for i in range(900)] + [(i, f"text {i} " + ("zzyzxq qwrtpl " * 5 if i % 2 else "plain words ") * 3) for i in range(1, 40)]
    documents = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(40)], "doc_id long, toxic int, quality int")
    got = fitting_texts(documents, labels.select("doc_id", "toxic"), "toxic", 30, 16_000).collect()
    assert {r.doc_id for r in got} == set(range(40)) and len(got) == len({(r.doc_id, r.text) for r in got}) <= 120
    assert toxicity.fit(documents, labels, per_class=30) is not None and quality.fit(documents, labels, per_class=30) is not None


def test_pipeline_stages(spark, odd):
    import corpus_pipeline as p

    docs = table(spark, "/root/testdata/sf0.01", "documents")
    extra = docs.withColumn("row", F.lit(1)).withColumn("score", F.lit("s")).limit(300)
    for _, stage in p.STAGES[:-1]:
        kept = stage(spark, extra, "/root/testdata/sf0.01")
        assert kept.columns == extra.columns and 200 < kept.count() <= 300
    assert p.language_id(spark, odd.where("doc_id is not null"), SF).columns == odd.columns
    mix = p.mixed(spark, odd, SF).collect()
    assert {r.epoch for r in mix} <= {1, 2} and all(len(re.findall(SPACE, r.text)) <= r["size"] for r in mix)


@pytest.mark.parametrize("ids, want", [("5A 5B 7A 3B", "5A 3B"), ("5A 5A 4B", "5A 5A 4B"), ("1A 2C 3A 4C 9B 8B", "1A 8B")])
def test_near_dedup_keeps_a_text_of_each_kind(spark, ids, want):
    import corpus_pipeline as p

    base = {x: " ".join(f"{x}{i}" for i in range(60)) for x in "AB"}
    texts = {**base, "C": base["A"] + " end"}
    docs = spark.createDataFrame([(int(x[0]), texts[x[1]]) for x in ids.split()], "doc_id long, text string")
    got = sorted(f"{r.doc_id}{k}" for r in p.near_dedup(spark, docs, SF).collect() for k, t in texts.items() if t == r.text)
    assert got == sorted(want.split())


def test_near_dedup_agrees_with_the_operator_where_ids_are_unique(spark):
    import corpus_pipeline as p

    docs = table(spark, "/root/testdata/sf0.01", "documents")
    want = {r.doc_id for r in neardup.near_duplicates(docs.select("doc_id", "text"), k=5, percent=80).where("kept").collect()}
    assert sorted(r.doc_id for r in p.near_dedup(spark, docs, SF).collect()) == sorted(want)


def test_pipeline_against_brute_force(spark):
    """The stages that SQL or Python can repeat, on what the stages before kept."""
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    docs = p.quality_rules(spark, p.language_id(spark, table(spark, sf, "documents"), sf), sf).cache()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = {i for i, (_, c) in brute_components(rows, 5, 80).items() if i == c}
    left = p.near_dedup(spark, docs, sf)
    assert {r.doc_id for r in left.collect()} == want
    windows = set()
    for r in table(spark, sf, "benchmark").collect():
        w = re.findall(ALNUM, (r.text or "").translate(ASCII))
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} - {()}
    clean = lambda t: not any(tuple(w[i : i + n]) in windows for w in [re.findall(ALNUM, t.translate(ASCII))] for n in {len(x) for x in windows} for i in range(len(w) - n + 1))
    assert {r.doc_id for r in p.decontamination(spark, left, sf).collect()} == {i for i, t in rows if i in want and clean(t)}
