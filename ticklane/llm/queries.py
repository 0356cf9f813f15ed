"""The queries opN_* over whole tables, and DuckDB SQL for those whose rows SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticklane.llm import audit, chat, decontam, html_text, langid, licenses, lm, mixing, neardup, quality, spelling, tokens, toxicity
from ticklane.llm.common import remainder, table


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    messages = chat.as_chain(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added))
    formatted = chat.format_paths(chat.reply_paths(messages), messages)
    turns = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    sha = lambda text: F.sha2(F.encode(text, "UTF-8"), 256)
    back = formatted.withColumn("turns", chat.read_back(F.col("formatted"))).withColumn("loss", chat.under_mask(F.col("formatted"), F.col("loss_spans")))
    return back.select(
        F.col("path_id.conv_id").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), sha(F.array_join(turns, "")).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), sha(F.col("loss")).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(langid.learnable(documents))
    labelled = langid.label_languages(documents, model, keep=["doc_id"], with_spans=False)
    return labelled.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = mixing.sizes(table(spark, sf_dir, "documents"))
    return mixing.mix(sized, mixing.targets(sized)).select("doc_id", "size", "source_size", "target", "taken")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = lm.score_texts(documents, lm.learnable)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), k=2, percent=80).drop("content")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    field = quality.fit(documents, table(spark, sf_dir, "labels"))
    return quality.apply_rules(documents, field, keep=["doc_id"], with_lines=False).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share"
    )


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.find_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"] == "phrase")
    joined = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    return found.withColumn("base", base).select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda s: s["first_word"])).alias("first_word"), F.array_max(F.transform("base", lambda s: s["first_word"])).alias("last_word"),
        joined(F.col("base")).alias("base_labels"), joined(F.col("spans")).alias("labels"),
        F.least(F.coalesce(F.array_max(F.transform("spans", lambda s: s["coverage"])), F.lit(0.0)), F.lit(1.0)).alias("score"),
    )


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(documents, toxicity.learnable(table(spark, sf_dir, "labels")))
    scored = toxicity.score_toxicity(documents, model, keep=["doc_id"])
    return scored.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = audit.document_failures(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return audit.audit(rows, audit.FILTERS, ["good", "toxic"])


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = tokens.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), keep=["doc_id"])
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.vocabulary(table(spark, sf_dir, "documents").select("doc_id", "text")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_chat_formatting, op2_html_extraction, op3_language_id, op4_mixing, op5_lm_scoring, op6_near_dedup, op7_quality_rules, op8_license_scan,
        op9_decontamination, op10_toxicity, op11_filter_audit, op12_token_counts, op13_spelling_variants,
    )
}

_STUFF = r"""regexp_replace({0}, '([<\[])(=*)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|\|eot_id\|>|/?s>|/?INST\]|<SYS>>|</SYS>>)', '\1=\2\3', 'g')"""

ORACLE_SQL = {
    "op1_chat_formatting": f"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(12 + length({_STUFF.format("role")}) + 1 + length({_STUFF.format("text")}) + 11) AS BIGINT) AS formatted_chars
FROM given GROUP BY conv_id""",
    "op4_mixing": r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS BIGINT) AS size FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM sized GROUP BY source),
weighed AS (SELECT *, [5, 2, 1][rank % 3 + 1] AS weight, 2 * source_size AS most FROM sources),
asked AS (SELECT sum(source_size) * 150 / 100 AS total FROM weighed),
rounds AS (
  SELECT 0 AS n, list(struct_pack(r := rank, f := false)) AS state FROM weighed
  UNION ALL
  SELECT n + 1, (
    WITH now AS (SELECT w.*, s.f AS full_ FROM weighed w JOIN (SELECT unnest(state, recursive := true)) s ON s.r = w.rank),
    sums AS (SELECT coalesce(sum(most) FILTER (full_), 0) AS filled, coalesce(sum(weight) FILTER (NOT full_), 0) AS free FROM now)
    SELECT list(struct_pack(r := rank, f := full_ OR weight * CAST(total - filled AS DOUBLE) / CAST(greatest(free, 1) AS DOUBLE) > most)) FROM now, sums, asked)
  FROM rounds WHERE n < (SELECT count(*) FROM weighed)),
last AS (SELECT unnest(state, recursive := true) FROM rounds ORDER BY n DESC LIMIT (SELECT count(*) FROM weighed)),
now AS (SELECT w.*, f AS full_ FROM weighed w JOIN last ON r = rank),
sums AS (SELECT coalesce(sum(most) FILTER (full_), 0) AS filled, coalesce(sum(weight) FILTER (NOT full_), 0) AS free FROM now),
goals AS (SELECT source, source_size, CASE WHEN full_ THEN CAST(most AS DOUBLE) ELSE weight * CAST(total - filled AS DOUBLE) / CAST(greatest(free, 1) AS DOUBLE) END AS target FROM now, sums, asked),
placed AS (
  SELECT d.doc_id, d.size, g.source_size, g.target,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('mix:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), d.doc_id NULLS FIRST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size) ELSE 0 END AS epochs
  FROM sized d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size + least(greatest(floor(target) - epochs * source_size - before, 0), size) AS BIGINT) AS taken FROM placed""",
    # candidates by their least shingle sets: two sets this alike share one of the first 20 % + 1 shingles in hash order
    "op6_near_dedup": r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
cut AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 1 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM docs),
grams AS (SELECT DISTINCT doc_id, hash(g) AS g FROM cut),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
counts AS (SELECT g, count(*) AS seen FROM grams GROUP BY g),
ordered AS (SELECT doc_id, g, n, row_number() OVER (PARTITION BY doc_id ORDER BY seen, g) AS r FROM grams JOIN sizes USING (doc_id) JOIN counts USING (g)),
prefix AS (SELECT doc_id, g, n FROM ordered WHERE r <= n - ceil(0.8 * n) + 1),
pairs AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb FROM prefix a JOIN prefix b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
shared AS (SELECT a, b, any_value(na) AS na, any_value(nb) AS nb, count(*) AS k FROM pairs JOIN grams x ON x.doc_id = a JOIN grams y ON y.doc_id = b AND y.g = x.g GROUP BY a, b),
links AS (SELECT a, b FROM shared WHERE 100 * k >= 80 * (na + nb - k)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT doc_id AS a, doc_id AS b FROM docs UNION SELECT r.a, e.b FROM reached r JOIN both_ways e ON e.a = r.b),
least_reached AS (SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM docs LEFT JOIN sizes USING (doc_id) JOIN least_reached USING (doc_id)""",
    "op9_decontamination": r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
items AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
windows AS (SELECT DISTINCT item, len(list_slice(w, i, i + 9)) AS n, array_to_string(list_slice(w, i, i + 9), ' ') AS phrase
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
cut AS (SELECT rid, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS phrase FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, sizes WHERE len(w) >= n)),
hits AS (SELECT rid, i, c.n, item FROM cut c JOIN windows USING (n, phrase)),
hit_words AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hits) GROUP BY rid),
hit_items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit_words USING (rid) LEFT JOIN hit_items USING (rid)""",
    # every order is walked over the failure patterns, step by step
    "op11_filter_audit": r"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
marks AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
failing AS (
  SELECT part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 2 * length(t),
    regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS fails, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM texts LEFT JOIN marks USING (doc_id)),
patterns AS (SELECT part, fails, good, toxic, count(*) AS n, len(list_filter(fails, lambda f: f)) AS k FROM failing GROUP BY ALL),
letters AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
orders AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
walked AS (
  SELECT part, array_to_string(list_transform(o, lambda i: substr('ABCDE', i, 1)), '') AS filter_order, s AS step, o[s] AS f,
    fails[o[s]] AS bad, len(list_filter(o[1:s - 1], lambda i: fails[i])) > 0 AS gone, k, n, good, toxic
  FROM patterns, orders, range(1, 6) steps(s)),
summed AS (
  SELECT part, filter_order, CAST(step AS INT) AS step, f, coalesce(sum(n) FILTER (NOT bad AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (bad AND NOT gone), 0) AS removed,
    coalesce(sum(n) FILTER (bad AND gone), 0) AS redundant, coalesce(sum(n) FILTER (bad AND k = 1), 0) AS unique_fails,
    coalesce(sum(n) FILTER (bad AND NOT gone AND good = 1), 0) AS good_lost, coalesce(sum(n) FILTER (bad AND NOT gone AND toxic = 1), 0) AS toxic_lost
  FROM walked GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM summed""",
    # crc32 by its table of 256 remainders; words and the pairs of near words as they are, by joins on what a wildcard or a deletion leaves
    "op13_spelling_variants": r"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY b) AS t
  FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS b)),
runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS k
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents) WHERE length(run) >= 7 GROUP BY ALL),
coded AS (SELECT run, k, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM runs),
hashed AS (
  SELECT run, k, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]))) AS h FROM coded, crc),
made AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM hashed),
vocabulary AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM made WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocabulary),
wild AS (SELECT word, n, i, substr(word, 1, i - 1) AS before, substr(word, i + 1) AS after FROM places),
pairs AS (
  SELECT a.word AS one, b.word AS other, b.n AS m FROM wild a JOIN wild b ON a.i = b.i AND a.before = b.before AND a.after = b.after AND a.word <> b.word
  UNION SELECT w.word, v.word, v.n FROM wild w JOIN vocabulary v ON v.word = w.before || w.after
  UNION SELECT v.word, w.word, w.n FROM wild w JOIN vocabulary v ON v.word = w.before || w.after),
best AS (SELECT one, count(*) AS n_near, min(struct_pack(m := -m, w := other)) AS b FROM pairs GROUP BY one),
formed AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.m >= 10 * n THEN b.w END AS form, CASE WHEN -b.m >= 10 * n THEN -b.m END AS form_n FROM vocabulary LEFT JOIN best ON one = word),
followed AS (
  SELECT word, form AS last, 1 AS step FROM formed WHERE form IS NOT NULL
  UNION ALL SELECT f.word, n.form, step + 1 FROM followed f JOIN formed n ON n.word = f.last WHERE n.form IS NOT NULL),
ends AS (SELECT word, arg_max(last, step) AS root FROM followed GROUP BY word)
SELECT word, form, coalesce(root, word) AS root, n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n FROM formed LEFT JOIN ends USING (word)""",
}
