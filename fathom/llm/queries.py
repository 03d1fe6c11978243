"""One query per operator, over whole tables, and SQL where it can say it.

The operators keep general interfaces; each query here applies one with
production parameters and derives its digest columns from the output.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm import (decontamination, filter_audit, html_extract, language_id, license_scan, line_dedup, lm_scoring,
                        mtree, packing, sharding, simhash, url_filter, variant_groups)
from fathom.session import read_table

TOKENIZER_FILE = "word_bpe_49k.json"
SEQUENCE_TOKENS = 2048
SHARDS = 8

# The url rules.
URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tokenizer_path() -> str:
    """The vocabulary file: FATHOM_TOKENIZERS names its folder, otherwise the
    installed package of public tokenizers knows it."""
    if folder := os.environ.get("FATHOM_TOKENIZERS"):
        return os.path.join(folder, TOKENIZER_FILE)
    import public_tokenizers

    return str(public_tokenizers.path(TOKENIZER_FILE))


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn
    return add


@query()
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_documents(read_table(spark, sf_dir, "documents")).drop("matches")


@query()
def op2_pack_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), tokenizer_path(), SEQUENCE_TOKENS)


def _is_held_out(modulus: int, remainder: int):
    return F.coalesce(language_id.crc_mod("doc_id", modulus) == remainder, F.lit(False))


@query()
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", _is_held_out(3, 1))
    model = language_id.fit(docs.where(~F.col("held_out")))
    return language_id.predict(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score", "rejected")


_FOUND = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""


@query(_FOUND)
def op4_mtree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id % 100 = 0", k=10)


@query()
def op5_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read_table(spark, sf_dir, "documents").select("doc_id", "text"), SHARDS)


_LINES = """
WITH page_texts AS (SELECT DISTINCT source, text FROM documents WHERE text IS NOT NULL),
lines AS (
  SELECT source, unnest(list_distinct(list_transform(string_split(text, chr(10)), lambda x: trim(x)))) AS line FROM page_texts),
totals AS (SELECT source, count(*) AS total FROM page_texts GROUP BY source),
bad AS (
  SELECT l.source, line FROM lines l JOIN totals t ON l.source IS NOT DISTINCT FROM t.source
  WHERE line <> '' GROUP BY l.source, line HAVING count(*) >= 5 AND count(*) > CAST(any_value(total) AS DOUBLE) * CAST(0.05 AS DOUBLE)),
drops AS (SELECT source, list(line) AS gone FROM bad GROUP BY source),
cut AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS every,
         list_filter(string_split(text, chr(10)), lambda x: gone IS NULL OR NOT list_contains(gone, trim(x))) AS kept
  FROM documents d LEFT JOIN drops ON d.source IS NOT DISTINCT FROM drops.source)
SELECT doc_id, CASE WHEN text IS NOT NULL THEN array_to_string(kept, chr(10)) END AS text,
       CAST(coalesce(len(every), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(every) - len(kept), 0) AS BIGINT) AS n_dropped
FROM cut
"""


@query(_LINES)
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup.drop_boilerplate(docs).select("doc_id", "text", "n_lines", "n_dropped")


@query()
def op7_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs, words=3, max_bits=2).select("doc_id", "fingerprint", "component_id")


_URLS = """
WITH parts AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
rules(rule_host, rule_path, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fits AS (
  SELECT page_id, rule_host || rule_path AS rule, verdict FROM split JOIN rules
  ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC) = 1)
SELECT s.page_id, host, path, f.rule, coalesce(f.verdict, 'allow') AS verdict FROM split s LEFT JOIN fits f USING (page_id)
"""


@query(_URLS)
def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    return url_filter.judge_urls(read_table(spark, sf_dir, "pages").select("page_id", "url"), rules)


@query()
def op9_lm_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm_scoring.score_documents(docs, _is_held_out(7, 2))


_LEAKS = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS words
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
places AS (
  SELECT doc_id, size, pos, array_to_string(list_slice(w, pos, pos + size - 1), ' ') AS words
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS pos FROM d, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size)),
hits AS (SELECT doc_id, item_id, pos, places.size FROM places JOIN windows USING (words, size)),
hit_words AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + size)) AS word FROM hits) GROUP BY doc_id),
hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""


@query(_LEAKS)
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, tests = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    return decontamination.contamination_report(docs, tests).drop("spans", "longest_match", "longest_at")


_VARIANTS = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(CAST(b AS BIGINT), CAST(range(8) AS BIGINT[])),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(CAST(3988292384 AS BIGINT), c >> 1) ELSE c >> 1 END)) AS step),
runs AS (
  SELECT id, run, count(*) AS n FROM (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
           unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run
    FROM documents) WHERE length(run) >= 7 GROUP BY ALL),
bytes AS (
  SELECT run, n, flatten(list_transform(string_split(id || ':' || run, ''),
    lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [CAST(195 AS BIGINT), CAST(unicode(c) - 64 AS BIGINT)] END)) AS b FROM runs),
hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda c, x: xor(c >> 8, step[(xor(c, x) & 255) + 1]))) AS h
  FROM bytes, crc),
cut AS (SELECT CASE WHEN h % 31 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM hashed),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
skips AS (
  SELECT word, n, word[:i - 1] AS a, word[i + 1:] AS b FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
near AS (
  SELECT x.word, y.word AS other, y.n FROM skips x JOIN skips y ON x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT s.word, v.word, v.n FROM skips s JOIN v ON v.word = s.a || s.b
  UNION SELECT v.word, s.word, s.n FROM skips s JOIN v ON v.word = s.a || s.b),
best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, encode(other)) AS form, max(n) AS form_n FROM near GROUP BY word),
found AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * v.n THEN form END AS form, CASE WHEN form_n >= 10 * v.n THEN form_n END AS form_n
  FROM v LEFT JOIN best USING (word)),
chain AS (
  SELECT word, word AS root FROM found
  UNION ALL SELECT c.word, f.form FROM chain c JOIN found f ON f.word = c.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, CAST(f.form_n AS BIGINT) AS form_n
FROM found f JOIN chain c USING (word) JOIN found e ON e.word = c.root WHERE e.form IS NULL
"""


@query(_VARIANTS)
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variant_groups.group_variants(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


_AUDIT = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
marks AS (SELECT doc_id, bool_or(quality = 1) AS q, bool_or(toxic = 1) AS t FROM labels GROUP BY doc_id),
counted AS (
  SELECT doc_id, part, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS capitals,
         coalesce(min(doc_id) OVER (PARTITION BY text) < doc_id, false) AS is_copy FROM d),
failed AS (
  SELECT doc_id, part, [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * capitals > 10 * length(text),
                        regexp_matches(text, '[#$%&*|]'), is_copy] AS f FROM counted),
cells AS (
  SELECT part, f, count(*) AS n, count(*) FILTER (WHERE q) AS good, count(*) FILTER (WHERE t) AS toxic
  FROM failed LEFT JOIN marks USING (doc_id) GROUP BY ALL),
letters(l) AS (VALUES (1), (2), (3), (4), (5)),
orders AS (
  SELECT [a.l, b.l, c.l, d.l, e.l] AS o FROM letters a JOIN letters b ON b.l <> a.l JOIN letters c ON c.l NOT IN (a.l, b.l)
  JOIN letters d ON d.l NOT IN (a.l, b.l, c.l) JOIN letters e ON e.l NOT IN (a.l, b.l, c.l, d.l)),
steps AS (SELECT o, unnest(range(1, 6)) AS step FROM orders),
every AS (
  SELECT part, o, step, n, good, toxic, f[o[step]] AS here, len(list_filter(o[:step - 1], lambda x: f[x])) > 0 AS gone,
         len(list_filter(f, lambda x: x)) AS failures FROM cells, steps),
sums AS (
  SELECT part, o, step, sum(n) FILTER (WHERE NOT here AND NOT gone) AS kept, sum(n) FILTER (WHERE here AND NOT gone) AS removed,
         sum(n) FILTER (WHERE here AND gone) AS redundant, sum(n) FILTER (WHERE here AND failures = 1) AS unique_fails,
         sum(good) FILTER (WHERE here AND NOT gone) AS good_lost, sum(toxic) FILTER (WHERE here AND NOT gone) AS toxic_lost
  FROM every GROUP BY part, o, step),
whole AS (SELECT *, sum(removed) OVER (PARTITION BY part, o[step]) AS shapley FROM sums)
SELECT part, array_to_string(list_transform(o, lambda x: substr('ABCDE', x, 1)), '') AS filter_order, CAST(step AS INTEGER) AS step,
       CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
       CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost,
       CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost, CAST(coalesce(shapley, 0) AS BIGINT) AS shapley
FROM whole
"""


@query(_AUDIT)
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return filter_audit.audit(docs, read_table(spark, sf_dir, "labels"))


# The pages of these tables have one article each; blocks are its h1 and p.
_MAIN_TEXT = r"""
WITH a AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS body FROM pages),
b AS (
  SELECT page_id, url, list_transform(regexp_split_to_array(body, '</?(?:p|h1)>'), lambda x: trim(regexp_replace(regexp_replace(
    replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&#39;', chr(39)),
    '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS blocks FROM a),
c AS (SELECT page_id, url, coalesce(array_to_string(list_filter(blocks, lambda x: x <> ''), chr(10) || chr(10)), '') AS text FROM b)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM c
"""


@query(_MAIN_TEXT)
def op13_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read_table(spark, sf_dir, "pages")).drop("path")
