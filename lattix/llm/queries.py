"""Queries of the training-data operators over whole tables, and SQL that says the same where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from lattix.llm import language_mix, line_dedup, ngram_join, periodic_runs, perplexity_rules, pfair_mix, phrase_index, pii_boosting, prefix_trie, simhash_dedup, subword_classifier, url_filter, warc

QUERIES = {}
ORACLES: dict[str, str] = {}

URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_components(table(spark, sf_dir, "documents"), n=5, num=4, den=5, count_links=True)


@query
def op2_perplexity_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity_rules.judge(table(spark, sf_dir, "documents"))


@query
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


@query
def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subword_classifier.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


@query
def op6_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


@query
def op7_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfair_mix.mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source"))


@query
def op8_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = language_mix.held_out("doc_id", 5, 0)
    model = language_mix.train(docs.where(~out))
    return language_mix.language_proportions(docs, model).select("doc_id", out.alias("held_out"), "lang_pred", "score")


@query
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_index.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_boosting.digest(pii_boosting.find_personal_data(table(spark, sf_dir, "documents")))


@query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, conversations = prefix_trie.branched(table(spark, sf_dir, "conversations"), 100, F.expr("crc32(cast(conv_id AS string)) % 6"))
    return prefix_trie.trie(turns, conversations)


def with_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every tenth document, by the CRC of its id, repeats a stretch of its words up to its end; other texts, and those without a word or an id, stay."""
    one = docs.select("doc_id", "text", F.expr("crc32(cast(doc_id AS string))").alias("h"))
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    one = one.withColumn("w", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.size("w")).withColumn("g", F.floor(F.col("h") / 10))
    one = one.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    one = one.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    turned = F.expr("array_join(concat(slice(w, 1, a), transform(sequence(0, n - a - 1), k -> w[a + k % p])), ' ')")
    return one.select("doc_id", F.when(F.col("a").isNotNull(), turned).otherwise(F.col("text")).alias("text"))


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(with_periods(table(spark, sf_dir, "documents")))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r.length).alias("shorter"), r.start.alias("start"), r.period.alias("period"))))
    found = found.withColumn("best", F.when(F.size("runs") > 0, best)).withColumn("longest", -F.col("best.shorter"))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(r.start, F.lit(","), r.length, F.lit(","), r.period, F.lit("\n"))))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", F.col("longest").alias("length"), "best.period", F.expr("1000 * longest div best.period").alias("exponent_milli"),
                        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query
def op13_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = simhash_dedup.near_components(table(spark, sf_dir, "documents"))
    return near.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


#: Prefixes as JSON text; a node's subtree are those of which it is a prefix. The CRC goes bit by bit.
ORACLES["op11_prefix_trie"] = r"""
WITH b AS (SELECT conv_id AS c, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS w FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
h AS (SELECT c, w, CAST(xor(list_reduce(list_concat([4294967295::BIGINT], [CAST(ord(x) AS BIGINT) FOR x IN string_split(CAST(c AS VARCHAR), '')]),
       lambda a, x: list_reduce([xor(a, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) % 6 AS INTEGER) AS h FROM b),
built AS (SELECT h.c, CASE WHEN s.w IS NULL THEN h.w[h + 1:] ELSE list_concat(s.w[1:h], h.w[h + 1:]) END AS w FROM h LEFT JOIN b s ON s.c = h.c - h.c % 100),
p AS (SELECT c, d, len(w) AS n, CAST(to_json(w[1:d]) AS VARCHAR) AS k, coalesce(length(w[d].t), 0) AS size FROM (SELECT c, w, unnest(range(0, len(w) + 1)) AS d FROM built)),
node AS (SELECT d, k, min(c) AS c, count(*) AS n_convs, max(size) AS size, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (n = d), '')) AS ends FROM p GROUP BY d, k),
above AS (SELECT x.d, x.k, q.d AS up_d, q.k AS up_k FROM node x JOIN p q ON q.c = x.c AND q.d = x.d - 1),
kid AS (SELECT up_d AS d, up_k AS k, count(*) AS n FROM above GROUP BY ALL),
own AS (SELECT node.*, coalesce(n, 0) AS n_children FROM node LEFT JOIN kid USING (d, k)),
sub AS (SELECT q.d, q.k, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * x.size) AS saved FROM own x JOIN p q ON q.c = x.c AND q.d <= x.d GROUP BY ALL)
SELECT own.c AS conv_id, own.d AS depth, y.c AS parent_conv_id, own.n_convs, own.n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, own.ends AS ends_sha256
FROM own JOIN sub USING (d, k) LEFT JOIN above a ON a.d = own.d AND a.k = own.k LEFT JOIN node y ON y.d = a.up_d AND y.k = a.up_k
"""

#: Words, windows and their occurrences, compared as text.
ORACLES["op9_decontamination"] = r"""
WITH upper AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS u, 'abcdefghijklmnopqrstuvwxyz' AS l),
d AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents, upper),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark, upper),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT dw.r, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""

#: Shingles as text, pairs by their common shingles, components by reachability.
ORACLES["op1_ngram_jaccard_join"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT a AS v, a AS r FROM both_ways UNION SELECT e.b, reach.r FROM reach JOIN both_ways e ON e.a = reach.v)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, CAST(least(d.doc_id, coalesce(m.r, d.doc_id)) AS BIGINT) AS component_id,
       CAST(coalesce(k.n_links, 0) AS BIGINT) AS n_links
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a, count(*) AS n_links FROM both_ways GROUP BY a) k ON k.a = d.doc_id LEFT JOIN (SELECT v, min(r) AS r FROM reach GROUP BY v) m ON m.v = d.doc_id
"""

#: Base32 takes 5 bits at a time of each 40-bit part of the digest.
ORACLES["op6_warc_round_trip"] = r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(p.h, 10 * (k // 8) + 1, 10) AS BIGINT) >> (35 - 5 * (k % 8))) & 31 AS INTEGER), 1) FOR k IN range(32)], '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f ON p.h = f.h
"""

#: A page without a rule looks at all pages that links join it to.
ORACLES["op3_url_filter"] = r"""
WITH RECURSIVE rules AS (SELECT * FROM (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')) x(action, h, p)),
u AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
tags AS (SELECT url, list_filter(regexp_extract_all(html, '(?i)<link\b[^>]*>'), lambda x: regexp_matches(x, '(?i)\brel\s*=\s*["'']?canonical\b'))[1] AS tag, '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)' AS pat FROM u WHERE contains(url, '://')
  UNION ALL SELECT url, list_filter(regexp_extract_all(html, '(?i)<meta\b[^>]*>'), lambda x: regexp_matches(x, '(?i)\bhttp-equiv\s*=\s*["'']?refresh\b'))[1], '(?i)\burl\s*=\s*["'']?([^"''\s>]+)' FROM u WHERE contains(url, '://')),
t AS (SELECT url, replace(CASE WHEN pat LIKE '%href%' THEN regexp_extract(tag, '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) ELSE regexp_extract(tag, '(?i)\burl\s*=\s*["'']?([^"''\s>]+)', 1) END, '&amp;', '&') AS target FROM tags WHERE tag IS NOT NULL),
full_url AS (SELECT url, CASE WHEN contains(target, '://') THEN target WHEN target LIKE '//%' THEN regexp_extract(url, '(?s)^(.*?)://', 1) || ':' || target WHEN target LIKE '/%' THEN regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || target
  ELSE regexp_replace(regexp_extract(url, '(?s)^(.*?://[^/?#]*(?:[^?#]*/)?)', 1), '/?$', '/') || target END AS target FROM t WHERE target <> ''),
split AS (SELECT url, regexp_extract(url, '(?s)^.*?://([^#]*)', 1) AS rest FROM (SELECT url FROM u WHERE contains(url, '://') UNION SELECT target FROM full_url WHERE contains(target, '://'))),
node AS (SELECT url, translate(regexp_extract(rest, '^([^/?]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(rest, '(?s)^[^/?]*(.*)', 1) AS node FROM split),
e AS (SELECT a.node AS a, b.node AS b FROM full_url f JOIN node a ON a.url = f.url JOIN node b ON b.url = f.target WHERE a.node <> b.node),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT a AS v, b AS w FROM both_ways UNION SELECT r.v, x.b FROM reach r JOIN both_ways x ON x.a = r.w),
parts AS (SELECT DISTINCT k, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT url AS k, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM u UNION ALL SELECT w, w FROM reach)),
ruled AS (SELECT k, host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(action, length(h || p)) AS action FROM parts LEFT JOIN rules ON (host = h OR host LIKE '%.' || h) AND starts_with(path, p) GROUP BY ALL),
spread AS (SELECT v FROM reach JOIN ruled ON k = w GROUP BY v HAVING bool_or(coalesce(action, '') = 'block') AND NOT bool_or(coalesce(action, '') = 'allow'))
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN node IN (SELECT v FROM spread) THEN 'block' ELSE 'allow' END) AS verdict, rule IS NULL AND coalesce(node IN (SELECT v FROM spread), false) AS by_alias
FROM u JOIN ruled ON k = u.url LEFT JOIN node ON node.url = u.url
"""

#: Lines with a word go if equal; lines of 5 characters or more also within one edit, and then agree on the first or the last half of the shorter one.
ORACLES["op5_line_dedup"] = r"""
WITH own AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
l AS (SELECT r, doc_id, i - 1 AS line_no, lines[i] AS line FROM (SELECT r, doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM own)),
d AS (SELECT line, min(CAST(doc_id AS HUGEINT) * 10000000000 + line_no) AS place FROM l WHERE length(line) >= 5 OR regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY line),
e AS (SELECT line, place, unnest([length(line), length(line) - 1]) AS m FROM d WHERE length(line) >= 5),
pairs AS (SELECT a.line AS a, b.line AS b, b.place FROM e a JOIN e b ON a.m = b.m AND left(a.line, a.m // 2) = left(b.line, b.m // 2) AND greatest(length(a.line), length(b.line)) - a.m <= 1 AND a.line <> b.line
  UNION SELECT a.line, b.line, b.place FROM e a JOIN e b ON a.m = b.m AND right(a.line, a.m // 2) = right(b.line, b.m // 2) AND a.line <> b.line),
near AS (SELECT a AS line, min(place) AS place FROM pairs WHERE CASE length(a) - length(b)
    WHEN 0 THEN list_contains([left(a, i - 1) = left(b, i - 1) AND substr(a, i + 1) = substr(b, i + 1) FOR i IN range(1, length(a) + 1)], true)
    WHEN 1 THEN list_contains([left(a, i - 1) || substr(a, i + 1) FOR i IN range(1, length(a) + 1)], b)
    ELSE list_contains([left(b, i - 1) || substr(b, i + 1) FOR i IN range(1, length(b) + 1)], a) END GROUP BY 1),
first AS (SELECT d.line, least(d.place, coalesce(n.place, d.place)) AS place FROM d LEFT JOIN near n ON n.line = d.line),
fate AS (SELECT l.r, l.line_no, l.line, f.line IS NOT NULL AND CAST(doc_id AS HUGEINT) * 10000000000 + line_no > f.place AS gone FROM l LEFT JOIN first f ON f.line = l.line),
kept AS (SELECT r, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_removed, sha256(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT gone), '')) AS text_sha256 FROM fate GROUP BY r)
SELECT doc_id, n_lines, n_removed, text_sha256 FROM own JOIN kept USING (r) UNION ALL SELECT doc_id, 0, 0, NULL FROM documents WHERE text IS NULL
"""
