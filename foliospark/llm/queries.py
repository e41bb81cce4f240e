"""The queries opN_<name> of this subpackage's operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ctw, dual_tree, exact_dedup, fim, imatch, license_rules, ordinal_toxicity, packing, poisson_mix, ri_quality, shingle_join, simhash_trie, url_cascade
from .common import fold, table

WS = r"[\x20\x09-\x0D]+"


def op1_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(table(spark, sf_dir, "documents"), fold("doc_id") == 1)


def op2_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, every source to the same share, one epoch."""
    return poisson_mix.mix(table(spark, sf_dir, "documents"))


def op3_ri_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ri_quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold("doc_id") == 0)


#: What op4 goes by, longest first.
URL_RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}


def op4_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list: urls that the rules block and urls with the very content of such a one. The cascade holds it against all urls."""
    pages = table(spark, sf_dir, "pages")
    listed = url_cascade.mirrored(pages, URL_RULES)
    return url_cascade.judge(pages.select("page_id", "url"), URL_RULES, listed).select("page_id", "host", "path", "rule", "verdict")


def op5_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_rules.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.mark(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    graded = ordinal_toxicity.grade(docs, ordinal_toxicity.train(docs, table(spark, sf_dir, "labels")))
    return graded.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "severity", "grade", "p_toxic", "toxic")


def op9_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.compare_with_next(table(spark, sf_dir, "documents"))


def op10_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_trie.mark(table(spark, sf_dir, "documents"))


def op11_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.mark(table(spark, sf_dir, "documents"))


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fim.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(fim.restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def op13_dual_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dual_tree.search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ctw": op1_ctw,
    "op2_poisson_mix": op2_poisson_mix,
    "op3_ri_quality": op3_ri_quality,
    "op4_url_cascade": op4_url_cascade,
    "op5_license_rules": op5_license_rules,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_packing": op7_packing,
    "op8_ordinal_toxicity": op8_ordinal_toxicity,
    "op9_imatch": op9_imatch,
    "op10_simhash_trie": op10_simhash_trie,
    "op11_shingle_join": op11_shingle_join,
    "op12_fim": op12_fim,
    "op13_dual_tree": op13_dual_tree,
}

ORACLE_SQL: dict[str, str] = {
    "op2_poisson_mix": """
WITH RECURSIVE by_source AS (SELECT source AS s, count(*) AS n FROM documents GROUP BY source),
r AS (SELECT s, 1.0 / (SELECT count(*) FROM by_source) * (SELECT count(*) FROM documents) / n AS rate FROM by_source),
steps(s, k, rate, p, cdf) AS (
  SELECT s, 0, rate, exp(-rate), exp(-rate) FROM r
  UNION ALL SELECT s, k + 1, rate, p * rate / (k + 1), cdf + p * rate / (k + 1) FROM steps WHERE k + 1 <= CAST(trunc(rate + 12 * sqrt(rate) + 30) AS INT)),
d AS (SELECT *, coalesce(CAST(doc_id AS VARCHAR), '') AS i0, md5(coalesce(text, '')) AS i1 FROM documents),
u AS (SELECT *, (CAST('0x' || substr(md5('42|' || i0 || '|' || i1), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0 AS u FROM d),
c AS (SELECT u.*, r.rate, (SELECT count(*) FROM steps t WHERE t.s IS NOT DISTINCT FROM u.source AND t.cdf < u.u) AS copies FROM u JOIN r ON u.source IS NOT DISTINCT FROM r.s)
SELECT doc_id, text, lang, source, n_chars, rate, CAST(copies AS INT) AS copies, CAST(i AS INT) AS copy, md5('order42|' || i0 || '|' || i1 || '|' || i) AS shuffle_key
FROM c, unnest(range(copies)) x(i)
""",
    "op4_url_cascade": r"""
WITH p AS (SELECT page_id, html, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
rules(rule, site, start, what) AS (VALUES ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'), ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')),
r AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(what, length(rule)) AS what FROM p JOIN rules ON (host = site OR ends_with(host, '.' || site)) AND starts_with(path, start) GROUP BY page_id),
j AS (SELECT p.*, rule, what FROM p LEFT JOIN r USING (page_id)),
listed AS (SELECT DISTINCT host || path AS key FROM j WHERE what = 'block' OR html IN (SELECT html FROM j WHERE what = 'block' AND html <> ''))
SELECT page_id, host, path, rule, coalesce(what, CASE WHEN host || path <> '' AND host || path IN (SELECT key FROM listed) THEN 'block' ELSE 'allow' END) AS verdict FROM j
""",
    "op6_exact_dedup": r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
""",
    "op11_shingle_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s),
t AS (SELECT doc_id, unnest(s) AS t FROM s),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM t a JOIN t b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= 80 * (x.n + y.n - k)),
steps AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT reach.a, steps.b FROM reach JOIN steps ON reach.b = steps.a)
SELECT doc_id, any_value(n) AS n_shingles, min(b) AS component_id FROM n JOIN reach ON doc_id = a GROUP BY doc_id
""",
    "op12_fim": r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || doc_id) AS h FROM documents),
h AS (SELECT *, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS c1, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS c2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM t),
f AS (SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
  array_to_string(u[1:least(c1, c2)], '') AS p, array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') AS m, array_to_string(u[greatest(c1, c2) + 1:], '') AS s FROM h)
SELECT doc_id, CAST(len(u) AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM f
""",
    "op13_dual_tree": r"""
WITH dt AS (SELECT doc_id, unnest(list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS t FROM documents),
it AS (SELECT DISTINCT item_id, unnest(list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS t FROM benchmark),
tf AS (SELECT doc_id, t, count(*) AS tf FROM dt GROUP BY ALL), n AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id), c AS (SELECT count(*) AS nd, sum(n)::BIGINT AS l FROM n),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t), wt AS (SELECT t, CAST(floor(1000 * ln((2 * nd + 2) / (2 * df + 1))) AS BIGINT) AS w FROM df, c), m AS (SELECT doc_id, 100 - 50 + (50 * n * nd) // l AS m FROM n, c),
sc AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score FROM it JOIN tf USING (t) JOIN wt USING (t) JOIN m USING (doc_id) GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM sc WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50
""",
}
