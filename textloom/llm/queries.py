"""The registered queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import table
from textloom.llm.countmin_dedup import dedup_substrings
from textloom.llm.decontaminate import contamination
from textloom.llm.html_extract import extract_text
from textloom.llm.jaccard_join import jaccard_join
from textloom.llm.language_id import address_parts, declared_language, identify, page_text, train
from textloom.llm.packing import pack
from textloom.llm.quality import quality_rules
from textloom.llm.suffix_dedup import dedup_suffixes
from textloom.llm.url_filter import filter_urls
from textloom.llm.warc import round_trip

#: The vocabulary file of the packing query.
TOKENIZER = "byte_bpe_50k.json"


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"), n=3, num=90, den=100)


OP1_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
g AS (SELECT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
  ELSE list_distinct(list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i:i + 2], ' '))) END) AS gram FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 90 * (x.n + y.n - shared)),
e AS (SELECT a AS u, b AS v FROM l UNION ALL SELECT b, a FROM l),
r AS (WITH RECURSIVE reach(s, t) AS (SELECT u, v FROM e UNION SELECT reach.s, e.v FROM reach JOIN e ON e.u = reach.t) SELECT s, min(t) AS least FROM reach GROUP BY s),
f AS (SELECT w.doc_id, min(least) AS least FROM w LEFT JOIN r ON r.s = w.doc_id GROUP BY w.doc_id),
k AS (SELECT u, count(*) AS n_links FROM e GROUP BY u),
c AS (SELECT doc_id, list_sort(list(gram)) AS grams FROM g GROUP BY doc_id),
d AS (SELECT grams, min(doc_id) AS class_id FROM c GROUP BY grams)
SELECT f.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(d.class_id, f.doc_id) AS class_id, coalesce(k.n_links, 0)::BIGINT AS n_links, least(f.doc_id, coalesce(f.least, f.doc_id)) AS component_id
FROM f LEFT JOIN n USING (doc_id) LEFT JOIN k ON k.u = f.doc_id LEFT JOIN c USING (doc_id) LEFT JOIN d USING (grams)
"""


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_suffixes(table(spark, sf_dir, "documents"), with_bytes=False).drop("spans", "kept")


OP2_SQL = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, i, b[i:i + 199] AS k FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 198)) AS i FROM d WHERE octet_length(b) >= 200)),
t AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
h AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS gap FROM w SEMI JOIN t USING (k)),
g AS (SELECT doc_id, i, sum(CASE WHEN gap <= 200 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM h),
r AS (SELECT doc_id, run, min(i) AS first, max(i) + 199 AS last FROM g GROUP BY doc_id, run),
x AS (SELECT doc_id, list(first ORDER BY first) AS firsts, list(last ORDER BY first) AS lasts, sum(last - first + 1) AS n_removed FROM r GROUP BY doc_id)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(len(firsts), 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN firsts IS NULL THEN hex(b) ELSE array_to_string(list_transform(range(0, len(firsts) + 1), lambda j: hex(b[CASE WHEN j = 0 THEN 1 ELSE lasts[j] + 1 END:CASE WHEN j = len(firsts) THEN octet_length(b) ELSE firsts[j + 1] - 1 END])), '') END)) AS kept_sha256
FROM d LEFT JOIN x USING (doc_id)
"""


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"))


# base 32 of 160 bits: four letters for each five hexadecimal digits
OP3_SQL = r"""
SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, array_to_string(list_transform(range(0, 8), lambda g:
    array_to_string(list_transform([15, 10, 5, 0], lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(sha1(coalesce(html, '')), 5 * g::INT + 1, 5))::INT >> k) & 31) + 1, 1)), '')), '') AS payload_digest,
  CASE WHEN page_id = largest THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> largest THEN largest END AS refers_to, url
FROM (SELECT *, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS largest FROM pages)
"""


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP4_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(words), 10) AS size, array_to_string(words[i:i + 9], ' ') AS win
  FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS i FROM b WHERE len(words) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT doc_id, size, i, array_to_string(words[i:i + size - 1], ' ') AS win
  FROM (SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS i FROM w, sizes WHERE len(words) >= size)),
o AS (SELECT doc_id, dw.size, i, item_id FROM dw JOIN bw USING (size, win)),
h AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS pos FROM o) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM o) GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents"), with_text=False).drop("kept_text")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents say their language in `lang`; their source is their host."""
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs), declared=F.col("lang"), host=F.col("source"))


def op7_language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by all their evidence: text, the html element's lang, host and address suffix. They have no
    labels; the model is fitted on the documents."""
    pages = table(spark, sf_dir, "pages").select("page_id", page_text(F.col("html")).alias("text"), declared_language(F.col("html")).alias("declared"), "url")
    host, suffix = address_parts(F.col("url"))
    return identify(pages, train(table(spark, sf_dir, "documents")), "page_id", declared=F.col("declared"), host=host, suffix=suffix)


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


OP8_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM w WHERE len(words) >= 13),
k AS (SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS key FROM s),
f AS (SELECT key, min(doc_id) AS first_doc FROM k GROUP BY key),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS pos FROM k JOIN f USING (key) WHERE first_doc < doc_id),
r AS (SELECT doc_id, list(pos) AS gone, count(*) AS n_removed FROM g GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
  sha256(array_to_string(list_filter(words, lambda x, i: gone IS NULL OR NOT list_contains(gone, i)), ' ')) AS kept_sha256
FROM w LEFT JOIN r USING (doc_id)
"""

#: Parts of queries that SQL can express as a whole.
PARTS = {
    "op6_url_filter_rules": (op6_url_filter, ("page_id", "host", "path", "rule"), r"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
s AS (SELECT *, '.' || host AS h FROM u)
SELECT page_id, host, path, CASE WHEN host = '' THEN NULL WHEN ends_with(h, '.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
  WHEN ends_with(h, '.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/' WHEN ends_with(h, '.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
  WHEN ends_with(h, '.com') AND starts_with(path, '/de/') THEN 'com/de/' WHEN ends_with(h, '.org') AND starts_with(path, '/') THEN 'org/' END AS rule
FROM s
"""),
    "op9_quality_rules_base": (op9_quality_rules, ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"), r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS k FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)),
c AS (SELECT doc_id, k FROM s GROUP BY doc_id, k HAVING count(*) > 1),
r AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS pos FROM s JOIN c USING (doc_id, k)) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM w)
SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(words) < 20 OR 100 * coalesce(n, 0) > 30 * len(words) AS base_failed
FROM w LEFT JOIN r USING (doc_id) JOIN l USING (doc_id)
"""),
}

QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_warc": op3_warc,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_packing": op5_packing,
    "op6_url_filter": op6_url_filter,
    "op7_language_id": op7_language_id,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_quality_rules": op9_quality_rules,
    "op10_html_extraction": op10_html_extraction,
}

#: Operators of QUERIES on a further table, and those columns of QUERIES that SQL can express.
MORE = {"op7_language_id_pages": op7_language_id_pages, **{k: lambda spark, sf_dir, make=make, columns=columns: make(spark, sf_dir).select(*columns) for k, (make, columns, _) in PARTS.items()}}

SQL = {
    "op1_ngram_jaccard_join": OP1_SQL,
    "op2_suffix_dedup": OP2_SQL,
    "op3_warc": OP3_SQL,
    "op4_benchmark_decontamination": OP4_SQL,
    "op8_substring_dedup": OP8_SQL,
    **{k: sql for k, (_, _, sql) in PARTS.items()},
}
