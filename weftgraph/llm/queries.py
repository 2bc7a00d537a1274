"""The corpus queries: thin views of the operators over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table, workspace

URL_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Pages whose id this divides stand for a published list of blocked addresses.
LISTED_EVERY = 50


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_store import verify, write_store

    path = workspace(spark, "token-store")
    write_store(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return verify(spark, path)


def op2_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ordinal import grade_of, score, train

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels.select("doc_id", grade_of(F.col("quality"), F.col("toxic")).alias("grade")), 3)
    return score(docs, model).withColumn("kept", F.col("p_best") >= 0.5)


def op3_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repetition import repetition

    return repetition(table(spark, sf_dir, "documents"))


def op4_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .surrogates import anonymize

    return anonymize(table(spark, sf_dir, "documents"))


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import PASSAGE, remove

    found = remove(table(spark, sf_dir, "documents"), digest=True, words=PASSAGE)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.lower(F.hex("kept")).alias("kept_sha256"), "n_passage_words")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan, train

    docs = table(spark, sf_dir, "documents")
    return scan(docs, train(docs))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import scan

    found = scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    sha = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", sha.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mixture

    return mixture(table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import join

    return join(table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import filter_urls

    pages = table(spark, sf_dir, "pages")
    listed = pages.where(F.col("page_id") % LISTED_EVERY == 0).select("url")
    return filter_urls(pages, listed, URL_RULES)


def _url_sql() -> str:
    rule_rows = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)
    return f"""
WITH a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, coalesce(rest, '') AS rest, regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1) AS raw FROM a),
c AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, substr(rest, length(raw) + 1) AS after FROM b),
d AS (SELECT page_id, host, regexp_extract(after, '^([^?#]*)', 1) AS path, regexp_extract(after, '^[^?#]*\\?([^#]*)', 1) AS query FROM c),
e AS (SELECT *, list_sort(list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)='))) AS kept FROM d),
f AS (SELECT page_id, host, path, CASE WHEN host <> '' THEN regexp_replace(host, '^(www|m)\\.', '') || regexp_replace(path, '(/index\\.html?|\\.html?|/)+$', '')
      || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS canon FROM e),
rules(verdict, h, p) AS (VALUES {rule_rows}),
r AS (SELECT page_id, first(h || p ORDER BY length(h || p) DESC, length(h) DESC, h || p DESC) AS rule, first(verdict ORDER BY length(h || p) DESC, length(h) DESC, h || p DESC) AS verdict
      FROM (SELECT DISTINCT page_id, host, path FROM f) JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id),
listed AS (SELECT DISTINCT canon FROM f WHERE page_id % {LISTED_EVERY} = 0 AND canon IS NOT NULL)
SELECT f.page_id, f.host, f.path, r.rule, coalesce(r.verdict, CASE WHEN listed.canon IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM f LEFT JOIN r USING (page_id) LEFT JOIN listed ON f.canon = listed.canon
"""


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

DECONTAMINATE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w), 10) AS m, array_to_string(w[p : p + 9], ' ') AS x FROM i, generate_series(1, greatest(1, len(w) - 9)) t(p) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT m FROM win),
own AS (SELECT k, p, m, array_to_string(w[p : p + m - 1], ' ') AS x FROM d, sizes, generate_series(1, len(w) - m + 1) t(p)),
hit AS (SELECT DISTINCT k, p, own.m, item FROM own JOIN win ON own.m = win.m AND own.x = win.x),
n AS (SELECT k, count(DISTINCT q) AS n_hit FROM hit, generate_series(p, p + m - 1) t(q) GROUP BY k),
items AS (SELECT k, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS sha FROM (SELECT DISTINCT k, item FROM hit) GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (k) LEFT JOIN items USING (k)
"""

JACCARD_SQL = """
WITH RECURSIVE d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT k, md5_number(array_to_string(w[p : p + 4], ' ')) AS h FROM d, generate_series(1, greatest(1, len(w) - 4)) t(p) WHERE len(w) > 0),
n AS (SELECT k, count(*) AS n FROM s GROUP BY k),
common AS (SELECT a.k AS a, b.k AS b, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.k <> b.k GROUP BY 1, 2),
link AS (SELECT a, b FROM common JOIN n x ON x.k = a JOIN n y ON y.k = b WHERE 9 * c >= 4 * (x.n + y.n)),
reach AS (SELECT k, k AS m FROM d UNION SELECT reach.k, b FROM reach JOIN link ON a = m),
lead AS (SELECT reach.k, min(doc_id) AS class_id FROM reach JOIN d ON d.k = m GROUP BY reach.k)
SELECT doc_id, class_id, (SELECT count(*) FROM link WHERE a = d.k) AS n_links, coalesce(n, 0)::BIGINT AS n_shingles FROM d JOIN lead USING (k) LEFT JOIN n USING (k)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_store, op2_ordinal_quality, op3_repetition, op4_surrogates, op5_repeats, op6_licenses, op7_decontaminate, op8_mixing, op9_jaccard_join, op10_url_filter)}


def oracle_sql() -> dict[str, Any]:
    return {"op7_decontaminate": DECONTAMINATE_SQL, "op9_jaccard_join": JACCARD_SQL, "op10_url_filter": _url_sql()}
