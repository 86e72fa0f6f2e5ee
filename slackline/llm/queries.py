"""Registered queries of the operators, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jaccard_join, langid, license_scan, mixing, packing, pstable, quality, url_filter, warc

URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [url_filter.UrlRule.parse(*r) for r in URL_RULES]
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules, keep=["page_id"])


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pstable.near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.9)


#: Target weights of the domains of the labels table.
DOMAIN_TARGETS = {"good": 0.97, "low": 0.02, "toxic": 0.01}


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = mixing.quality_domains(table(spark, sf_dir, "labels"))
    return mixing.mix(table(spark, sf_dir, "documents"), labelled, DOMAIN_TARGETS)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), capacity=2048, with_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_classes(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.archive_round_trip(table(spark, sf_dir, "pages"), least_bytes=0)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = langid.identify(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents")).drop("matches")


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return pstable.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


OPERATORS = (
    op1_url_filter,
    op2_embedding_near_dedup,
    op3_source_mixing,
    op4_best_fit_packing,
    op5_ngram_jaccard_join,
    op6_warc,
    op7_language_id,
    op8_quality_classifier,
    op9_license_scan,
    op10_nearest_neighbours,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


_URL_PARTS = """
SELECT page_id,
       translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
       regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*', 0)) + 1), '^[^?#]*', 0) AS path
FROM (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)
"""


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_JACCARD = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS x FROM documents),
sh AS (SELECT DISTINCT doc_id, CASE WHEN len(x) < 5 THEN array_to_string(x, ' ') ELSE array_to_string(x[i:i + 4], ' ') END AS g FROM (SELECT doc_id, x, unnest(generate_series(1, greatest(len(x) - 4, 1))) AS i FROM w WHERE len(x) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS s, doc_id AS t FROM w UNION SELECT r.s, e.b FROM r JOIN e ON r.t = e.a)
SELECT w.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.t) AS component_id FROM w JOIN r ON r.s = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id GROUP BY w.doc_id"""


def _licences() -> str:
    labels, known = license_scan.clauses()
    rows = ", ".join(f"({i}, {c.notice}, '{labels[c.notice]}', {c.base}, {k}, '{w}', {int(k in c.key)}, {len(c.key)}, {c.need})" for i, c in enumerate(known) for k, w in enumerate(c.words))
    total = ", ".join(f"({g}, {sum(len(c.words) for c in known if c.notice == g)})" for g in range(len(labels)))
    return rf"""
WITH t(clause, notice, label, base, pos, word, key, n_key, need) AS (VALUES {rows}), size(notice, total) AS (VALUES {total}),
x AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS x FROM documents),
w AS (SELECT doc_id, unnest(x) AS word, generate_subscripts(x, 1) - 1 AS place FROM x),
m AS (SELECT doc_id, clause, notice, label, base, n_key, place - pos AS s, count(*) AS k FROM w JOIN t USING (word) GROUP BY doc_id, clause, notice, label, base, n_key, need, place - pos HAVING count(*) >= need AND sum(key) = n_key),
b AS (SELECT doc_id, count(*) AS n, min(s) AS lo, max(s) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM m WHERE base GROUP BY 1),
g AS (SELECT doc_id, notice, label, sum(k) AS k FROM (SELECT doc_id, notice, label, clause, max(n_key) AS n_key, max(k) AS k FROM m GROUP BY ALL) GROUP BY 1, 2, 3 HAVING max(n_key) > 0),
a AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(k / total::DOUBLE) AS score FROM g JOIN size USING (notice) GROUP BY 1)
SELECT x.doc_id, len(x.x)::BIGINT AS n_words, coalesce(b.n, 0)::BIGINT AS n_base, b.lo::BIGINT AS first_word, b.hi::BIGINT AS last_word, coalesce(b.labels, '') AS base_labels, coalesce(a.labels, '') AS labels, coalesce(a.score, 0.0) AS score
FROM x LEFT JOIN b USING (doc_id) LEFT JOIN a USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for h, p, v in (lambda r: [(t.partition("/")[0], "/" + t.partition("/")[2], v) for t, v in r])(URL_RULES)]
    fits.sort(key=lambda x: -len(x[1]))
    case = lambda k: " ".join(f"WHEN {x[0]} THEN '{x[k]}'" for x in fits)
    return {
        "op1_url_filter": f"SELECT page_id, host, path, CASE {case(1)} END AS rule, CASE {case(2)} ELSE 'allow' END AS verdict FROM ({_URL_PARTS})",
        "op2_embedding_near_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
good AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS n FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.9),
reach AS (SELECT vec_id AS s, vec_id AS t FROM v UNION SELECT r.s, l.b FROM reach r JOIN links l ON r.t = l.a)
SELECT v.vec_id, coalesce(max(c.n), 0)::BIGINT AS n_links, min(r.t) AS component_id, v.vec_id = min(r.t) AS kept
FROM v JOIN reach r ON r.s = v.vec_id LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) c ON c.a = v.vec_id
GROUP BY v.vec_id""",
        "op5_ngram_jaccard_join": _JACCARD,
        "op9_license_scan": _licences(),
        "op6_warc": """
SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes,
       array_to_string(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', list_reduce(list_transform(generate_series(0, 4), lambda k: (CASE WHEN (strpos('0123456789abcdef', d[((i * 5 + k) // 4) + 1]) - 1) & (8 >> ((i * 5 + k) % 4)) > 0 THEN 1 ELSE 0 END)::INTEGER), lambda x, y: x * 2 + y) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM (SELECT page_id, html, sha1(coalesce(html, '')) AS d, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)""",
    }
