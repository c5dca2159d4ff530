"""The registered queries of the training-data operators, with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import backoff, decontaminate, html_extract, line_dedup, media, mixing, near_dedup, quality, sharding, url_filter

SHARD_BYTES = 32 << 20
#: The query's limit: small enough that tables of a few megabytes split several levels deep.
SMALL_SHARD_BYTES = 64 << 10

#: Rules that the url query is asked for: host, path, verdict.
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op3_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = backoff.stupid_backoff(_read(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(_read(spark, sf_dir, "documents"))


def _escaped(column) -> Column:
    out = F.coalesce(column.cast("string"), F.lit(""))
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return out


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a page: its source, a picture of the whole text with the language as caption, the whole text."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    raw = F.encode("text", "UTF-8")
    gap = F.when(F.octet_length("text") == 0, F.lit(media.ROW)).otherwise(F.pmod(-F.octet_length("text"), F.lit(media.ROW)))
    digest = F.sha2(F.concat(raw, F.unhex(F.repeat(F.lit("FF"), gap))), 256)
    html = F.concat(F.lit("<h1>"), _escaped(F.col("source")), F.lit('</h1><figure><img src="media:'), digest, F.lit('"><figcaption>'), _escaped(F.col("lang")), F.lit("</figcaption></figure><p>"), _escaped(F.col("text")), F.lit("</p>"))
    seqs = media.sequences(docs.select(F.col("doc_id").alias("page_id"), html.alias("html")))
    found = media.resolve(seqs, media.measure(media.store(docs)))
    return found.select(F.col("page_id").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_read(spark, sf_dir, "documents").select("doc_id", "text"), SMALL_SHARD_BYTES).drop("text")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_read(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(_read(spark, sf_dir, "pages"), rules)


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_decontaminate, op2_quality, op3_backoff, op4_mixing, op5_media, op6_line_dedup, op7_sharding, op8_html, op9_url_filter, op10_near_dedup)
}

_WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP3_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
p AS (SELECT doc_id, i, w[i] AS w0, CASE WHEN i > 1 THEN w[i-1] END AS w1, CASE WHEN i > 2 THEN w[i-2] END AS w2
      FROM d, unnest(range(1, len(w) + 1)) AS t(i)),
c1 AS (SELECT w0, count(*) AS c FROM p GROUP BY w0),
c2 AS (SELECT w1, w0, count(*) AS c FROM p WHERE w1 IS NOT NULL GROUP BY ALL),
c3 AS (SELECT w2, w1, w0, count(*) AS c FROM p WHERE w2 IS NOT NULL GROUP BY ALL),
s AS (SELECT p.doc_id, CASE
        WHEN t.c >= 2 THEN ln(t.c / h.c)
        WHEN b.c >= 2 THEN ln(b.c / u1.c) + CASE WHEN p.w2 IS NULL THEN 0 ELSE ln(0.4) END
        ELSE ln(u0.c / (SELECT count(*) FROM p)) + least(p.i - 1, 2) * ln(0.4) END AS x
      FROM p JOIN c1 u0 ON u0.w0 = p.w0 LEFT JOIN c1 u1 ON u1.w0 = p.w1
      LEFT JOIN c2 b ON b.w1 = p.w1 AND b.w0 = p.w0 LEFT JOIN c2 h ON h.w1 = p.w2 AND h.w0 = p.w1
      LEFT JOIN c3 t ON t.w2 = p.w2 AND t.w1 = p.w1 AND t.w0 = p.w0),
r AS (SELECT doc_id, sum(x) AS x FROM s GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, round(r.x, 4) AS log_score FROM d LEFT JOIN r USING (doc_id)
"""

OP6_SQL = rf"""
WITH l AS (SELECT doc_id, u.pos, u.line FROM documents,
             LATERAL (SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos) u),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '{_UPPER}', '{_LOWER}') AS key FROM l),
g AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, g.key IS NOT NULL AND k.doc_id <> g.last AS gone FROM k LEFT JOIN g USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


def op7_sql(limit: int = SMALL_SHARD_BYTES) -> str:
    return f"""
WITH d AS (SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 15) AS BIGINT) AS h, coalesce(strlen(text), 0) AS b FROM documents),
p AS (SELECT DISTINCT h, CAST(t.depth AS INTEGER) AS depth, h >> (60 - t.depth) AS prefix FROM d, range(61) AS t(depth)),
s AS (SELECT p.depth, p.prefix, CAST(sum(d.b) AS BIGINT) AS bytes, count(*) AS n FROM p JOIN d USING (h) GROUP BY ALL),
f AS (SELECT p.h, min(p.depth) AS depth FROM p JOIN s USING (depth, prefix) WHERE s.bytes <= {limit} OR p.depth = 60 GROUP BY p.h)
SELECT d.doc_id, f.depth AS shard_depth, d.h >> (60 - f.depth) AS shard_prefix, CAST(0 AS BIGINT) AS shard_page, s.bytes AS shard_bytes, s.n AS shard_docs
FROM d JOIN f USING (h) JOIN s ON s.depth = f.depth AND s.prefix = d.h >> (60 - f.depth)
"""


OP9_SQL = rf"""
WITH r(rh, rp, v) AS (VALUES {", ".join(str(x) for x in URL_RULES)}),
u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
q AS (SELECT page_id, translate(raw, '{_UPPER}', '{_LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
m AS (SELECT q.page_id, r.*, row_number() OVER (PARTITION BY q.page_id ORDER BY length(rh) + length(rp) DESC, length(rh) DESC, v DESC) AS k
      FROM q JOIN r ON (q.host = rh OR ends_with(q.host, '.' || rh)) AND starts_with(q.path, rp))
SELECT q.page_id, q.host, q.path, m.rh || m.rp AS rule, coalesce(m.v, 'allow') AS verdict FROM q LEFT JOIN m ON m.page_id = q.page_id AND m.k = 1
"""

OP10_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4])) END AS g FROM d),
n AS (SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles FROM s),
x AS (SELECT doc_id, unnest(g) AS g FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT c.a, c.b FROM c JOIN n p ON p.doc_id = c.a JOIN n q ON q.doc_id = c.b WHERE 100 * c.k >= 75 * (p.n_shingles + q.n_shingles - c.k)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.doc_id WHERE r.root < l.b),
t AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
SELECT n.doc_id, n.n_shingles, t.component_id, n.doc_id = t.component_id AS kept FROM n JOIN t USING (doc_id)
"""

ORACLE: dict[str, str] = {"op3_backoff": OP3_SQL, "op6_line_dedup": OP6_SQL, "op7_sharding": op7_sql(), "op9_url_filter": OP9_SQL, "op10_near_dedup": OP10_SQL}
