"""Evaluation inputs derived from the driver's tables, by one SQL text that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Reference and hypothesis segments from conversation turns.
SEGMENTS = """
b AS (SELECT conv_id, turn, role, CAST(60 * length(coalesce(text, '')) AS BIGINT) AS d FROM conversations),
r AS (SELECT conv_id, turn, role, d, CAST(coalesce(sum(d + 400) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s FROM b),
h AS (SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 5 = 0 THEN CASE WHEN role = 'user' THEN 'assistant' ELSE 'user' END ELSE role END AS role,
        greatest(0, s + ((7 * conv_id + 13 * turn) % 11 - 5) * 100) AS s, s + d + ((3 * conv_id + 5 * turn) % 9 - 2) * 150 AS e
      FROM r WHERE (3 * conv_id + turn) % 17 <> 0),
seg AS (SELECT conv_id AS file_id, 'ref' AS side, role AS speaker, s AS start_ms, s + d AS end_ms, turn AS line FROM r
        UNION ALL SELECT conv_id, 'hyp', concat(role, '_h'), s, greatest(e, s + 1), turn FROM h)"""

#: Assertion facts from events.
FACTS = """
facts AS (SELECT user_id AS scenario, event_id % 3 AS run, event_id AS assertion, value,
            CASE event_type WHEN 'purchase' THEN 'critical' WHEN 'signup' THEN 'critical' WHEN 'click' THEN 'major' ELSE 'minor' END AS severity, value < 60 AS passed, event_type AS category,
            event_id % 2 AS temperature FROM events)"""

#: Display log from events: token, revision time, tier, text.
LOG = """
log AS (SELECT user_id AS token, ts, CASE WHEN event_id % 4 <> 0 THEN 'committed' ELSE 'provisional' END AS tier, event_type AS text FROM events)"""

#: Reference and hypothesis tokens of each turn.
TOKENS = """
w AS (SELECT concat(CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) AS pair_id, split(lower(coalesce(text, '')), ' ') AS t FROM conversations)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run(spark: SparkSession, sf_dir: str, ctes: str, tail: str, *tables: str) -> DataFrame:
    text = f"WITH {ctes} {tail}"
    for t in tables:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in tables})


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, SEGMENTS, "SELECT * FROM seg", "conversations")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, FACTS, "SELECT * FROM facts", "events")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, LOG, "SELECT * FROM log", "events")


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hypothesis: words dropped alone and in runs, doubled, or cut to three letters."""
    hyp = """flatten(transform(t, (x, i) -> CASE WHEN i % 11 = 10 OR i % 37 IN (19, 20) OR i % 61 BETWEEN 39 AND 43 OR i % 89 BETWEEN 59 AND 69 THEN array()
             WHEN i % 13 = 12 THEN array(x, x) WHEN i % 17 = 16 THEN array(substring(x, 1, 3)) ELSE array(x) END))"""
    return run(spark, sf_dir, TOKENS, f"SELECT pair_id, t AS ref_tokens, {hyp} AS hyp_tokens FROM w", "conversations")


def marked_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As spoken and as written: marks and capitals lost and made up; keys are the bare words."""
    hyp = """flatten(transform(t, (x, i) -> CASE WHEN i % 23 = 22 THEN array() WHEN i % 7 = 6 THEN array(regexp_replace(x, '[.,]$', '')) WHEN i % 19 = 18 THEN array(concat(x, '.'))
             WHEN i % 5 = 4 THEN array(lower(x)) WHEN i % 29 = 28 THEN array(upper(x)) ELSE array(x) END))"""
    bare = "transform({0}, x -> lower(regexp_replace(x, '[.,]+$', '')))"
    words = TOKENS.replace("split(lower(coalesce(text, '')), ' ')", "split(coalesce(text, ''), ' ')")
    return run(spark, sf_dir, f"{words}, u AS (SELECT pair_id, t, {hyp} AS h FROM w)", f"SELECT pair_id, t AS ref_tokens, h AS hyp_tokens, {bare.format('t')} AS ref_keys, {bare.format('h')} AS hyp_keys FROM u", "conversations")
