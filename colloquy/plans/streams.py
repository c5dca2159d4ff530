"""Streaming queries over a display log, each run to the end of what there is; their SQL reads the same rows as a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.plans import fixtures as X
from colloquy.plans.registry import registry
from colloquy.sources.shared import fresh
from colloquy.streaming import commits

Q, SQL, query = registry()


def _log(spark, sf):
    raw = spark.readStream.schema(X.table(spark, sf, "events").schema).parquet(f"{sf}/event*.parquet")
    tier = F.when(F.col("event_id") % 4 != 0, "committed").otherwise("provisional")
    return raw.select(F.col("user_id").alias("token"), F.col("ts").cast("timestamp").alias("ts"), tier.alias("tier"), F.col("event_type").alias("text"))


def _run(spark, stream, mode="append"):
    return commits.run_once(stream, fresh(spark, "stream"), mode)


_CH = f"WITH {X.LOG}, c AS (SELECT token, lag(tier) OVER w AS tier, CAST(text <> lag(text) OVER w AS INTEGER) AS changed, epoch_us(ts) // 1000 - epoch_us(lag(ts) OVER w) // 1000 <= 43200000 AS near FROM log WINDOW w AS (PARTITION BY token ORDER BY ts))"


@query(f"{_CH} SELECT tier, count(*) AS n, CAST(sum(changed) AS BIGINT) AS changed FROM c WHERE tier IS NOT NULL GROUP BY tier")
def stream_commit_stability(spark, sf):
    return _run(spark, commits.changes(_log(spark, sf))).groupBy("tier").agg(F.sum("n").alias("n"), F.sum("changed").alias("changed"))


@query(f"{_CH} SELECT CAST(count(*) FILTER (changed = 1 AND near) AS BIGINT) AS trailing, CAST(count(*) FILTER (changed = 1 AND near) AS BIGINT) AS single, CAST(0 AS BIGINT) AS late FROM c WHERE tier IS NOT NULL")
def stream_trailing_revisions(spark, sf):
    """Changes within half a day of a token's last revision, and the single words among them (events are one word)."""
    out = _run(spark, commits.changes(_log(spark, sf), trailing=43_200))
    return out.agg(F.sum("trailing").alias("trailing"), F.sum("single").alias("single"), F.sum("late").alias("late"))


@query(f"""WITH {X.LOG}, m AS (SELECT token, ts FROM log WHERE tier = 'provisional'), n AS (SELECT m.token, epoch_us(m.ts) // 1000 AS pause_ms, epoch_us((SELECT min(l.ts) FROM log l WHERE l.tier = 'committed' AND l.token = m.token AND l.ts >= m.ts)) // 1000 AS commit_ms FROM m) SELECT * FROM n WHERE commit_ms IS NOT NULL""")
def stream_pause_to_commit(spark, sf):
    return _run(spark, commits.pauses(_log(spark, sf)))


@query(f"WITH {X.LOG} SELECT DISTINCT token FROM log WHERE tier = 'committed' AND token % 7 = 0")
def stream_dropped_words(spark, sf):
    """Committed words are final; what the display shows lacks every seventh token."""
    log = _log(spark, sf)
    kinds = F.explode(F.array_compact(F.array(F.when(F.col("tier") == "committed", "final"), F.when(F.col("token") % 7 != 0, "shown"))))
    out = _run(spark, commits.dropped_changes(log.select("token", "ts", "text", kinds.alias("tier"))))
    return out.groupBy("token").agg(F.sum("delta").alias("n")).where("n = 1").select("token")


@query(f"WITH {X.LOG} SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, tier, count(*) AS n FROM log GROUP BY ALL")
def stream_tumbling_revisions(spark, sf):
    out = _run(spark, commits.windows(_log(spark, sf), "1 day"), "complete")
    return out.select(F.col("start").cast("date").cast("string").alias("day"), "tier", "n")


@query(f"WITH {X.LOG}, w AS (SELECT unnest([CAST(ts AS DATE), CAST(ts AS DATE) - 1]) AS day, tier FROM log) SELECT CAST(day AS DATE)::VARCHAR AS day, tier, count(*) AS n FROM w GROUP BY ALL")
def stream_sliding_revisions(spark, sf):
    """Windows of two days, one beginning each day."""
    out = _run(spark, commits.windows(_log(spark, sf), "2 days", "1 day"), "complete")
    return out.select(F.col("start").cast("date").cast("string").alias("day"), "tier", "n")


@query(f"WITH {X.LOG}, g AS (SELECT token, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM log WINDOW w AS (PARTITION BY token ORDER BY ts)), s AS (SELECT token, ts, sum(new) OVER (PARTITION BY token ORDER BY ts) AS k FROM g) SELECT token, count(*) AS sessions FROM (SELECT DISTINCT token, k FROM s) GROUP BY token")
def stream_sessions(spark, sf):
    out = _run(spark, commits.sessions(_log(spark, sf), "6 hours"), "complete")
    return out.groupBy("token").agg(F.count("*").alias("sessions"))


@query(f"WITH {X.LOG}, e AS (SELECT max(ts) AS t FROM log) SELECT count(*) AS n, count(*) FILTER (tier = 'committed') AS n_committed FROM log, e WHERE ts >= t - INTERVAL 1 DAY")
def last_day_revisions(spark, sf):
    log = X.log(spark, sf)
    recent = log.join(F.broadcast(log.agg(F.max("ts").alias("t"))), F.col("ts") >= F.col("t") - F.expr("INTERVAL 1 DAY"))  # one row
    return recent.agg(F.count("*").alias("n"), F.count_if(F.col("tier") == "committed").alias("n_committed"))
