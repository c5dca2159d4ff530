"""Queries over assertion facts, latencies, merges and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.functions import scalars as S
from colloquy.operators import evaluation as E
from colloquy.plans import fixtures as X
from colloquy.plans.registry import registry

Q, SQL, query = registry()


_F = f"WITH {X.FACTS}, sc AS (SELECT scenario, run, sum(CASE severity WHEN 'critical' THEN 3 WHEN 'major' THEN 2 ELSE 1 END * CAST(passed AS INTEGER)) / sum(CASE severity WHEN 'critical' THEN 3 WHEN 'major' THEN 2 ELSE 1 END) AS score, bool_and(passed) AS full_pass, count(*) AS n FROM facts GROUP BY ALL)"


@query(f"{_F} SELECT * FROM sc")
def composite_score(spark, sf):
    return E.composite(X.facts(spark, sf))


@query(f"{_F} SELECT round(avg(s), 9) AS composite FROM (SELECT scenario, avg(score) AS s FROM sc GROUP BY scenario)")
def suite_score(spark, sf):
    return E.composite(X.facts(spark, sf)).groupBy("scenario").agg(F.avg("score").alias("s")).agg(F.round(F.avg("s"), 9).alias("composite"))


@query(f"""WITH {X.FACTS}, k AS (SELECT scenario, run, count(*) AS bullets, list_sort(list_distinct(list(category))) AS kw FROM facts GROUP BY ALL),
p AS (SELECT a.scenario, avg(len(list_intersect(a.kw, b.kw)) / len(list_distinct(list_concat(a.kw, b.kw)))) AS j FROM k a JOIN k b ON a.scenario = b.scenario AND a.run < b.run GROUP BY a.scenario)
SELECT k.scenario, round(var_pop(bullets), 6) AS bullet_variance, round(any_value(p.j), 6) AS keyword_jaccard FROM k LEFT JOIN p USING (scenario) GROUP BY k.scenario""")
def stability_jaccard(spark, sf):
    k = X.facts(spark, sf).groupBy("scenario", "run").agg(F.count("*").alias("bullets"), F.collect_set("category").alias("keywords"))
    return E.stability(k).select("scenario", F.round("bullet_variance", 6).alias("bullet_variance"), F.round("keyword_jaccard", 6).alias("keyword_jaccard"))


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type")
def latency_percentiles(spark, sf):
    out = E.latencies(X.table(spark, sf, "events"), "value", "event_type")
    return out.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("mean", "p50", "p95", "p99")])


@query("""WITH o AS (SELECT conv_id, turn, role AS owner FROM conversations WHERE turn % 3 <> 0), n AS (SELECT conv_id, turn, CASE WHEN conv_id % 4 = 0 THEN 'user' ELSE role END AS owner FROM conversations WHERE turn % 4 <> 1)
SELECT conv_id, turn, CASE WHEN o.owner IS NULL THEN 'insert' WHEN n.owner IS NULL THEN 'delete' WHEN o.owner <> n.owner THEN 'update' ELSE 'preserve' END AS action, coalesce(n.owner, o.owner) AS owner FROM o FULL JOIN n USING (conv_id, turn)""")
def action_item_merge(spark, sf):
    c = X.table(spark, sf, "conversations").withColumn("owner", F.col("role"))
    new = c.where("turn % 4 <> 1").withColumn("owner", F.when(F.col("conv_id") % 4 == 0, "user").otherwise(F.col("role")))
    return E.merge_items(c.where("turn % 3 <> 0"), new, ["conv_id", "turn"], "owner")


@query("SELECT user_id, event_id, ts AS valid_from, lead(ts) OVER w AS valid_to, lead(ts) OVER w IS NULL AS current FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)")
def summary_supersede(spark, sf):
    return E.validity(X.table(spark, sf, "events").select("user_id", "event_id", F.col("ts").alias("valid_from")), ["user_id"], "valid_from")


@query(f"""WITH {X.LOG}, m AS (SELECT token, ts FROM log WHERE tier = 'provisional') SELECT m.token, m.ts, (SELECT min(l.ts) FROM log l WHERE l.tier = 'committed' AND l.token = m.token AND l.ts >= m.ts) AS next_ts FROM m""")
def pause_to_commit(spark, sf):
    log = X.log(spark, sf)
    return E.next_after(log.where("tier = 'provisional'"), log.where("tier = 'committed'"), "token", "ts")


@query(f"WITH {X.FACTS}, a AS (SELECT DISTINCT scenario, category FROM facts WHERE passed AND run = 0), b AS (SELECT DISTINCT scenario, category FROM facts WHERE passed AND run = 1) SELECT a.* FROM a ANTI JOIN b USING (scenario, category)")
def regression_gate(spark, sf):
    f = X.facts(spark, sf)
    return E.regressions(f.where("run = 0"), f.where("run = 1"), ["scenario", "category"])


@query("WITH h AS (SELECT 'x' AS suite, CAST(ts AS DATE) AS run_date, count(*) // 100 AS n_files, avg(value) AS m FROM events GROUP BY 2) SELECT CAST(run_date AS VARCHAR) AS run_date, CASE WHEN lag(n_files) OVER w = n_files THEN round(m - lag(m) OVER w, 6) END AS delta FROM h WINDOW w AS (ORDER BY run_date)")
def release_delta(spark, sf):
    h = X.table(spark, sf, "events").groupBy(F.lit("x").alias("suite"), F.col("ts").cast("date").alias("run_date")).agg(F.floor(F.count("*") / 100).alias("n_files"), F.avg("value").alias("m"))
    return E.release_delta(h, "m").select(F.col("run_date").cast("string").alias("run_date"), F.round("delta", 6).alias("delta"))


@query("WITH k AS (SELECT conv_id, turn, list_distinct(string_split(text, ' ')) AS b FROM conversations) SELECT n.conv_id, n.turn, CAST(len(list_filter(p.b, lambda x: NOT list_contains(n.b, x))) AS BIGINT) AS dropped FROM k n JOIN k p ON p.conv_id = n.conv_id AND p.turn = n.turn - 1")
def refresh_continuity(spark, sf):
    k = X.table(spark, sf, "conversations").select("conv_id", "turn", F.split("text", " ").alias("b"))
    prev = k.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("b").alias("p"))
    return k.join(prev, ["conv_id", "turn"]).select("conv_id", "turn", F.size(F.array_except("p", "b")).cast("long").alias("dropped"))


_CAT = f"WITH {X.FACTS}, ct AS (SELECT *, unnest([category, severity, CASE WHEN assertion % 4 = 0 THEN 'long' ELSE 'short' END]) AS c FROM facts)"


def _categories(spark, sf):
    f = X.facts(spark, sf)
    return f.withColumn("categories", F.array("category", "severity", F.when(F.col("assertion") % 4 == 0, "long").otherwise("short")))


@query(f"{_CAT} SELECT c AS category, temperature, count(*) AS n, count(*) FILTER (passed) AS n_passed, count(*) FILTER (passed) / count(*) AS rate FROM ct GROUP BY ALL")
def full_pass_rate(spark, sf):
    """By category and temperature; a fact counts in each of its categories."""
    return E.pass_rates(_categories(spark, sf), "categories", "temperature")


@query(f"{_CAT}, o AS (SELECT c AS category, scenario, bool_and(passed) AS held, count(DISTINCT (temperature, run)) AS runs FROM ct GROUP BY ALL) SELECT category, count(*) AS n_scenarios, count(*) FILTER (held) AS n_held, max(runs) AS most_runs FROM o GROUP BY category")
def held_across_runs(spark, sf):
    """By category: scenarios that passed at both temperatures and in all runs."""
    return E.held(_categories(spark, sf), "categories", "scenario", "temperature", "run")


@query(f"""WITH a AS (SELECT event_id, value FROM events), b AS (SELECT event_id, CASE WHEN event_id = 7 THEN value + 1 ELSE value END AS value FROM events),
c AS (SELECT event_id, value FROM events UNION ALL SELECT event_id, value FROM events WHERE event_id = 7)
SELECT 'again' AS run, NOT EXISTS ((FROM a EXCEPT ALL FROM a) UNION ALL (FROM a EXCEPT ALL FROM a)) AS same UNION ALL SELECT 'changed', NOT EXISTS ((FROM a EXCEPT ALL FROM b) UNION ALL (FROM b EXCEPT ALL FROM a)) UNION ALL SELECT 'repeated', NOT EXISTS ((FROM a EXCEPT ALL FROM c) UNION ALL (FROM c EXCEPT ALL FROM a))""")
def determinism_check(spark, sf):
    """One output against itself in other partitions, with one value changed, and with one row twice."""
    e = X.table(spark, sf, "events").select("event_id", "value")
    others = {"again": e.repartition(5), "changed": e.withColumn("value", F.when(F.col("event_id") == 7, F.col("value") + 1).otherwise(F.col("value"))), "repeated": e.unionByName(e.where("event_id = 7"))}
    out = [E.same_output(e, x, ["event_id", "value"]).select(F.lit(name).alias("run"), "same") for name, x in others.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(f"WITH {X.FACTS}, m AS (SELECT category, avg(value) FILTER (run = 0) AS a, avg(value) FILTER (run = 1) AS b FROM facts GROUP BY category) SELECT category, round(a / b, 9) AS speed_up FROM m")
def speed_up(spark, sf):
    """Mean time of the first run over that of the second, by category."""
    f = X.facts(spark, sf)
    arms = [f.where(F.col("run") == r).groupBy("category").agg(F.avg("value").alias("seconds")) for r in (0, 1)]
    both = E.arm_delta(arms[0], arms[1], ["category"], ["seconds"])
    return both.select("category", F.round(S.ratio("seconds_a", "seconds_b"), 9).alias("speed_up"))


@query("SELECT c.conv_id, c.turn, c.role FROM conversations c WHERE c.role = 'user' AND NOT EXISTS (SELECT 1 FROM conversations d WHERE d.conv_id = c.conv_id AND d.turn > c.turn AND d.role <> c.role)")
def unanswered_turns(spark, sf):
    c = X.table(spark, sf, "conversations")
    return E.unanswered(c, "conv_id", "turn", "role").where("role = 'user'").select("conv_id", "turn", "role")


@query(f"""WITH {X.LOG}, m AS (SELECT token, ts FROM log WHERE tier = 'provisional'), n AS (SELECT m.token, m.ts, (SELECT min(l.ts) FROM log l WHERE l.tier = 'committed' AND l.token = m.token AND l.ts >= m.ts) AS next_ts FROM m)
SELECT token % 4 AS capture, count(next_ts) AS n, round(median(epoch_us(next_ts) // 1000 - epoch_us(ts) // 1000) / 1000, 3) AS median_s FROM n GROUP BY 1""")
def median_pause(spark, sf):
    """Median seconds from a provisional word to its commit, by capture."""
    log = X.log(spark, sf)
    met = E.next_after(log.where("tier = 'provisional'"), log.where("tier = 'committed'"), "token", "ts").withColumn("capture", F.col("token") % 4)
    ms = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
    return E.median_by(met.withColumn("ms", ms("next_ts") - ms("ts")), F.col("ms"), "capture").select("capture", "n", F.round(F.col("median") / 1000, 3).alias("median_s"))


_CH = f"WITH {X.LOG}, c AS (SELECT token, lag(tier) OVER w AS tier, CAST(text <> lag(text) OVER w AS INTEGER) AS changed FROM log WINDOW w AS (PARTITION BY token ORDER BY ts))"


@query(f"{_CH} SELECT tier, count(*) AS n, sum(changed) / count(*) AS rate FROM c WHERE tier IS NOT NULL GROUP BY tier")
def change_rate(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("token").orderBy("ts")
    log = X.log(spark, sf).select(F.lag("tier").over(w).alias("tier"), (F.col("text") != F.lag("text").over(w)).cast("int").alias("changed")).where("tier is not null")
    return log.groupBy("tier").agg(F.count("*").alias("n"), S.ratio(F.sum("changed"), F.count("*")).alias("rate"))


@query(f"WITH {X.LOG} SELECT DISTINCT token FROM log WHERE tier = 'committed' AND token % 7 = 0")
def dropped_words(spark, sf):
    from colloquy.streaming import commits

    log = X.log(spark, sf)
    return commits.dropped(log.where("tier = 'committed'").select("token").distinct(), log.where("token % 7 <> 0"))
