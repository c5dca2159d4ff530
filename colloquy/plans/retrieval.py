"""Queries over vectors, voice prints and the texts they are ranked with. Searches ask with every id divisible by 50."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.functions import scalars as S
from colloquy.operators import retrieval as R
from colloquy.plans import fixtures as X
from colloquy.plans.registry import registry

Q, SQL, query = registry()

ASKED = "vec_id % 50 = 0"


def _vectors(spark, sf):
    return X.table(spark, sf, "embeddings").select("vec_id", F.col("label").alias("entity"), F.col("embedding").alias("vec"))


def _asked(vectors):
    return vectors.select(F.col("vec_id").alias("query_id"), F.col("entity").alias("truth"), F.col("vec").alias("query_vec"))


def _pooled(spark, sf):
    v = _vectors(spark, sf)
    return R.entity_scores(_asked(v.where(ASKED)), v, exclude_self=True)


_DOT = "list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[]))"
_SC = f"""WITH sc AS (SELECT q.vec_id AS query_id, q.label AS truth, v.vec_id, v.label AS entity, {_DOT} AS score FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0),
mx AS (SELECT query_id, truth, entity, max(score) AS score FROM sc GROUP BY ALL),
rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entity) AS INTEGER) AS rank FROM mx),
gt AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS top FROM mx),
tr AS (SELECT query_id, truth, rank FROM rk WHERE entity = truth)"""


@query(f"{_SC}, kn AS (SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM sc) SELECT query_id, vec_id, round(score, 6) AS score, rank FROM kn WHERE rank <= 5")
def knn_topk(spark, sf):
    v = _vectors(spark, sf)
    return R.search(_asked(v.where(ASKED)), v, 5, exclude_self=True).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query(f"{_SC} SELECT query_id, truth, entity, round(score, 6) AS score, rank FROM rk")
def maxpool_rank(spark, sf):
    return R.ranked(_pooled(spark, sf)).select("query_id", "truth", "entity", F.round("score", 6).alias("score"), "rank")


@query(f"{_SC} SELECT count(*) AS n_queries, avg(CAST(rank <= 1 AS DOUBLE)) AS recall_at_1, avg(CAST(rank <= 3 AS DOUBLE)) AS recall_at_3, avg(CAST(rank <= 5 AS DOUBLE)) AS recall_at_5 FROM tr")
def recall_at_k(spark, sf):
    return R.rank_metrics(R.ranked(_pooled(spark, sf)).where("entity = truth")).drop("mrr")


@query(f"{_SC} SELECT truth, count(*) AS n_queries, round(avg(1.0 / rank), 9) AS mrr FROM tr GROUP BY truth")
def mrr(spark, sf):
    return R.rank_metrics(R.ranked(_pooled(spark, sf)).where("entity = truth"), "truth").select("truth", "n_queries", F.round("mrr", 9).alias("mrr"))


@query(f"{_SC}, qs AS (SELECT query_id % 3 AS query_set, entity, max(score) AS score FROM mx GROUP BY ALL) SELECT *, CAST(row_number() OVER (PARTITION BY query_set ORDER BY score DESC, entity) AS INTEGER) AS rank FROM (SELECT query_set, entity, round(score, 6) AS score FROM qs)")
def query_set_pool(spark, sf):
    """Several queries asked together: an entity's score is the most over all of them."""
    sets = _pooled(spark, sf).withColumn("query_set", F.col("query_id") % 3)
    pooled = R.max_pool(sets, "query_set", "entity").withColumn("score", F.round("score", 6))
    return R.ranked(pooled, "query_set")


_GATED = """g AS (SELECT q.vec_id AS query_id, q.label AS truth, v.label AS entity, max(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[]))) AS score FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id AND v.label % 3 <> 0 WHERE q.vec_id % 50 = 0 GROUP BY ALL),
b AS (SELECT query_id, truth, truth % 3 <> 0 AS positive, arg_max(entity, score) = truth AS rgt, max(score) >= 0.35 AS passes FROM g GROUP BY query_id, truth)"""


@query(f"WITH {_GATED} SELECT count(*) FILTER (positive) AS n_positive, count(*) FILTER (positive AND passes) AS n_pass, count(*) FILTER (positive AND passes AND rgt) AS n_right, count(*) FILTER (NOT positive) AS n_negative, count(*) FILTER (NOT positive AND NOT passes) AS n_silenced FROM b")
def relevance_gate(spark, sf):
    """Every third entity is not in the library: queries for it are negative, and should be silenced."""
    v = _vectors(spark, sf)
    best = R.top_k(R.gate(R.entity_scores(_asked(v.where(ASKED)), v.where("entity % 3 <> 0"), exclude_self=True)), 1)
    return R.gate_outcomes(best.withColumns({"right": F.col("entity") == F.col("truth"), "positive": F.col("truth") % 3 != 0}))


@query(f"{_SC} SELECT query_id, entity FROM gt WHERE top >= 0.35 AND score >= greatest(0.35, 0.8 * top)")
def entry_threshold(spark, sf):
    return R.gate(_pooled(spark, sf)).where("enters").select("query_id", "entity")


_W = r"list_transform(regexp_extract_all(coalesce(text, ''), '[^ \t\n]+'), lambda x: lower(x))"
_TXT = rf"""t0 AS (SELECT doc_id % 10 AS entity, unnest({_W}) AS term FROM documents),
tm AS (SELECT entity, term, count(*) AS tf FROM t0 GROUP BY ALL), sz AS (SELECT entity, sum(tf) AS size FROM tm GROUP BY entity), wh AS (SELECT count(*) AS n, avg(size) AS mean FROM sz),
df AS (SELECT term, count(*) AS df FROM tm GROUP BY term), aq AS (SELECT DISTINCT doc_id AS query_id, unnest({_W}) AS term FROM documents WHERE doc_id % 50 = 0),
bm AS (SELECT query_id, tm.entity, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * size / mean))) AS s FROM aq JOIN tm USING (term) JOIN df USING (term) JOIN sz ON sz.entity = tm.entity, wh GROUP BY ALL),
tx AS (SELECT query_id, entity, s / max(s) OVER (PARTITION BY query_id) AS text_score FROM bm)"""


def _words():
    return F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^ \t\n]+"), F.lit(0)), F.lower)


@query(f"WITH {_TXT} SELECT query_id, entity, round(text_score, 6) AS text_score FROM tx")
def text_rank(spark, sf):
    d = X.table(spark, sf, "documents").select("doc_id", _words().alias("words"))
    found = R.text_scores(d.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "words"), d.select((F.col("doc_id") % 10).alias("entity"), "words"))
    return found.select("query_id", "entity", F.round("text_score", 6).alias("text_score"))


_HYBRID = f"""{_SC}, {_TXT}, ev AS (SELECT user_id % 10 AS entity, greatest(0, 1 - date_diff('day', CAST(max(ts) AS DATE), DATE '2024-01-31') / 30.0) AS recency FROM events GROUP BY 1),
ln AS (SELECT doc_id % 10 AS entity, sum(n_chars) AS len FROM documents GROUP BY 1), lm AS (SELECT entity, len / max(len) OVER () AS length FROM ln),
hy AS (SELECT mx.query_id, mx.entity, round(0.5 * mx.score + 0.3 * coalesce(text_score, 0) + 0.1 * coalesce(recency, 0) + 0.1 * coalesce(length, 0), 6) AS hybrid
       FROM mx LEFT JOIN tx ON tx.query_id = mx.query_id AND tx.entity = mx.entity LEFT JOIN ev ON ev.entity = mx.entity LEFT JOIN lm ON lm.entity = mx.entity)"""


@query(f"{_HYBRID} SELECT query_id, entity, hybrid FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hybrid DESC, entity) AS k FROM hy) WHERE k <= 3")
def hybrid_rank(spark, sf):
    """Entities are meetings of documents and events: vector, text, the newest event and the length."""
    d = X.table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 10).alias("entity"), "n_chars", _words().alias("words"))
    text = R.text_scores(d.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "words"), d)
    age = F.date_diff(F.lit("2024-01-31").cast("date"), F.max("ts").cast("date"))
    recency = X.table(spark, sf, "events").groupBy((F.col("user_id") % 10).alias("entity")).agg(F.greatest(F.lit(0.0), 1 - age / 30.0).alias("recency"))
    sizes = d.groupBy("entity").agg(F.sum("n_chars").alias("n_chars"))
    length = sizes.join(F.broadcast(sizes.agg(F.max("n_chars").alias("most"))), F.lit(True)).select("entity", (F.col("n_chars") / F.col("most")).alias("length"))  # one row
    every = _pooled(spark, sf).join(text, ["query_id", "entity"], "left").join(recency, "entity", "left").join(length, "entity", "left").na.fill(0.0, ["text_score", "recency", "length"])
    top = R.top_k(R.hybrid(every).withColumn("score", F.round("hybrid", 6)), 3)
    return top.select("query_id", "entity", F.col("score").alias("hybrid"))


@query(f"{_SC}, st AS (SELECT 'all' AS strategy, query_id, truth, entity, score FROM sc UNION ALL SELECT 'few', query_id, truth, entity, score FROM sc WHERE vec_id % 5 = 0), sm AS (SELECT strategy, query_id, truth, entity, max(score) AS score FROM st GROUP BY ALL), sr AS (SELECT *, row_number() OVER (PARTITION BY strategy, query_id ORDER BY score DESC, entity) AS rank FROM sm) SELECT strategy, count(*) AS n_queries, avg(CAST(rank <= 3 AS DOUBLE)) AS recall_at_3 FROM sr WHERE entity = truth GROUP BY strategy")
def strategy_compare(spark, sf):
    """The same queries against all vectors of an entity, and against every fifth."""
    v = _vectors(spark, sf)
    asked = _asked(v.where(ASKED))
    both = [R.entity_scores(asked, kind, exclude_self=True).withColumn("strategy", F.lit(name)) for name, kind in (("all", v), ("few", v.where("vec_id % 5 = 0")))]
    pooled = both[0].unionByName(both[1]).withColumn("q", F.struct("strategy", "query_id"))
    return R.rank_metrics(R.ranked(pooled, "q").where("entity = truth"), "strategy").select("strategy", "n_queries", "recall_at_3")


# -- identity: odd prints are probes, even ones are enrolled ----------------------------------------------------------
_ID = """WITH ps AS (SELECT q.vec_id AS query_id, q.label AS truth, v.label AS entity, max(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[]))) AS score FROM embeddings q JOIN embeddings v ON v.vec_id % 2 = 0 WHERE q.vec_id % 2 = 1 GROUP BY ALL),
pr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entity) AS k FROM ps),
tw AS (SELECT query_id, truth, max(entity) FILTER (k = 1) AS person, max(score) FILTER (k = 1) AS top1, max(score) FILTER (k = 2) AS top2 FROM pr WHERE k <= 2 GROUP BY ALL),
oc AS (SELECT query_id, truth, person, CASE WHEN NOT (top1 >= 0.34 AND coalesce(top1 - top2 >= 0.02, true)) THEN 'refused' WHEN person = truth THEN 'correct' ELSE 'wrong' END AS outcome,
         CASE WHEN top1 >= 0.34 AND coalesce(top1 - top2 >= 0.02, true) THEN 'named' WHEN top1 >= 0.28 THEN 'suggested' ELSE 'none' END AS tier FROM tw)"""


def _trials(spark, sf):
    v = _vectors(spark, sf)
    return R.identify(R.entity_scores(_asked(v.where("vec_id % 2 = 1")), v.where("vec_id % 2 = 0")))


@query(f"{_ID} SELECT query_id, truth, person, outcome FROM oc")
def identify_open_set(spark, sf):
    return _trials(spark, sf).select("query_id", "truth", "person", "outcome")


@query(f"{_ID} SELECT tier, count(*) AS n FROM oc GROUP BY tier")
def ambiguity_refusal(spark, sf):
    return _trials(spark, sf).groupBy("tier").agg(F.count("*").alias("n"))


_Z = 1.959963984540054


@query(f"""{_ID}, n AS (SELECT count(*) AS n, count(*) FILTER (outcome = 'correct') AS correct, count(*) FILTER (outcome = 'wrong') AS wrong, count(*) FILTER (outcome = 'refused') AS refused FROM oc)
SELECT n, correct, wrong, refused, round((wrong / n + {_Z * _Z} / (2 * n)) / (1 + {_Z * _Z} / n) - {_Z} * sqrt(wrong / n * (1 - wrong / n) / n + {_Z * _Z} / (4 * n * n)) / (1 + {_Z * _Z} / n), 9) AS wrong_low,
  round((wrong / n + {_Z * _Z} / (2 * n)) / (1 + {_Z * _Z} / n) + {_Z} * sqrt(wrong / n * (1 - wrong / n) / n + {_Z * _Z} / (4 * n * n)) / (1 + {_Z * _Z} / n), 9) AS wrong_high FROM n""")
def outcome_rates_wilson(spark, sf):
    return R.outcome_rates(_trials(spark, sf)).withColumns({"wrong_low": F.round("wrong_low", 9), "wrong_high": F.round("wrong_high", 9)})


@query("SELECT label AS speaker, vec_id AS session, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) = 1 THEN 'probe' ELSE 'enrol' END AS role FROM embeddings")
def holdout_split(spark, sf):
    return R.holdout(_vectors(spark, sf).select(F.col("entity").alias("speaker"), F.col("vec_id").alias("session")))


@query("WITH p AS (SELECT DISTINCT vec_id % 25 AS room, label AS speaker FROM embeddings) SELECT x.speaker AS a, y.speaker AS b, count(*) AS rooms FROM p x JOIN p y ON x.room = y.room AND x.speaker <> y.speaker GROUP BY ALL")
def impostor_pairs(spark, sf):
    return R.impostors(_vectors(spark, sf).select((F.col("vec_id") % 25).alias("room"), F.col("entity").alias("speaker")))


@query(f"""WITH n AS (SELECT q.vec_id AS query_id, q.label AS person, max({_DOT}) AS nearest FROM embeddings q JOIN embeddings v ON q.label <> v.label GROUP BY ALL)
SELECT query_id, person, round(0.34 + 0.5 * greatest(0, nearest - 0.34), 6) AS bar FROM n""")
def raised_bars(spark, sf):
    return R.raised_bars(_vectors(spark, sf)).select("query_id", "person", F.round("bar", 6).alias("bar"))


@query("WITH x AS (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(x) AS x FROM x GROUP BY ALL) SELECT label AS entity, CAST(count(*) AS BIGINT) AS dims, round(sqrt(sum(x * x)), 6) AS norm FROM m GROUP BY label")
def mean_profiles(spark, sf):
    p = R.mean_profile(_vectors(spark, sf))
    return p.select("entity", F.size("vec").cast("long").alias("dims"), F.round(F.sqrt(S.dot("vec", "vec")), 6).alias("norm"))


@query(f"""{_ID}, x AS (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE vec_id % 2 = 0), m AS (SELECT label, i, avg(x) AS x FROM x GROUP BY ALL),
u AS (SELECT label, list(x / n ORDER BY i) AS v FROM m JOIN (SELECT label, sqrt(sum(x * x)) AS n FROM m GROUP BY label) USING (label) GROUP BY label),
mp AS (SELECT q.vec_id AS query_id, q.label AS truth, arg_max(u.label, list_dot_product(CAST(q.embedding AS DOUBLE[]), u.v)) AS person FROM embeddings q, u WHERE q.vec_id % 2 = 1 GROUP BY ALL)
SELECT 'prints' AS profile, count(*) AS n, count(*) FILTER (entity = truth) AS n_right FROM pr WHERE k = 1 UNION ALL SELECT 'mean', count(*), count(*) FILTER (person = truth) FROM mp""")
def prints_or_mean(spark, sf):
    """Probes against all prints of a person, and against the person's mean print."""
    v = _vectors(spark, sf)
    asked, enrolled = _asked(v.where("vec_id % 2 = 1")), v.where("vec_id % 2 = 0")
    means = R.mean_profile(enrolled).select(F.col("entity").alias("vec_id"), "entity", R.unit("vec").alias("vec"))
    best = [R.top_k(R.entity_scores(asked, kind), 1).withColumn("profile", F.lit(name)) for name, kind in (("prints", enrolled), ("mean", means))]
    return best[0].unionByName(best[1]).groupBy("profile").agg(F.count("*").alias("n"), F.count_if(F.col("entity") == F.col("truth")).alias("n_right"))


@query(f"""WITH p AS (SELECT q.label AS entity, avg({_DOT}) AS s FROM embeddings q JOIN embeddings v ON q.label = v.label AND q.vec_id < v.vec_id GROUP BY 1)
SELECT label AS entity, count(*) AS n, round(any_value(s), 6) AS similarity, coalesce(round(any_value(s), 6) >= 0.0, true) AS agrees FROM embeddings LEFT JOIN p ON p.entity = label GROUP BY label""")
def cluster_consistency(spark, sf):
    out = R.consistency(_vectors(spark, sf)).withColumn("similarity", F.round("similarity", 6))
    return out.withColumn("agrees", F.coalesce(F.col("similarity") >= 0.0, F.lit(True)))


@query("SELECT avg(n) AS mean_vectors FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label)")
def vectors_per_entity(spark, sf):
    return _vectors(spark, sf).groupBy("entity").agg(F.count("*").alias("n")).agg(F.avg("n").alias("mean_vectors"))


@query("SELECT event_id FROM events WHERE ts >= DATE '2024-07-15' - INTERVAL 6 MONTH")
def candidate_window(spark, sf):
    return R.within_months(X.table(spark, sf, "events"), "ts", "2024-07-15").select("event_id")
