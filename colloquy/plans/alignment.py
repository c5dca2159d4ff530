"""Queries over aligned tokens. Their SQL aligns by recursion: a row of edit costs at a time, then back from the end."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.operators import diarization as D
from colloquy.operators import evaluation as E
from colloquy.plans import fixtures as X
from colloquy.plans.registry import registry

Q, SQL, query = registry()


def _aligned_sql(tokens: str) -> str:
    """``al``: pair_id, op, ref_pos, ref, hyp, and step from the end; ``tokens`` defines ``tk`` with r, h to match by and rt, ht to show."""
    return f"""WITH RECURSIVE {tokens},
mat(pair_id, i, n, r, h, row) AS (
  SELECT pair_id, 0, len(r), r, h, range(0, len(h) + 1) FROM tk
  UNION ALL
  SELECT pair_id, i + 1, n, r, h, list_transform(range(1, len(h) + 2), lambda j: list_min(list_slice(a, 1, j)) + j) FROM (
    SELECT pair_id, i, n, r, h, list_prepend(i, list_transform(h, lambda x, j: least(row[j] + CAST(x <> r[i + 1] AS BIGINT), row[j + 1] + 1) - j - 1)) AS a FROM mat WHERE i < n)),
cell AS (SELECT pair_id, i, row FROM mat),
bt(pair_id, i, j, step, op, ref_pos, ref, hyp) AS (
  SELECT pair_id, len(r), len(h), 0, '', NULL::BIGINT, NULL::VARCHAR, NULL::VARCHAR FROM tk
  UNION ALL
  SELECT pair_id, i - CAST(op <> 'ins' AS INTEGER), j - CAST(op <> 'del' AS INTEGER), step + 1, op, CASE WHEN op <> 'ins' THEN i - 1 END, CASE WHEN op <> 'ins' THEN rt[i] END, CASE WHEN op <> 'del' THEN ht[j] END FROM (
    SELECT b.pair_id, b.i, b.j, b.step, t.rt, t.ht, CASE WHEN b.i > 0 AND b.j > 0 AND m.row[b.j + 1] = p.row[b.j] + CAST(t.r[b.i] <> t.h[b.j] AS BIGINT) THEN CASE WHEN t.r[b.i] = t.h[b.j] THEN 'match' ELSE 'sub' END
       WHEN b.i > 0 AND m.row[b.j + 1] = p.row[b.j + 1] + 1 THEN 'del' ELSE 'ins' END AS op
    FROM bt b JOIN tk t ON t.pair_id = b.pair_id JOIN cell m ON m.pair_id = b.pair_id AND m.i = b.i LEFT JOIN cell p ON p.pair_id = b.pair_id AND p.i = b.i - 1 WHERE b.i > 0 OR b.j > 0)),
al AS (SELECT * FROM bt WHERE step > 0)"""


_WORDS = """w AS (SELECT concat(conv_id, '-', turn) AS pair_id, string_split(coalesce(text, ''), ' ') AS t FROM conversations)"""
_CUT = "k % 11 = 0 OR k % 37 IN (20, 21) OR k % 61 BETWEEN 40 AND 44 OR k % 89 BETWEEN 60 AND 70"
_PLAIN = f"""{_WORDS}, tk AS (SELECT pair_id, list_transform(t, lambda x: lower(x)) AS r, flatten(list_transform(t, lambda x, k: CASE WHEN {_CUT} THEN []
  WHEN k % 13 = 0 THEN [lower(x), lower(x)] WHEN k % 17 = 0 THEN [lower(substr(x, 1, 3))] ELSE [lower(x)] END)) AS h, r AS rt, h AS ht FROM w)"""
_MARKED = """w0 AS (SELECT concat(conv_id, '-', turn) AS pair_id, string_split(coalesce(text, ''), ' ') AS t FROM conversations),
w1 AS (SELECT pair_id, t, flatten(list_transform(t, lambda x, k: CASE WHEN k % 23 = 0 THEN [] WHEN k % 7 = 0 THEN [regexp_replace(x, '[.,]$', '')] WHEN k % 19 = 0 THEN [concat(x, '.')] WHEN k % 5 = 0 THEN [lower(x)] WHEN k % 29 = 0 THEN [upper(x)] ELSE [x] END)) AS u FROM w0),
tk AS (SELECT pair_id, list_transform(t, lambda x: lower(regexp_replace(x, '[.,]+$', ''))) AS r, list_transform(u, lambda x: lower(regexp_replace(x, '[.,]+$', ''))) AS h, t AS rt, u AS ht FROM w1)"""
_AL = _aligned_sql(_PLAIN)
_ALM = _aligned_sql(_MARKED)
_COUNTS = "CAST(count(*) FILTER (op <> 'ins') AS BIGINT) AS n_ref, CAST(count(*) FILTER (op = 'del') AS BIGINT) AS deletions, CAST(count(*) FILTER (op = 'ins') AS BIGINT) AS insertions"


def _aligned(spark, sf):
    """Hypothesis: some words dropped, alone and in runs of 2, 5 and 11; some doubled, some cut to three letters."""
    return E.align(X.tokens(spark, sf))


def _marked(spark, sf):
    """Hypothesis: some words dropped, some ends of sentences lost or made up, some words in other case; aligned by bare words."""
    return E.align(X.marked_tokens(spark, sf))


@query(f"{_AL} SELECT pair_id, {_COUNTS}, CAST(count(*) FILTER (op = 'sub') AS BIGINT) AS substitutions, count(*) FILTER (op <> 'match') / nullif(count(*) FILTER (op <> 'ins'), 0) AS wer FROM al GROUP BY pair_id")
def wer_ops(spark, sf):
    return E.word_errors(_aligned(spark, sf), "pair_id")


@query(f"{_AL} SELECT pair_id, CAST(count(*) FILTER (op <> 'ins') AS BIGINT) AS n_ref, CAST(count(*) FILTER (op <> 'match') AS BIGINT) AS distance FROM al GROUP BY pair_id")
def wer_distance(spark, sf):
    out = E.word_errors(_aligned(spark, sf), "pair_id")
    return out.select("pair_id", "n_ref", (F.col("deletions") + F.col("insertions") + F.col("substitutions")).alias("distance"))


@query(f"""{_AL}, dr AS (SELECT pair_id, -step - row_number() OVER (PARTITION BY pair_id ORDER BY -step) AS run FROM al WHERE op = 'del'), rn AS (SELECT pair_id, run, count(*) AS length FROM dr GROUP BY ALL)
SELECT CASE WHEN length >= 10 THEN '10+' WHEN length >= 5 THEN '5-9' WHEN length >= 2 THEN '2-4' ELSE '1' END AS band, count(*) AS n, max(length) AS longest, (SELECT count(*) FROM al WHERE op = 'ins') AS insertions FROM rn GROUP BY 1""")
def deletion_run_bands(spark, sf):
    """Never without the insertions beside it."""
    aligned = _aligned(spark, sf)
    bands = E.deletion_runs(aligned).groupBy(E.run_band(F.col("length")).alias("band")).agg(F.count("*").alias("n"), F.max("length").alias("longest"))
    return bands.join(F.broadcast(aligned.agg(F.count_if(F.col("op") == "ins").alias("insertions"))), F.lit(True))  # one row


@query(f"""{_AL}, pl AS (SELECT pair_id, op, coalesce(ref_pos, last_value(ref_pos IGNORE NULLS) OVER (PARTITION BY pair_id ORDER BY -step ROWS UNBOUNDED PRECEDING), 0) AS place FROM al)
SELECT (place % 4) = 1 AS overlapped, {_COUNTS}, count(*) FILTER (op = 'del') / nullif(count(*) FILTER (op <> 'ins'), 0) AS deletion_rate FROM pl GROUP BY 1""")
def deletion_rate_by_overlap(spark, sf):
    """Every fourth reference word is spoken over another speaker."""
    t = X.tokens(spark, sf)
    flags = t.select("pair_id", F.posexplode("ref_tokens").alias("ref_pos", "token")).select("pair_id", F.col("ref_pos").cast("long").alias("ref_pos"), (F.col("ref_pos") % 4 == 1).alias("overlapped"))
    return E.deletion_rates(E.align(t), flags, "overlapped")


_MARK = "SELECT count(*) FILTER (a AND b) AS both, count(*) FILTER (a) AS in_ref, count(*) FILTER (b) AS in_hyp, count(*) FILTER (a AND b) / count(*) FILTER (b) AS precision, count(*) FILTER (a AND b) / count(*) FILTER (a) AS recall"


@query(f"{_ALM} {_MARK} FROM (SELECT coalesce(regexp_matches(ref, '[.?!]$'), false) AS a, coalesce(regexp_matches(hyp, '[.?!]$'), false) AS b FROM al)")
def punct_precision_recall(spark, sf):
    return E.mark_scores(_marked(spark, sf), r"[.?!]$")


@query(f"{_ALM} {_MARK} FROM (SELECT coalesce(regexp_matches(ref, '^[A-Z]'), false) AS a, coalesce(regexp_matches(hyp, '^[A-Z]'), false) AS b FROM al)")
def capitalisation_pr(spark, sf):
    return E.mark_scores(_marked(spark, sf), r"^[A-Z]")


@query(f"""{_ALM}, ho AS (SELECT concat(conv_id, '-', turn) AS pair_id, len(string_split(coalesce(text, ''), ' ')) - 1 AS ref_pos, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS after, role FROM conversations)
SELECT count(*) AS n_boundaries, count(*) FILTER (coalesce(regexp_matches(hyp, '[.?!]$'), false)) AS n_found, count(*) FILTER (coalesce(regexp_matches(hyp, '[.?!]$'), false)) / count(*) AS recall
FROM al JOIN ho ON ho.pair_id = al.pair_id AND ho.ref_pos = al.ref_pos AND after <> role WHERE regexp_matches(ref, '[.?!]$')""")
def boundary_recall(spark, sf):
    """Sentence ends where the next turn is another speaker's."""
    turns = D.handoffs(X.table(spark, sf, "conversations"), ["conv_id"], "turn", "role").where("handoff")
    last = F.size(F.split(F.coalesce("text", F.lit("")), " ")) - 1
    return E.boundary_recall(_marked(spark, sf), turns.select(F.concat_ws("-", "conv_id", "turn").alias("pair_id"), last.cast("long").alias("ref_pos")))


@query("SELECT conv_id, turn, coalesce(lead(role) OVER (PARTITION BY conv_id ORDER BY turn) <> role, false) AS handoff FROM conversations")
def speaker_handoffs(spark, sf):
    return D.handoffs(X.table(spark, sf, "conversations"), ["conv_id"], "turn", "role").select("conv_id", "turn", "handoff")
