"""Queries over speaker segments and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.functions import scalars as S
from colloquy.operators import diarization as D
from colloquy.operators import evaluation as E
from colloquy.operators import retrieval as R
from colloquy.plans.fixtures import SEGMENTS, segments
from colloquy.plans.registry import registry
from colloquy.sources import corpora, rttm

Q, SQL, query = registry()


_SEG = f"WITH RECURSIVE {SEGMENTS}"
_ATOMS = f"""{_SEG},
sg AS (SELECT * FROM seg WHERE end_ms > start_ms),
rb AS (SELECT DISTINCT file_id, unnest([start_ms, end_ms]) AS b FROM sg WHERE side = 'ref'),
bt AS (SELECT file_id, unnest([start_ms, end_ms]) AS t FROM sg UNION SELECT file_id, unnest([b - 125, b + 125]) FROM rb),
nx AS (SELECT file_id, t, lead(t) OVER (PARTITION BY file_id ORDER BY t) AS e FROM bt),
ok AS (SELECT nx.* FROM nx WHERE e IS NOT NULL AND NOT EXISTS (SELECT 1 FROM rb WHERE rb.file_id = nx.file_id AND rb.b - 125 < nx.e AND rb.b + 125 > nx.t)),
atm AS (SELECT ok.file_id, ok.t AS start_ms, ok.e AS end_ms, coalesce(list_sort(list_distinct(list(speaker) FILTER (side = 'ref'))), []) AS ref, coalesce(list_sort(list_distinct(list(speaker) FILTER (side = 'hyp'))), []) AS hyp
       FROM ok JOIN sg ON sg.file_id = ok.file_id AND sg.start_ms <= ok.t AND sg.end_ms >= ok.e GROUP BY ALL),
co AS (SELECT file_id, r.ref, h.hyp, CAST(sum(end_ms - start_ms) AS BIGINT) AS ms FROM atm, unnest(atm.ref) AS r(ref), unnest(atm.hyp) AS h(hyp) GROUP BY ALL),
lb AS (SELECT file_id, ref, row_number() OVER (PARTITION BY file_id ORDER BY ref) AS k FROM (SELECT DISTINCT file_id, ref FROM co)),
rec(file_id, k, used, picks, total) AS (
  SELECT DISTINCT file_id, CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), CAST(0 AS BIGINT) FROM co
  UNION ALL SELECT rec.file_id, lb.k, CASE WHEN c.hyp IS NULL THEN used ELSE list_append(used, c.hyp) END, CASE WHEN c.hyp IS NULL THEN picks ELSE list_append(picks, lb.ref || '=' || c.hyp) END, total + coalesce(c.ms, 0)
  FROM rec JOIN lb ON lb.file_id = rec.file_id AND lb.k = rec.k + 1
  JOIN (SELECT file_id, ref, hyp, ms FROM co UNION ALL SELECT DISTINCT file_id, ref, NULL, NULL FROM co) c ON c.file_id = lb.file_id AND c.ref = lb.ref AND (c.hyp IS NULL OR NOT list_contains(used, c.hyp))),
best AS (SELECT file_id, max(total) AS right_ms, arg_max(picks, total) AS picks FROM rec GROUP BY file_id),
mp AS (SELECT file_id, split_part(p, '=', 1) AS ref, split_part(p, '=', 2) AS hyp FROM best, unnest(picks) AS u(p)),
cm AS (SELECT atm.file_id, CAST(sum((end_ms - start_ms) * len(ref)) AS BIGINT) AS total_ms, CAST(sum((end_ms - start_ms) * greatest(0, len(ref) - len(hyp))) AS BIGINT) AS missed_ms,
         CAST(sum((end_ms - start_ms) * greatest(0, len(hyp) - len(ref))) AS BIGINT) AS fa_ms, CAST(sum((end_ms - start_ms) * least(len(ref), len(hyp))) AS BIGINT) AS both_ms FROM atm GROUP BY atm.file_id),
sp AS (SELECT file_id, count(DISTINCT speaker) FILTER (side = 'ref') AS n_ref_speakers, count(DISTINCT speaker) FILTER (side = 'hyp') AS n_hyp_speakers FROM seg GROUP BY file_id),
df AS (SELECT cm.file_id, total_ms, missed_ms, fa_ms, both_ms - coalesce(right_ms, 0) AS confusion_ms, n_ref_speakers, n_hyp_speakers FROM cm LEFT JOIN best USING (file_id) JOIN sp USING (file_id) WHERE n_ref_speakers > 0 AND n_hyp_speakers > 0),
fr AS (SELECT *, CASE WHEN total_ms > 0 THEN (missed_ms + fa_ms + confusion_ms) / total_ms ELSE CAST(missed_ms + fa_ms + confusion_ms > 0 AS DOUBLE) END AS der,
         CASE WHEN total_ms > 0 THEN missed_ms / total_ms ELSE 0 END AS missed, CASE WHEN total_ms > 0 THEN fa_ms / total_ms ELSE 0 END AS fa, CASE WHEN total_ms > 0 THEN confusion_ms / total_ms ELSE 0 END AS confusion FROM df)
"""
_CORPUS = "CASE WHEN file_id % 2 = 0 THEN 'even' ELSE 'odd' END"


def _files(spark, sf):
    return D.der_by_file(segments(spark, sf))


def _corpora(df):
    return df.withColumn("corpus", F.when(F.col("file_id") % 2 == 0, "even").otherwise("odd"))


@query(f"{_SEG} SELECT file_id, side, speaker, start_ms, end_ms FROM seg")
def segments_from_turns(spark, sf):
    return segments(spark, sf).drop("line")


@query(f"{_SEG} SELECT file_id, speaker, start_ms, greatest(end_ms, start_ms + 1) AS end_ms FROM seg WHERE side = 'hyp'")
def rttm_roundtrip(spark, sf):
    lines = rttm.format_rttm(segments(spark, sf).where("side = 'hyp'"))
    return rttm.parse_rttm(lines.select("file_id", "value"))


@query(f"""{_SEG} SELECT file_id, concat('SPEAKER ', file_id, ' 1 ', start_ms // 1000, '.', lpad(CAST(start_ms % 1000 AS VARCHAR), 3, '0'), ' ', greatest(end_ms - start_ms, 1) // 1000, '.',
  lpad(CAST(greatest(end_ms - start_ms, 1) % 1000 AS VARCHAR), 3, '0'), ' <NA> <NA> ', speaker, ' <NA> <NA>') AS value FROM seg WHERE side = 'ref'""")
def rttm_lines(spark, sf):
    return rttm.format_rttm(segments(spark, sf).where("side = 'ref'")).select("file_id", "value")


@query("SELECT conv_id, turn, replace(replace(replace(concat(role, ' (', turn, ')'), ' ', '_'), '(', ''), ')', '') AS speaker FROM conversations")
def speaker_sanitise(spark, sf):
    c = spark.read.parquet(f"{sf}/conversations.parquet")
    return c.select("conv_id", "turn", S.speaker_label(F.concat("role", F.lit(" ("), F.col("turn").cast("string"), F.lit(")"))).alias("speaker"))


@query(f"{_SEG} SELECT file_id, speaker, start_ms, greatest(end_ms, start_ms + 1) AS end_ms FROM seg WHERE side = 'ref'")
def store_decode(spark, sf):
    seg = segments(spark, sf).where("side = 'ref'")
    one = F.struct(F.col("speaker").alias("speakerId"), (F.col("start_ms") / 1000.0).alias("startTime"), (F.col("end_ms") / 1000.0).alias("endTime"))
    meetings = seg.groupBy(F.col("file_id").alias("id")).agg(F.to_json(F.struct(F.collect_list(one).alias("segments"))).alias("segments_json"))
    return rttm.store_segments(meetings)


@query(f"{_ATOMS} SELECT file_id, start_ms, end_ms, array_to_string(ref, ',') AS ref, array_to_string(hyp, ',') AS hyp FROM atm")
def der_atoms(spark, sf):
    return D.atoms(segments(spark, sf)).withColumns({"ref": F.array_join("ref", ","), "hyp": F.array_join("hyp", ",")})


@query(f"{_ATOMS} SELECT * FROM co")
def der_cooccurrence(spark, sf):
    return D.cooccurrence(D.atoms(segments(spark, sf)))


@query(f"{_ATOMS} SELECT file_id, right_ms FROM best")
def der_assignment(spark, sf):
    return D.assignment(D.cooccurrence(D.atoms(segments(spark, sf)))).groupBy("file_id").agg(F.sum("ms").alias("right_ms"))


@query(f"{_ATOMS} SELECT * FROM fr")
def der_by_file(spark, sf):
    return _files(spark, sf)


@query(f"""{_ATOMS} SELECT {_CORPUS} AS corpus, count(*) AS n_files, CAST(sum(total_ms) AS BIGINT) AS total_ms, CAST(sum(missed_ms) AS BIGINT) AS missed_ms, CAST(sum(fa_ms) AS BIGINT) AS fa_ms, CAST(sum(confusion_ms) AS BIGINT) AS confusion_ms,
  (sum(missed_ms) + sum(fa_ms) + sum(confusion_ms)) / sum(total_ms) AS der, sum(missed_ms) / sum(total_ms) AS missed, sum(fa_ms) / sum(total_ms) AS fa, sum(confusion_ms) / sum(total_ms) AS confusion, 1 - sum(confusion_ms) / sum(total_ms) AS saa FROM df GROUP BY 1""")
def der_corpus_weighted(spark, sf):
    return D.weighted(_corpora(_files(spark, sf)), ["corpus"])


@query(f"""{_ATOMS} SELECT {_CORPUS} AS corpus, count(*) AS n_files, 1 - sum(confusion_ms) / sum(total_ms) AS saa FROM df GROUP BY ROLLUP(1)""")
def saa_rollup(spark, sf):
    return D.weighted(_corpora(_files(spark, sf)), ["corpus"], rollup=True).select("corpus", "n_files", "saa")


@query(f"{_ATOMS} SELECT count(*) AS n_files, count(*) FILTER (n_ref_speakers = n_hyp_speakers) AS n_same, sum(confusion_ms) FILTER (n_ref_speakers = n_hyp_speakers) / sum(total_ms) FILTER (n_ref_speakers = n_hyp_speakers) AS confusion FROM df")
def same_basis_aggregate(spark, sf):
    same = F.col("n_ref_speakers") == F.col("n_hyp_speakers")
    return _files(spark, sf).agg(F.count("*").alias("n_files"), F.count_if(same).alias("n_same"), S.ratio(F.sum(F.when(same, F.col("confusion_ms"))), F.sum(F.when(same, F.col("total_ms")))).alias("confusion"))


_UEM = f"""{_SEG}, sg AS (SELECT * FROM seg WHERE end_ms > start_ms),
um AS (SELECT file_id, CAST(0 AS BIGINT) AS s, max(end_ms) // 2 AS e FROM sg GROUP BY file_id),
cl AS (SELECT sg.file_id, side, speaker, greatest(start_ms, s) AS a, least(end_ms, e) AS b FROM sg JOIN um USING (file_id) WHERE start_ms < e),
bt AS (SELECT file_id, unnest([a, b]) AS t FROM cl WHERE a < b UNION SELECT file_id, unnest([s, e]) FROM um),
nx AS (SELECT file_id, t, lead(t) OVER (PARTITION BY file_id ORDER BY t) AS e FROM bt),
atm AS (SELECT nx.file_id, nx.t, nx.e, count(DISTINCT speaker) FILTER (side = 'ref') AS r, count(DISTINCT speaker) FILTER (side = 'hyp') AS h FROM nx JOIN cl ON cl.file_id = nx.file_id AND cl.a <= nx.t AND cl.b >= nx.e GROUP BY ALL)
SELECT file_id, CAST(sum((e - t) * r) AS BIGINT) AS total_ms, CAST(sum((e - t) * greatest(0, r - h)) AS BIGINT) AS missed_ms, CAST(sum((e - t) * greatest(0, h - r)) AS BIGINT) AS fa_ms FROM atm GROUP BY file_id"""


@query(_UEM)
def der_with_uem(spark, sf):
    seg = segments(spark, sf)
    uem = seg.where("end_ms > start_ms").groupBy("file_id").agg(F.lit(0).cast("long").alias("start_ms"), F.floor(F.max("end_ms") / 2).alias("end_ms"))
    found = D.atoms(seg, half_collar_ms=0, uem=uem)
    return D.components(found, D.assignment(D.cooccurrence(found))).select("file_id", "total_ms", "missed_ms", "fa_ms")


_TURNS = """rf AS (SELECT * FROM seg WHERE side = 'ref'),
g0 AS (SELECT *, max(end_ms) OVER (PARTITION BY file_id, speaker ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM rf),
g1 AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_ms - reach > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY file_id, speaker ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS turn FROM g0),
tn AS (SELECT file_id, speaker, CAST(turn AS BIGINT) AS turn, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n_segments FROM g1 GROUP BY ALL)"""


@query(f"{_SEG}, {_TURNS.format(gap=5000)} SELECT * FROM tn")
def turn_merge(spark, sf):
    return D.turns(segments(spark, sf).where("side = 'ref'"), 5000)


@query(f"{_SEG} SELECT file_id, speaker, CAST(run AS BIGINT) AS run, count(*) AS n FROM (SELECT *, sum(c) OVER (PARTITION BY file_id ORDER BY line) AS run FROM (SELECT *, CASE WHEN lag(speaker) OVER (PARTITION BY file_id ORDER BY line) IS NOT DISTINCT FROM speaker THEN 0 ELSE 1 END AS c FROM seg WHERE side = 'hyp')) GROUP BY ALL")
def speaker_runs(spark, sf):
    return D.runs(segments(spark, sf).where("side = 'hyp'"), ["file_id"], "line", "speaker").groupBy("file_id", "speaker", "run").agg(F.count("*").alias("n"))


_ACC = f"""{_ATOMS}, {_TURNS.format(gap=500)},
cv AS (SELECT t.file_id, t.speaker, t.turn, t.start_ms AS s, t.end_ms AS e, m.hyp AS mapped, a.ref, a.hyp, least(a.end_ms, t.end_ms) - greatest(a.start_ms, t.start_ms) AS ms
       FROM tn t LEFT JOIN mp m ON m.file_id = t.file_id AND m.ref = t.speaker LEFT JOIN atm a ON a.file_id = t.file_id AND a.start_ms < t.end_ms AND t.start_ms < a.end_ms),
ta AS (SELECT file_id, speaker, turn, e - s AS ms, coalesce(sum(ms * len(hyp)), 0) AS said, coalesce(sum(ms) FILTER (list_contains(hyp, mapped)), 0) AS rt, coalesce(sum(ms) FILTER (len(list_filter(ref, lambda x: x <> speaker)) > 0), 0) AS ov FROM cv GROUP BY file_id, speaker, turn, s, e)"""
_BAND = "CASE WHEN ms >= 10000 THEN '10s+' WHEN ms >= 2000 THEN '2-10s' ELSE '<2s' END"


@query(f"{_ACC} SELECT {_BAND} AS band, 2 * ov > ms AS overlapped, count(*) AS n_turns, count(*) FILTER (2 * rt > said) AS n_right, count(*) FILTER (said = 0) AS n_untranscribed FROM ta GROUP BY ALL")
def turn_accuracy_by_length(spark, sf):
    acc = _accuracy(spark, sf)
    return acc.groupBy(S.length_band("ms").alias("band"), "overlapped").agg(F.count("*").alias("n_turns"), F.count_if("right").alias("n_right"), F.count_if("untranscribed").alias("n_untranscribed"))


def _accuracy(spark, sf):
    seg = segments(spark, sf)
    found = D.atoms(seg)
    return D.turn_accuracy(D.turns(seg.where("side = 'ref'")), found, D.assignment(D.cooccurrence(found)))


@query(f"{_ACC} SELECT count(*) AS n_long, count(*) FILTER (NOT (2 * rt > said)) AS n_wrong, (SELECT count(*) FROM (SELECT file_id FROM ta WHERE ms >= 10000 GROUP BY file_id HAVING bool_and(2 * rt > said))) AS n_clean_files FROM ta WHERE ms >= 10000")
def long_turn_errors(spark, sf):
    long = _accuracy(spark, sf).where("ms >= 10000")
    by_file = long.groupBy("file_id").agg(F.count("*").alias("n"), F.count_if(~F.col("right")).alias("wrong"))
    return by_file.agg(F.sum("n").alias("n_long"), F.sum("wrong").alias("n_wrong"), F.count_if(F.col("wrong") == 0).alias("n_clean_files"))


@query(f"{_ACC} SELECT file_id, speaker, turn, 2 * ov > ms AS overlapped FROM ta")
def overlap_flag(spark, sf):
    return _accuracy(spark, sf).select("file_id", "speaker", "turn", "overlapped")


@query(f"""{_ATOMS}, dm AS (SELECT *, row_number() OVER (PARTITION BY file_id, hyp ORDER BY ms DESC, ref) AS k FROM co), rk AS (SELECT *, row_number() OVER (PARTITION BY file_id, ref ORDER BY ms DESC, hyp) AS j FROM dm WHERE k = 1)
SELECT file_id, count(*) FILTER (j > 1) AS n_phantoms FROM rk GROUP BY file_id""")
def phantom_speakers(spark, sf):
    return D.phantoms(D.cooccurrence(D.atoms(segments(spark, sf))))


@query(f"{_ATOMS} SELECT CASE WHEN n_hyp_speakers > n_ref_speakers THEN 'extra' WHEN n_hyp_speakers < n_ref_speakers THEN 'missing' ELSE 'exact' END AS speaker_list, count(*) AS n FROM df GROUP BY 1")
def speaker_count_delta(spark, sf):
    return D.speaker_counts(_files(spark, sf)).groupBy("speaker_list").agg(F.count("*").alias("n"))


@query(f"{_ATOMS}, bs AS (SELECT file_id, missed_ms, total_ms FROM df WHERE file_id % 3 <> 0) SELECT d.file_id, d.missed AS missed_a, b.missed_ms / b.total_ms * 1.1 AS missed_b, b.missed_ms / b.total_ms * 1.1 - d.missed AS missed_delta FROM fr d FULL JOIN bs b USING (file_id)")
def baseline_compare(spark, sf):
    files = _files(spark, sf)
    base = files.where("file_id % 3 <> 0").select("file_id", (F.col("missed") * 1.1).alias("missed"))
    return E.arm_delta(files, base, ["file_id"], ["missed"])


@query(f"{_ATOMS} SELECT 'missed' AS metric, sum(missed_ms) / sum(total_ms) AS value, 0.2 AS pin, 'must_not_rise' AS class, sum(missed_ms) / sum(total_ms) <= 0.2 AS holds FROM df UNION ALL SELECT 'saa', 1 - sum(confusion_ms) / sum(total_ms), 0.9, 'floor', 1 - sum(confusion_ms) / sum(total_ms) >= 0.9 FROM df UNION ALL SELECT 'n_files', count(*), 100, 'must_hold', count(*) = 100 FROM df")
def pin_check(spark, sf):
    total = D.weighted(_files(spark, sf), [])
    metrics = total.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in ("missed", "saa", "n_files")])).alias("x")).select("x.*")
    pins = spark.createDataFrame([("missed", 0.2, "must_not_rise"), ("saa", 0.9, "floor"), ("n_files", 100.0, "must_hold")], "metric string, pin double, class string")
    return E.check_pins(metrics, pins)


@query(f"{_SEG}, {_TURNS.format(gap=500)} SELECT file_id, speaker, CAST(sum(end_ms - start_ms) AS BIGINT) AS ms, count(*) AS n_turns FROM tn GROUP BY ALL HAVING sum(end_ms - start_ms) >= 20000 AND count(*) >= 2")
def enrolment_floor(spark, sf):
    return R.enrolled(D.turns(segments(spark, sf).where("side = 'ref'")).withColumn("ms", F.col("end_ms") - F.col("start_ms")))


@query(f"""{_SEG}, {_TURNS.format(gap=500)}, hd AS (SELECT *, end_ms - start_ms AS ms, sum(end_ms - start_ms) OVER (PARTITION BY file_id, speaker ORDER BY start_ms, turn ROWS UNBOUNDED PRECEDING) AS heard FROM tn)
SELECT CASE WHEN heard < 5000 THEN '<5s' WHEN heard < 20000 THEN '5-20s' ELSE 'full' END AS budget, count(*) AS n_turns, CAST(sum(ms) AS BIGINT) AS ms FROM hd GROUP BY 1""")
def coverage_by_budget(spark, sf):
    heard = R.heard(D.turns(segments(spark, sf).where("side = 'ref'")).withColumn("ms", F.col("end_ms") - F.col("start_ms")))
    band = F.when(F.col("heard_ms") < 5000, "<5s").when(F.col("heard_ms") < 20000, "5-20s").otherwise("full")
    return heard.groupBy(band.alias("budget")).agg(F.count("*").alias("n_turns"), F.sum("ms").alias("ms"))


@query(f"""{_SEG}, a AS (SELECT * FROM seg WHERE side = 'ref' AND end_ms > start_ms), hy AS (SELECT * FROM seg WHERE side = 'hyp' AND end_ms > start_ms),
bt AS (SELECT file_id, unnest([start_ms, end_ms]) AS t FROM a UNION SELECT file_id, unnest([start_ms, end_ms]) FROM hy), nx AS (SELECT file_id, t, lead(t) OVER (PARTITION BY file_id ORDER BY t) AS e FROM bt)
SELECT file_id, CAST(sum(e - t) AS BIGINT) AS ms FROM nx WHERE EXISTS (SELECT 1 FROM a WHERE a.file_id = nx.file_id AND a.start_ms <= t AND a.end_ms >= e) AND EXISTS (SELECT 1 FROM hy WHERE hy.file_id = nx.file_id AND hy.start_ms <= t AND hy.end_ms >= e) GROUP BY file_id""")
def speech_coverage(spark, sf):
    seg = segments(spark, sf)
    return D.intersect_ms(seg.where("side = 'ref' and end_ms > start_ms"), seg.where("side = 'hyp' and end_ms > start_ms"))


@query(f"{_SEG} SELECT DISTINCT file_id, concat('https://example.org/audio/', file_id, '/mix.wav') AS url FROM seg WHERE file_id % 2 = 1")
def pending_downloads(spark, sf):
    ids = segments(spark, sf).select("file_id").distinct()
    return corpora.expand(rttm.only_new(ids, ids.where("file_id % 2 = 0"), "file_id"), "https://example.org/audio/{file_id}/mix.wav", "file_id")
