"""Queries over the files of a scoring run: what is read, what is written, and the report."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.operators import diarization as D
from colloquy.plans import fixtures as X
from colloquy.plans.registry import registry
from colloquy.plans.speech import _ATOMS, _SEG
from colloquy.sources import corpora, report, rttm
from colloquy.sources.shared import fresh

Q, SQL, query = registry()


def _corpus(df):
    return df.withColumn("corpus", F.when(F.col("file_id").cast("long") % 2 == 0, "even").otherwise("odd"))


_CORPUS = "CASE WHEN file_id % 2 = 0 THEN 'even' ELSE 'odd' END AS corpus"


def _segments(spark, sf):
    return X.segments(spark, sf)


# -- files -----------------------------------------------------------------------------------------------------------
@query(f"{_SEG} SELECT CAST(file_id AS VARCHAR) AS file_id, speaker, start_ms, greatest(end_ms, start_ms + 1) AS end_ms FROM seg WHERE side = 'hyp'")
def rttm_files(spark, sf):
    """Segments written to a file for each id, twice over, and read back."""
    path = fresh(spark, "rttm")
    for _ in range(2):
        rttm.write_rttm(_segments(spark, sf).where("side = 'hyp'"), path)
    return rttm.read_rttm(spark, path)


_NOISE = ["", "  ", "; a comment", "SPKR-INFO f 1 <NA> <NA> <NA> unknown s <NA> <NA>", "SPEAKER f\t1  0.0625   1.5 <NA> <NA> a <NA> <NA>", "SPEAKER f 1 2 0 <NA> <NA> b <NA> <NA>", " ; no comment", "SPEAKER f 1 3.25 0.75 <NA> <NA> c"]


@query("SELECT * FROM (VALUES ('a', CAST(63 AS BIGINT), CAST(1563 AS BIGINT)), ('b', 2000, 2000), ('c', 3250, 4000)) t(speaker, start_ms, end_ms)")
def rttm_noise(spark, sf):
    """Blank lines, comments, other records, tabs, and a line that ends early."""
    lines = spark.createDataFrame([("f", x) for x in _NOISE], "file_id string, value string")
    return rttm.parse_rttm(lines).drop("file_id")


@query("SELECT CAST(conv_id AS VARCHAR) AS file_id, CAST(1000 * turn AS BIGINT) AS start_ms, CAST(1000 * turn + 60 * length(coalesce(text, '')) AS BIGINT) AS end_ms FROM conversations")
def uem_files(spark, sf):
    """Regions written to a file for each id and read back, blank lines between them."""
    c = X.table(spark, sf, "conversations")
    end = F.col("turn") + 0.06 * F.length(F.coalesce("text", F.lit("")))
    line = F.concat_ws(" ", F.col("conv_id").cast("string"), F.lit("1"), F.format_string("%.3f", F.col("turn").cast("double")), F.format_string("%.3f", end))
    lines = c.select(F.col("conv_id").alias("file_id"), "turn", F.explode(F.array(line, F.lit(""))).alias("value"))
    path = fresh(spark, "uem")
    rttm.write_lines(lines, path, ".uem", "turn")
    return rttm.read_uem(spark, path)


def _layout(spark, sf):
    """``<root>/<corpus>/rttm`` of references, and a flat ``<root>/rttm`` of another system, which lacks every third file and has one of its own."""
    seg, ref, base = _corpus(_segments(spark, sf)), fresh(spark, "ref"), fresh(spark, "base")
    for name in ("even", "odd"):
        rttm.write_rttm(seg.where((F.col("corpus") == name) & (F.col("side") == "ref")), f"{ref}/{name}/rttm")
    other = seg.where("side = 'hyp' and file_id % 3 <> 0")
    rttm.write_rttm(other.unionByName(other.limit(1).withColumn("file_id", F.lit(-1).cast("long"))), f"{base}/rttm")
    return ref, base


@query(f"""{_SEG}, c AS (SELECT *, {_CORPUS} FROM seg), rr AS (SELECT corpus, CAST(file_id AS VARCHAR) AS file_id, count(*) AS n_ref FROM c WHERE side = 'ref' GROUP BY ALL), bb AS (SELECT CAST(file_id AS VARCHAR) AS file_id, count(*) AS n_base FROM c WHERE side = 'hyp' AND file_id % 3 <> 0 GROUP BY ALL)
SELECT corpus, file_id, n_ref, coalesce(n_base, 0) AS n_base FROM rr LEFT JOIN bb USING (file_id)""")
def corpus_layout(spark, sf):
    """References by corpus folder, and the flat baseline folder restricted to their files."""
    ref, base = _layout(spark, sf)
    files = rttm.read_corpora(spark, ref).groupBy("corpus", "file_id").agg(F.count("*").alias("n_ref"))
    others = rttm.read_baseline(spark, base, files).groupBy("corpus", "file_id").agg(F.count("*").alias("n_base"))
    return files.join(others, ["corpus", "file_id"], "left").na.fill(0, ["n_base"])


@query("SELECT CAST(conv_id AS VARCHAR) AS id FROM conversations GROUP BY conv_id")
def meeting_ids(spark, sf):
    """Ids of a store, and none of a store that is not there."""
    path = fresh(spark, "store")
    X.table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("id"), F.lit("{}").alias("segments_json")).write.parquet(path)
    return rttm.store_ids(spark, path).unionByName(rttm.store_ids(spark, f"{path}-missing"))


@query("WITH a AS (SELECT DISTINCT conv_id AS id FROM conversations), b AS (SELECT DISTINCT conv_id AS id FROM conversations WHERE conv_id % 3 <> 1), n AS (SELECT id FROM a EXCEPT SELECT id FROM b) SELECT id, id = (SELECT min(id) FROM n) AS picked FROM n")
def new_meetings(spark, sf):
    """What is in the store after a run and was not before, and which of it is taken."""
    c = X.table(spark, sf, "conversations").select(F.col("conv_id").alias("id"))
    return rttm.pick_new(c, c.where("id % 3 <> 1"))


@query(
    "SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{i}', 'https://groups.inf.ed.ac.uk/ami/AMICorpusMirror/amicorpus/{i}/audio/{i}.Mix-Headset.wav')" for c, ids in corpora.FILES.items() for i in ids) + ") t(corpus, meeting_id, url)"
)
def corpus_catalog(spark, sf):
    """The union of all corpora, with addresses of their files."""
    return corpora.expand(corpora.catalog(spark), corpora.AMI_AUDIO)


@query(f"{_SEG}, f AS (SELECT DISTINCT file_id, {_CORPUS} FROM seg) SELECT corpus, file_id, row_number() OVER (PARTITION BY corpus ORDER BY file_id) AS i, count(*) OVER (PARTITION BY corpus) AS n FROM f")
def progress_index(spark, sf):
    files = _corpus(_segments(spark, sf).select("file_id").distinct())
    out = rttm.progress(files, "corpus", "file_id")
    return out.withColumn("i", F.col("i").cast("long"))


# -- results ---------------------------------------------------------------------------------------------------------
_FILES = f"{_ATOMS}, fc AS (SELECT *, {_CORPUS} FROM fr)"


def _files(spark, sf):
    return _corpus(D.der_by_file(_segments(spark, sf)))


@query(f"""{_FILES}, rs AS (SELECT file_id, sum(end_ms - start_ms) AS spoken FROM seg WHERE side = 'ref' GROUP BY file_id)
SELECT CAST(file_id AS VARCHAR) AS file_id, corpus, der, missed, fa, confusion, n_ref_speakers, n_hyp_speakers, CASE WHEN total_ms > 0 THEN total_ms ELSE spoken END / 1000.0 AS ref_duration FROM fc JOIN rs USING (file_id)""")
def file_results(spark, sf):
    """Results of files by corpus as nested JSON documents, written twice over, read back and taken apart."""
    files = D.with_ref_ms(_files(spark, sf), _segments(spark, sf)).withColumn("file_id", F.col("file_id").cast("string"))
    own = files.select("corpus", "file_id", "der", "missed", "fa", "confusion", "n_ref_speakers", "n_hyp_speakers", (F.col("ref_ms") / 1000.0).alias("ref_duration"))
    totals = D.weighted(files, ["corpus"]).select("corpus", *[F.col(c).alias(f"aggregate_{c}") for c in ("der", "missed", "fa", "confusion")])
    path = fresh(spark, "results")
    for _ in range(2):
        rttm.write_documents(rttm.result_document(own, totals), path)
    back = rttm.read_documents(spark, path, multi_line=False)
    return back.select("corpus", F.explode("files").alias("f")).select("corpus", "f.*")


_P = lambda c: f"printf('%.1f%%', 100 * CAST({c} AS DOUBLE))"


@query(f"""{_FILES}, bf AS (SELECT file_id, der * 1.1 AS der FROM fc WHERE corpus = 'even' AND file_id % 3 <> 0),
w AS (SELECT corpus, count(*) AS n, sum(total_ms) AS t, sum(missed_ms) AS m, sum(fa_ms) AS f, sum(confusion_ms) AS c FROM fc GROUP BY corpus),
bw AS (SELECT corpus, sum(bf.der * fc.total_ms) / sum(fc.total_ms) AS der FROM fc JOIN bf USING (file_id) GROUP BY corpus)
SELECT 10 AS part, corpus, '' AS file_id, concat('| ', corpus, ' | ', n, ' | ', {_P('(m + f + c) / t')}, ' | ', {_P('c / t')}, ' | ', {_P('f / t')}, ' | ', {_P('m / t')}, ' |') AS line FROM w
UNION ALL SELECT 25, w.corpus, '', concat('| ', w.corpus, ' | ', coalesce({_P('bw.der')}, '—'), ' | ', {_P('(m + f + c) / t')}, ' |') FROM w LEFT JOIN bw ON bw.corpus = w.corpus
UNION ALL SELECT 40, corpus, CAST(fc.file_id AS VARCHAR), CASE corpus WHEN 'even' THEN concat('| ', fc.file_id, ' | ', coalesce({_P('bf.der')}, '—'), ' | ', {_P('fc.der')}, ' | ', n_ref_speakers, ' | ', n_hyp_speakers, ' |')
  ELSE concat('| ', fc.file_id, ' | ', {_P('fc.der')}, ' | ', {_P('missed')}, ' | ', {_P('fa')}, ' | ', {_P('confusion')}, ' | ', n_ref_speakers, ' | ', n_hyp_speakers, ' |') END FROM fc LEFT JOIN bf ON bf.file_id = fc.file_id""")
def score_report(spark, sf):
    """Lines of the report's tables. A baseline has scored two thirds of the files of one corpus."""
    files = _files(spark, sf)
    base = files.where("corpus = 'even' and file_id % 3 <> 0").withColumn("der", F.col("der") * 1.1)
    weighted = base.groupBy("corpus").agg((F.sum(F.col("der") * F.col("total_ms")) / F.sum("total_ms")).alias("der"))
    lines = report.report_lines(files, D.weighted(files, ["corpus"]), base, weighted)
    return lines.where("part in (10, 25) or part = 40 and file_id <> ''")


_SAME = _ATOMS.replace("sg AS (SELECT * FROM seg WHERE end_ms > start_ms)", """twice AS (SELECT * FROM seg UNION ALL SELECT file_id, side, concat(speaker, '2'), start_ms, end_ms, line + 100 FROM seg WHERE line % 3 = 0),
sg AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY file_id, side, start_ms, end_ms ORDER BY line DESC) AS k FROM twice WHERE end_ms > start_ms) WHERE k = 1)""").replace("FROM seg GROUP BY file_id),\ndf", "FROM sg GROUP BY file_id),\ndf")


@query(f"{_SAME} SELECT file_id, total_ms, missed_ms, fa_ms, confusion_ms, n_ref_speakers, n_hyp_speakers FROM df")
def der_same_span(spark, sf):
    """Every third segment stands there twice, under two labels; the later one counts."""
    seg = _segments(spark, sf)
    again = seg.where("line % 3 = 0").withColumns({"speaker": F.concat("speaker", F.lit("2")), "line": F.col("line") + 100})
    out = D.der_by_file(seg.unionByName(again), dedupe_identical_spans=True)
    return out.select("file_id", "total_ms", "missed_ms", "fa_ms", "confusion_ms", "n_ref_speakers", "n_hyp_speakers")


@query(f"{_SEG} SELECT DISTINCT file_id FROM seg WHERE side = 'ref' AND (file_id % 7 = 0 OR NOT EXISTS (SELECT 1 FROM seg h WHERE h.side = 'hyp' AND h.file_id = seg.file_id))")
def skip_report(spark, sf):
    """Every seventh file has no hypothesis."""
    return D.skipped(_segments(spark, sf).where("side = 'ref' or file_id % 7 <> 0"))


@query(f"""{_SEG}, cl AS (SELECT file_id, line, CASE WHEN line % 4 = 0 THEN end_ms + 1000000 ELSE start_ms END AS s, CASE WHEN line % 4 = 0 THEN end_ms + 1000500 ELSE end_ms END AS e FROM seg WHERE side = 'hyp' AND end_ms > start_ms),
sp AS (SELECT file_id, start_ms, end_ms FROM seg WHERE side = 'ref' AND end_ms > start_ms),
cv AS (SELECT cl.file_id, cl.line, cl.s, cl.e, coalesce(sum(least(e, end_ms) - greatest(s, start_ms)) FILTER (end_ms > s AND start_ms < e), 0) AS ms FROM cl LEFT JOIN sp USING (file_id) GROUP BY ALL)
SELECT file_id, count(*) AS n_claims, count(*) FILTER (ms = 0) AS n_over, CAST(sum(e - s) AS BIGINT) AS claimed_ms, CAST(sum(ms) AS BIGINT) AS covered_ms FROM cv GROUP BY file_id""")
def speech_claims(spark, sf):
    """What hypothesis segments claim against the speech there is; every fourth lies far behind the end."""
    seg = _segments(spark, sf).where("end_ms > start_ms")
    far = F.col("line") % 4 == 0
    claimed = seg.where("side = 'hyp'").select("file_id", "line", F.when(far, F.col("end_ms") + 1_000_000).otherwise(F.col("start_ms")).alias("start_ms"), F.when(far, F.col("end_ms") + 1_000_500).otherwise(F.col("end_ms")).alias("end_ms"))
    return D.claims(seg.where("side = 'ref'"), claimed)
